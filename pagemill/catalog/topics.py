"""Topic queries, with the built-in dictionary and with one whose words occur in the samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.catalog import pages as P
from pagemill.catalog import stand_ins as D
from pagemill.operators import extract as E
from pagemill.operators import topics as T
from pagemill.plans.pipeline import with_topics
from pagemill.plans.unnest import unnest
from pagemill.schemas import Limits
from pagemill.sources.tables import read_table

SAMPLE_TOPICS = {
    "english": ["the", "and", "of", "with", "that", "in is", "thorreou"],
    "french": ["de", "le", "la", "que", "des", "en un"],
    "german": ["der", "und", "die", "nicht", "das sch"],
    "spanish": ["los", "las", "por", "una", "en"],
    "pairs": ["of the", "de la", "und der", "in that"],
}
# Terms that share words: the scan decides which of them a text has.
MIXED_TOPICS = {
    "articles": ["de la", "la", "de", "que de la", "la que"],
    "joined": ["of the", "the", "in that", "that the of", "and", "and the", "of"],
    "german": ["der und", "und der", "und", "die", "und der die"],
    "apart": ["los", "las", "with"],
}
SAMPLE_PATTERNS = {
    "french": ["/fr/", "/fr"],
    "english": ["/en/", "page="],
    "spam": ["cheap-pills", "utm_source"],
    "mobile": ["//m.", "/mobile"],
    "english_words": ["blog.", "news"],
}


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "documents").select("doc_id", "text")


def _page_texts(spark: SparkSession, folder: str) -> DataFrame:
    parts = E.extract(D.pages(spark, folder), "title", "description", "keywords", "body_text")
    text = T.classification_text(
        F.col("title"), F.col("description"), F.col("keywords"), F.col("body_text")
    )
    return parts.select("page_id", "url", text.alias("text"))


def topic_matches(spark: SparkSession, folder: str) -> DataFrame:
    return T.match_keywords(_documents(spark, folder), "doc_id", SAMPLE_TOPICS).select(
        "doc_id", "topic", "keyword", "hits", F.col("first_pos").cast("long").alias("first_pos")
    )


def _scored(matches: DataFrame, key: str) -> DataFrame:
    return T.score_topics(matches, key).select(
        key, "topic", "hits", "distinct_keywords", D.r6("score").alias("score")
    )


def topic_scores(spark: SparkSession, folder: str) -> DataFrame:
    return _scored(T.match_keywords(_documents(spark, folder), "doc_id"), "doc_id")


def topic_scores_sample(spark: SparkSession, folder: str) -> DataFrame:
    return _scored(T.match_keywords(_documents(spark, folder), "doc_id", SAMPLE_TOPICS), "doc_id")


def _selected(scores: DataFrame, key: str) -> DataFrame:
    return T.select_topics(scores, key).select(key, "topic", D.r6("confidence").alias("confidence"), "rank")


def topic_top(spark: SparkSession, folder: str) -> DataFrame:
    matches = T.match_keywords(_documents(spark, folder), "doc_id", SAMPLE_TOPICS)
    return _selected(T.score_topics(matches, "doc_id"), "doc_id")


def topic_top_pages(spark: SparkSession, folder: str) -> DataFrame:
    matches = T.match_keywords(_page_texts(spark, folder), "page_id", SAMPLE_TOPICS)
    return _selected(T.score_topics(matches, "page_id"), "page_id")


def topic_keywords(spark: SparkSession, folder: str) -> DataFrame:
    matches = T.match_keywords(_documents(spark, folder), "doc_id", SAMPLE_TOPICS)
    return T.top_keywords(matches, "doc_id")


def page_topics(spark: SparkSession, folder: str) -> DataFrame:
    """The one-expression form on page rows: same rules, no shuffle."""
    pages = E.extract(D.pages(spark, folder), "title", "description", "keywords", "body_text")
    found = unnest(with_topics(pages, SAMPLE_TOPICS), "topics", "page_id", item="t")
    return found.select(
        "page_id",
        (F.col("place") + 1).alias("rank"),
        F.col("t.topic").alias("topic"),
        D.r6("t.confidence").alias("confidence"),
        F.array_join("t.keywords", "|").alias("keywords"),
    )


def topic_matches_mixed(spark: SparkSession, folder: str) -> DataFrame:
    """Hits of a dictionary whose terms overlap, as a scan from the left finds them."""
    return T.match_keywords(_documents(spark, folder), "doc_id", MIXED_TOPICS).select(
        "doc_id", "topic", "keyword", "hits", F.col("first_pos").cast("long").alias("first_pos")
    )


def page_topics_mixed(spark: SparkSession, folder: str) -> DataFrame:
    """The same dictionary in the one-expression form, on page rows."""
    pages = E.extract(D.pages(spark, folder), "title", "description", "keywords", "body_text")
    found = unnest(with_topics(pages, MIXED_TOPICS), "topics", "page_id", item="t")
    return found.select(
        "page_id", (F.col("place") + 1).alias("rank"), F.col("t.topic").alias("topic"),
        D.r6("t.confidence").alias("confidence"), F.array_join("t.keywords", "|").alias("keywords"),
    )


def url_topics(spark: SparkSession, folder: str) -> DataFrame:
    return T.classify_urls(D.pages(spark, folder), "page_id", SAMPLE_PATTERNS).select(
        "page_id", "topic", "confidence", "keyword"
    )


def url_topics_builtin(spark: SparkSession, folder: str) -> DataFrame:
    """Built-in patterns on URLs whose language segment is replaced by a section name."""
    sections = ["shop/x", "news", "api", "company", "course", "music", "football", "hotel", "recipe", "doctor", "x.edu"]
    section = F.element_at(
        F.array(*map(F.lit, sections)), (F.col("page_id") % len(sections)).cast("int") + 1
    )
    url = F.regexp_replace("url", "/(?:en|fr|de|es)/", "/__/")
    pages = D.pages(spark, folder).select("page_id", F.replace(url, F.lit("__"), section).alias("url"))
    return T.classify_urls(pages, "page_id").select("page_id", "topic", "confidence", "keyword")


def topics_enhanced(spark: SparkSession, folder: str) -> DataFrame:
    matches = T.match_keywords(_page_texts(spark, folder), "page_id", SAMPLE_TOPICS)
    content = T.select_topics(T.score_topics(matches, "page_id"), "page_id").join(
        T.keyword_lists(matches, "page_id"), ["page_id", "topic"]
    )
    merged = T.merge_url_topics(
        content, T.classify_urls(D.pages(spark, folder), "page_id", SAMPLE_PATTERNS), "page_id"
    )
    return merged.select(
        "page_id", "topic", D.r6("confidence").alias("confidence"), F.array_join("keywords", "|").alias("keywords"), "rank"
    )


def topics_limited(spark: SparkSession, folder: str) -> DataFrame:
    """At most two topics per page, from short titles and bodies: the limits are the feature."""
    limits = Limits(title=30, body=400)
    pages = E.extract(D.pages(spark, folder), "title", "description", "keywords", "body_text", limits=limits)
    found = unnest(with_topics(pages, SAMPLE_TOPICS, limit=2), "topics", "page_id", item="t")
    return found.select("page_id", (F.col("place") + 1).alias("rank"), F.col("t.topic").alias("topic"))


def topics_detected(spark: SparkSession, folder: str) -> DataFrame:
    pages = E.extract(D.pages(spark, folder), "title", "description", "keywords", "body_text")
    return T.topics_detected(with_topics(pages, SAMPLE_TOPICS))


QUERIES = {
    f.__name__: f
    for f in (
        topic_matches, topic_scores, topic_scores_sample, topic_top, topic_top_pages, topic_keywords,
        page_topics, topic_matches_mixed, page_topics_mixed, url_topics, url_topics_builtin, topics_enhanced, topics_limited, topics_detected,
    )
}

# --- expected results ---------------------------------------------------------------------------


def _values(topics: T.Dictionary) -> str:
    rows = [
        f"('{t}', {i}, '{w}', {len(words)})" for i, (t, words) in enumerate(topics.items()) for w in words
    ]
    return "(VALUES " + ", ".join(rows) + ") d(topic, topic_ord, term, k)"


PAGE_TEXT_SQL = (
    f"concat_ws(' ', nullif({P.TITLE_SQL}, ''), nullif({P.PARAGRAPH_SQL}, ''), nullif({P.BODY_SQL}, ''))"
)


def hits_sql(source: str, key: str, topics: T.Dictionary) -> str:
    """Common table expressions ``hits`` (key, topic, term, n, first_pos) and ``scores``."""
    return f"""
src AS ({source}),
tok AS (SELECT {key}, n_words, generate_subscripts(ts, 1) - 1 AS pos, unnest(ts) AS t FROM (
  SELECT {key}, len(regexp_extract_all(text, '[^\\s\\x{{a0}}\\x{{2000}}-\\x{{200a}}\\x{{3000}}]+')) AS n_words,
         regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+|[^\\p{{L}}\\p{{N}}_]+') AS ts FROM src)),
near AS (SELECT {key}, n_words, pos, t, lead(t, 1) OVER w AS gap, lead(t, 2) OVER w AS nxt
  FROM tok WINDOW w AS (PARTITION BY {key} ORDER BY pos)),
terms AS (SELECT {key}, n_words, pos, t AS term FROM near
  UNION ALL SELECT {key}, n_words, pos, t || ' ' || nxt FROM near WHERE gap = ' '),
hits AS (SELECT {key}, n_words, topic, topic_ord, k, term, count(*) AS n, min(pos) AS first_pos
  FROM terms JOIN {_values(topics)} USING (term) GROUP BY ALL),
scores AS (SELECT {key}, topic, topic_ord, sum(n) AS hits, count(*) AS u,
  count(*) / any_value(k) + least(sum(n) / any_value(n_words) * 100, 0.5) + least(count(*) / 10, 0.3) AS score
  FROM hits GROUP BY {key}, topic, topic_ord),
chosen AS (SELECT * FROM (SELECT {key}, topic, topic_ord, least(score, 1.0) AS confidence,
  row_number() OVER (PARTITION BY {key} ORDER BY least(score, 1.0) DESC, topic_ord) AS rank FROM scores WHERE score >= 0.5)),
best AS (SELECT * FROM (SELECT {key}, topic, term, n,
  row_number() OVER (PARTITION BY {key}, topic ORDER BY n DESC, first_pos) AS rank FROM hits) WHERE rank <= 5)"""


def scanned_sql(source: str, key: str, topics: T.Dictionary) -> str:
    """``hits_sql`` for terms of up to three words that overlap: one step of the scan per hit."""
    listed = ", ".join(
        f"('{t}', {i}, '{w}', {len(words)}, {n}, {2 * len(w.split(' ')) - 1})"
        for i, (t, words) in enumerate(topics.items()) for n, w in enumerate(words)
    )
    simple = hits_sql(source, key, topics)
    head, tail = simple.split("near AS", 1)[0], simple.split("scores AS", 1)[1]
    return f"""RECURSIVE {head.lstrip()}
near AS (SELECT {key}, n_words, pos, t, lead(t, 1) OVER w AS gap, lead(t, 2) OVER w AS nxt, lead(t, 3) OVER w AS gap2, lead(t, 4) OVER w AS nxt2
  FROM tok WINDOW w AS (PARTITION BY {key} ORDER BY pos)),
terms AS (SELECT {key}, n_words, pos, t AS term FROM near
  UNION ALL SELECT {key}, n_words, pos, t || ' ' || nxt FROM near WHERE gap = ' '
  UNION ALL SELECT {key}, n_words, pos, t || ' ' || nxt || ' ' || nxt2 FROM near WHERE gap = ' ' AND gap2 = ' '),
-- The first listed term of each position.
heads AS (SELECT DISTINCT ON ({key}, topic, pos) {key}, n_words, topic, topic_ord, k, term, pos, pos + width AS behind
  FROM terms JOIN (VALUES {listed}) d(topic, topic_ord, term, k, nth, width) USING (term) ORDER BY {key}, topic, pos, nth),
lists AS (SELECT {key}, topic, list(pos ORDER BY pos) AS at, list(behind ORDER BY pos) AS behinds FROM heads GROUP BY {key}, topic),
scan({key}, topic, i, free, kept) AS (
  SELECT {key}, topic, 1, 0::BIGINT, NULL::BIGINT FROM lists
  UNION ALL
  SELECT s.{key}, s.topic, s.i + 1, CASE WHEN l.at[s.i] >= s.free THEN l.behinds[s.i] ELSE s.free END,
         CASE WHEN l.at[s.i] >= s.free THEN l.at[s.i] END
  FROM scan s JOIN lists l ON l.{key} = s.{key} AND l.topic = s.topic WHERE s.i <= len(l.at)),
hits AS (SELECT h.{key}, h.n_words, h.topic, h.topic_ord, h.k, h.term, count(*) AS n, min(h.pos) AS first_pos
  FROM heads h JOIN scan s ON s.{key} = h.{key} AND s.topic = h.topic AND s.kept = h.pos GROUP BY ALL),
scores AS{tail}"""


_DOCS = "SELECT doc_id, text FROM documents"
_PAGES = f"SELECT page_id, {PAGE_TEXT_SQL} AS text FROM pages"
_SHORT_PAGES = (
    f"SELECT page_id, concat_ws(' ', nullif(substr({P.TITLE_SQL}, 1, 30), ''), nullif({P.PARAGRAPH_SQL}, ''), "
    f"nullif(substr({P.BODY_SQL}, 1, 400), '')) AS text FROM pages"
)
_SCORES = (
    "SELECT doc_id, topic, CAST(hits AS BIGINT) AS hits, u AS distinct_keywords, round(score, 6) AS score FROM scores"
)
_CHOSEN = "SELECT {0}, topic, round(confidence, 6) AS confidence, CAST(rank AS INT) AS rank FROM chosen"


def _first_pattern(patterns: T.Dictionary, source: str) -> str:
    parts = []
    for place, (topic, words) in enumerate(patterns.items()):
        cases = " ".join(f"WHEN contains(lower(url), '{w}') THEN '{w.strip('/')}'" for w in words)
        parts.append(
            f"SELECT page_id, '{topic}' AS topic, {place} AS topic_ord, CAST(0.7 AS DOUBLE) AS confidence, "
            f"CASE {cases} END AS keyword FROM {source}"
        )
    return "SELECT * FROM (" + " UNION ALL ".join(parts) + ") WHERE keyword IS NOT NULL"


_SECTIONS = ["shop/x", "news", "api", "company", "course", "music", "football", "hotel", "recipe", "doctor", "x.edu"]
_SECTION_SQL = "CASE page_id % 11 " + " ".join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(_SECTIONS)) + " END"

SQL = {
    "topic_matches": f"WITH {hits_sql(_DOCS, 'doc_id', SAMPLE_TOPICS)} "
    "SELECT doc_id, topic, term AS keyword, n AS hits, first_pos FROM hits",
    "topic_scores": f"WITH {hits_sql(_DOCS, 'doc_id', T.TOPIC_KEYWORDS)} {_SCORES}",
    "topic_scores_sample": f"WITH {hits_sql(_DOCS, 'doc_id', SAMPLE_TOPICS)} {_SCORES}",
    "topic_top": f"WITH {hits_sql(_DOCS, 'doc_id', SAMPLE_TOPICS)} {_CHOSEN.format('doc_id')}",
    "topic_top_pages": f"WITH {hits_sql(_PAGES, 'page_id', SAMPLE_TOPICS)} {_CHOSEN.format('page_id')}",
    "topic_keywords": f"WITH {hits_sql(_DOCS, 'doc_id', SAMPLE_TOPICS)} "
    "SELECT doc_id, topic, term AS keyword, n AS hits, CAST(rank AS INT) AS rank FROM best",
    "page_topics": f"""WITH {hits_sql(_PAGES, 'page_id', SAMPLE_TOPICS)}
SELECT c.page_id, CAST(any_value(c.rank) AS INT) AS rank, c.topic, round(any_value(c.confidence), 6) AS confidence,
  string_agg(b.term, '|' ORDER BY b.rank) AS keywords
FROM chosen c JOIN best b ON c.page_id = b.page_id AND c.topic = b.topic GROUP BY c.page_id, c.topic""",
    "topic_matches_mixed": f"WITH {scanned_sql(_DOCS, 'doc_id', MIXED_TOPICS)} "
    "SELECT doc_id, topic, term AS keyword, n AS hits, first_pos FROM hits",
    "page_topics_mixed": f"""WITH {scanned_sql(_PAGES, 'page_id', MIXED_TOPICS)}
SELECT c.page_id, CAST(any_value(c.rank) AS INT) AS rank, c.topic, round(any_value(c.confidence), 6) AS confidence,
  string_agg(b.term, '|' ORDER BY b.rank) AS keywords
FROM chosen c JOIN best b ON c.page_id = b.page_id AND c.topic = b.topic GROUP BY c.page_id, c.topic""",
    "url_topics": f"SELECT page_id, topic, confidence, keyword FROM ({_first_pattern(SAMPLE_PATTERNS, 'pages')})",
    "url_topics_builtin": f"""
WITH p AS (SELECT page_id, regexp_replace(url, '/(?:en|fr|de|es)/', '/' || {_SECTION_SQL} || '/') AS url FROM pages)
SELECT page_id, topic, confidence, keyword FROM ({_first_pattern(T.URL_PATTERNS, 'p')})""",
    "topics_enhanced": f"""WITH {hits_sql(_PAGES, 'page_id', SAMPLE_TOPICS)},
by_url AS ({_first_pattern(SAMPLE_PATTERNS, 'pages')}),
merged AS (SELECT coalesce(c.page_id, u.page_id) AS page_id, coalesce(c.topic, u.topic) AS topic,
  CASE WHEN c.topic IS NULL THEN u.confidence WHEN u.topic IS NULL THEN c.confidence
       ELSE least(c.confidence + 0.2, 1.0) END AS confidence, coalesce(k.keywords, u.keyword) AS keywords,
  c.rank AS place, u.topic_ord AS url_ord
  FROM (chosen c JOIN (SELECT page_id, topic, string_agg(term, '|' ORDER BY rank) AS keywords FROM best GROUP BY page_id, topic) k
    ON c.page_id = k.page_id AND c.topic = k.topic) FULL JOIN by_url u ON c.page_id = u.page_id AND c.topic = u.topic)
SELECT page_id, topic, round(confidence, 6) AS confidence, keywords, CAST(rank AS INT) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY confidence DESC, place IS NULL, place, url_ord) AS rank FROM merged)""",
    "topics_limited": f"WITH {hits_sql(_SHORT_PAGES, 'page_id', SAMPLE_TOPICS)} "
    "SELECT page_id, CAST(rank AS INT) AS rank, topic FROM chosen WHERE rank <= 2",
    "topics_detected": f"WITH {hits_sql(_PAGES, 'page_id', SAMPLE_TOPICS)} "
    "SELECT topic, count(*) AS pages FROM chosen GROUP BY topic",
}

# Rich pages: their text, and what the summary and containment queries read from it.
RICH_TEXT_SQL = f"""
SELECT m.page_id, concat_ws(' ', nullif(m.title, ''), nullif(m.description, ''), replace(m.keyword_list, '|', ' '),
  nullif({P.BODY_SQL}, '')) AS text
FROM ({P.SQL['page_meta_fields']}) m JOIN (SELECT page_id, {D.RICH_HTML} AS html FROM pages) h ON m.page_id = h.page_id"""

P.SQL["page_summary"] = f"""WITH {hits_sql(RICH_TEXT_SQL, 'page_id', T.TOPIC_KEYWORDS)},
l AS (SELECT page_id, count(*) AS n FROM ({P.SQL['page_links']}) GROUP BY page_id),
i AS (SELECT page_id, count(*) AS n FROM ({P.SQL['page_images']}) GROUP BY page_id),
c AS (SELECT page_id, count(*) AS n, string_agg(topic, '|' ORDER BY rank) FILTER (WHERE rank <= 3) AS names FROM chosen GROUP BY page_id)
SELECT page_id, CAST(6 AS INT) AS n_keywords, CAST(i.n AS INT) AS n_images, CAST(l.n AS INT) AS n_links,
  CAST(coalesce(c.n, 0) AS INT) AS n_topics, coalesce(c.names, '') AS top_topics
FROM pages JOIN l USING (page_id) JOIN i USING (page_id) LEFT JOIN c USING (page_id)"""
