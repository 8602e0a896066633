"""Search and duplicate queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.catalog import stand_ins as D
from pagemill.catalog import topics as TC
from pagemill.catalog.pages import PARAGRAPH_SQL, TITLE_SQL
from pagemill.operators import extract as E
from pagemill.functions.stemming import STOP_WORDS, stems_sql
from pagemill.operators import search as S
from pagemill.operators import text_index as TI
from pagemill.plans.pipeline import with_topics
from pagemill.plans.scratch import scratch_path
from pagemill.plans.unnest import keep
from pagemill.sources.tables import read_table

ASKED = {"all": "the attions", "any": "erin eriner ders dening", "none": "things"}
PHRASE = "attions to thanedbles"
WEIGHED = "things attions oning erlying"
SIMILAR_TO = "that and the of with thnt erin reand"


def contains_filter(spark: SparkSession, folder: str) -> DataFrame:
    fields = ("title", "description", "keywords", "body_text")
    pages = with_topics(E.extract(D.rich_pages(spark, folder), *fields), TC.SAMPLE_TOPICS)
    return pages.select(
        "page_id", S.has_keyword("k3").alias("has_k3"), S.has_topic("pairs").alias("has_pairs")
    )


def fulltext_all(spark: SparkSession, folder: str) -> DataFrame:
    pages = E.extract(D.pages(spark, folder), "title", "description")
    return keep(pages, S.matches_words("the of", F.col("title"), F.col("description"))).select("page_id", "title")


def fulltext_any(spark: SparkSession, folder: str) -> DataFrame:
    documents = read_table(spark, folder, "documents").select("doc_id", "text")
    return keep(documents, S.matches_words("thorreou Nicht zwei", F.col("text"), any_word=True)).select("doc_id")


def _indexed(spark: SparkSession, folder: str) -> str:
    path = scratch_path(spark, "text-index")
    pages = E.extract(D.pages(spark, folder), "title", "description")
    TI.build_index(pages, "page_id", F.concat_ws(" ", "title", "description"), path)
    return path


def fulltext_boolean(spark: SparkSession, folder: str) -> DataFrame:
    """Pages with all, any and none of some words in any of their forms, from an index of titles and descriptions."""
    found = TI.search(spark, _indexed(spark, folder), TI.parse(spark, **ASKED))
    return found.select(F.col("id").alias("page_id"), F.size("found").alias("n_terms"))


def fulltext_phrase(spark: SparkSession, folder: str) -> DataFrame:
    """Pages in which the stems of a phrase stand at its distances."""
    return TI.search(spark, _indexed(spark, folder), TI.parse(spark, phrase=PHRASE)).select(F.col("id").alias("page_id"))


def fulltext_ranked(spark: SparkSession, folder: str) -> DataFrame:
    """Pages with any of some words, rare and repeated ones first."""
    found = TI.ranked(spark, _indexed(spark, folder), TI.parse(spark, any=WEIGHED))
    return found.select(F.col("id").alias("page_id"), "score")


def trigram(spark: SparkSession, folder: str) -> DataFrame:
    found = S.trigram_search(read_table(spark, folder, "benchmark"), "text", SIMILAR_TO, 0.1)
    return found.select("item_id", D.r6("similarity").alias("similarity"))


def trigram_titles(spark: SparkSession, folder: str) -> DataFrame:
    pages = E.extract(D.pages(spark, folder), "title")
    return S.trigram_search(pages, "title", SIMILAR_TO, 0.15).select(
        "page_id", D.r6("similarity").alias("similarity")
    )


def trigram_join(spark: SparkSession, folder: str) -> DataFrame:
    """Benchmark items against the titles and descriptions of pages, by trigrams."""
    pages = E.extract(D.pages(spark, folder), "title", "description")
    # A title and a description of one page need keys of their own.
    heads = pages.select("page_id", F.posexplode(F.array("title", "description")).alias("nth", "head")).withColumn(
        "head_id", 2 * F.col("page_id") + F.col("nth")
    )
    items = S.trigram_sets(read_table(spark, folder, "benchmark"), "item_id", "text")
    found = S.trigram_join(items, S.trigram_sets(heads, "head_id", "head"), 0.2)
    return found.select(
        F.col("left_first").alias("item_id"), F.col("right_text").alias("head"), F.col("right_first").alias("first_id"),
        "pairs", D.r6("similarity").alias("similarity"),
    )


def dup_content(spark: SparkSession, folder: str) -> DataFrame:
    documents = read_table(spark, folder, "documents")
    return S.duplicate_content(documents, "doc_id", F.sha2("text", 256))


QUERIES = {
    f.__name__: f
    for f in (
        contains_filter, fulltext_all, fulltext_any, fulltext_boolean, fulltext_phrase, fulltext_ranked,
        trigram, trigram_titles, trigram_join, dup_content,
    )
}

# --- expected results ---------------------------------------------------------------------------


def _similar_sql(source: str, key: str, text: str, floor: float) -> str:
    def grams(t: str) -> str:
        return (
            f"SELECT DISTINCT substr('  ' || w || ' ', i, 3) AS g FROM "
            f"(SELECT unnest(regexp_extract_all(lower({t}), '[\\p{{L}}\\p{{N}}]+')) AS w) x, range(1, length(w) + 2) r(i)"
        )

    return f"""
WITH q AS ({grams("'" + SIMILAR_TO + "'")}),
t AS (SELECT {key}, {text} AS text FROM {source}),
w AS (SELECT {key}, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+')) AS w FROM t),
g AS (SELECT DISTINCT {key}, substr('  ' || w || ' ', i, 3) AS g FROM w, range(1, 100) r(i) WHERE i <= length(w) + 1),
s AS (SELECT {key}, count(*) AS n, count(q.g) AS shared FROM g LEFT JOIN q ON g.g = q.g GROUP BY 1)
SELECT {key}, round(shared / (n + (SELECT count(*) FROM q) - shared), 6) AS similarity FROM s
WHERE shared / (n + (SELECT count(*) FROM q) - shared) >= {floor}"""


def _postings_sql(source: str, **asked: str) -> str:
    """``spots``: id, place, w of every stem that counts; ``asked``: part, place, w of the query's."""
    words = "regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')"
    query = ", ".join(f"('{part}', '{text}')" for part, text in asked.items())
    stops = ", ".join(f"'{w}'" for w in STOP_WORDS)
    return f"""
texts AS ({source}),
spread AS (SELECT id, unnest({words}) AS word, generate_subscripts({words}, 1) AS place FROM texts),
query AS (SELECT part, unnest({words}) AS word, generate_subscripts({words}, 1) AS place FROM (VALUES {query}) q(part, text)),
lexicon AS (SELECT DISTINCT word FROM (SELECT word FROM spread UNION ALL SELECT word FROM query) WHERE word NOT IN ({stops})),
{stems_sql("lexicon")},
spots AS (SELECT id, place, w FROM spread JOIN stems USING (word)),
asked AS (SELECT part, place, w FROM query JOIN stems USING (word)),
held AS (SELECT id, list(DISTINCT w) AS ws FROM spots GROUP BY id)"""


_HEADS = f"SELECT page_id AS id, concat_ws(' ', {TITLE_SQL}, {PARAGRAPH_SQL}) AS text FROM pages"


def _part(name: str) -> str:
    return f"coalesce((SELECT list(DISTINCT w) FROM asked WHERE part = '{name}'), [])"


SQL = {
    "fulltext_boolean": f"""WITH {_postings_sql(_HEADS, **ASKED)}
SELECT id AS page_id, len(list_intersect(ws, (SELECT list(DISTINCT w) FROM asked)))::INTEGER AS n_terms FROM held
WHERE list_has_all(ws, {_part('all')}) AND list_has_any(ws, {_part('any')}) AND NOT list_has_any(ws, {_part('none')})""",
    "fulltext_phrase": f"""WITH {_postings_sql(_HEADS, phrase=PHRASE)},
first AS (SELECT min(place) AS place FROM asked)
SELECT DISTINCT id AS page_id FROM (
  SELECT s.id, s.place - asked.place + first.place AS start FROM spots s JOIN asked USING (w), first
  GROUP BY ALL HAVING count(DISTINCT asked.place) = (SELECT count(*) FROM asked))""",
    "fulltext_ranked": f"""WITH {_postings_sql(_HEADS, any=WEIGHED)},
tf AS (SELECT id, w, count(*) AS n FROM spots WHERE w IN (SELECT w FROM asked) GROUP BY id, w),
df AS (SELECT w, count(*) AS holding FROM tf GROUP BY w)
SELECT id AS page_id, round(sum(ln(1 + (SELECT count(*) FROM texts) / holding) * n / (n + 1)), 6) AS score
FROM tf JOIN df USING (w) GROUP BY id""",
    "contains_filter": f"""WITH {TC.hits_sql(TC.RICH_TEXT_SQL, 'page_id', TC.SAMPLE_TOPICS)}
SELECT page_id, page_id % 7 = 3 AS has_k3,
  page_id IN (SELECT page_id FROM chosen WHERE topic = 'pairs') AS has_pairs FROM pages""",
    "fulltext_all": f"""SELECT page_id, title FROM (SELECT page_id, {TITLE_SQL} AS title, {PARAGRAPH_SQL} AS d FROM pages)
WHERE list_has_all(regexp_extract_all(lower(title || ' ' || d), '[\\p{{L}}\\p{{N}}_]+'), ['the', 'of'])""",
    "fulltext_any": """SELECT doc_id FROM documents
WHERE list_has_any(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+'), ['thorreou', 'nicht', 'zwei'])""",
    "trigram": _similar_sql("benchmark", "item_id", "text", 0.1),
    "trigram_titles": _similar_sql("pages", "page_id", TITLE_SQL, 0.15),
    "trigram_join": f"""
WITH texts AS (
  SELECT 'l' AS side, text, min(item_id) AS first, count(*) AS copies FROM benchmark GROUP BY text
  UNION ALL SELECT 'r', head, min(id), count(*) FROM (
    SELECT 2 * page_id + 1 AS id, {PARAGRAPH_SQL} AS head FROM pages UNION ALL SELECT 2 * page_id, {TITLE_SQL} FROM pages) GROUP BY head),
w AS (SELECT side, text, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+')) AS w FROM texts),
g AS (SELECT DISTINCT side, text, substr('  ' || w || ' ', i, 3) AS g FROM w, range(1, 400) r(i) WHERE i <= length(w) + 1),
n AS (SELECT side, text, count(*) AS n FROM g GROUP BY ALL),
c AS (SELECT a.text AS l, b.text AS r, count(*) AS c FROM g a JOIN g b ON a.g = b.g AND a.side = 'l' AND b.side = 'r' GROUP BY ALL)
SELECT tl.first AS item_id, r AS head, tr.first AS first_id, tl.copies * tr.copies AS pairs, round(c / (nl.n + nr.n - c), 6) AS similarity
FROM c JOIN n nl ON nl.side = 'l' AND nl.text = l JOIN n nr ON nr.side = 'r' AND nr.text = r
JOIN texts tl ON tl.side = 'l' AND tl.text = l JOIN texts tr ON tr.side = 'r' AND tr.text = r
WHERE c / (nl.n + nr.n - c) >= 0.2""",
    "dup_content": """SELECT sha256(text) AS content_hash, count(*) AS copies, min(doc_id) AS first_id
FROM documents GROUP BY 1 HAVING count(*) > 1""",
}
