"""Keyword topics: dictionaries, whole-word matching, scores, URL patterns.

Two shapes of the same rules. ``match_keywords`` / ``score_topics`` /
``select_topics`` work on tables of texts as joins and grouped aggregates and
take dictionaries of any size. ``topics_of`` is one column expression without a
shuffle, for page rows that also carry wide columns and for streams.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagemill import schemas as S
from pagemill.functions import text as X
from pagemill.plans.unnest import unnest

# Topics with their keywords.
TOPIC_KEYWORDS = {
    "technology": [
        "software", "technology", "computer", "programming", "code", "development",
        "api", "database", "server", "cloud", "ai", "artificial intelligence",
        "machine learning", "algorithm", "data", "analytics", "digital",
    ],
    "business": [
        "business", "company", "corporate", "enterprise", "startup", "entrepreneur",
        "marketing", "sales", "revenue", "profit", "investment", "finance",
        "strategy", "management", "leadership", "market", "customer",
    ],
    "ecommerce": [
        "shop", "buy", "purchase", "product", "cart", "checkout", "payment",
        "shipping", "delivery", "order", "price", "discount", "sale",
        "retail", "store", "marketplace", "amazon", "ebay",
    ],
    "news": [
        "news", "breaking", "report", "journalist", "article", "story",
        "update", "latest", "headline", "media", "press", "newspaper",
        "magazine", "broadcast", "coverage",
    ],
    "health": [
        "health", "medical", "doctor", "hospital", "medicine", "treatment",
        "patient", "disease", "symptoms", "diagnosis", "therapy", "wellness",
        "fitness", "nutrition", "diet", "exercise",
    ],
    "education": [
        "education", "school", "university", "college", "student", "teacher",
        "course", "learning", "study", "academic", "research", "science",
        "knowledge", "training", "tutorial", "lesson",
    ],
    "entertainment": [
        "movie", "film", "music", "game", "entertainment", "celebrity",
        "actor", "actress", "director", "album", "song", "concert",
        "theater", "show", "television", "streaming",
    ],
    "sports": [
        "sports", "football", "basketball", "baseball", "soccer", "tennis",
        "golf", "hockey", "athlete", "team", "game", "match", "championship",
        "league", "tournament", "olympics",
    ],
    "travel": [
        "travel", "vacation", "hotel", "flight", "destination", "tourism",
        "trip", "journey", "adventure", "booking", "resort", "restaurant",
        "attractions", "sightseeing", "guide",
    ],
    "food": [
        "food", "recipe", "cooking", "restaurant", "cuisine", "dish",
        "meal", "ingredients", "chef", "kitchen", "dining", "menu",
        "taste", "flavor", "nutrition", "diet",
    ],
    "lifestyle": [
        "lifestyle", "fashion", "beauty", "home", "family", "relationship",
        "parenting", "wedding", "personal", "advice", "tips", "guide",
        "culture", "society", "community",
    ],
    "finance": [
        "finance", "money", "investment", "stock", "market", "trading",
        "banking", "loan", "credit", "debt", "insurance", "retirement",
        "savings", "budget", "economic", "currency",
    ],
}

# Topics with their URL patterns, first match wins.
URL_PATTERNS = {
    "ecommerce": ["/shop", "/buy", "/product", "/cart", "/checkout", "amazon.com", "ebay.com"],
    "news": ["/news", "/article", "/story", "cnn.com", "bbc.com", "reuters.com"],
    "technology": ["/tech", "/software", "/api", "/docs", "github.com", "stackoverflow.com"],
    "business": ["/business", "/company", "/corporate", "/enterprise"],
    "education": ["/education", "/course", "/learn", "/tutorial", "edu"],
    "entertainment": ["/entertainment", "/movie", "/music", "/game"],
    "sports": ["/sports", "/football", "/basketball", "espn.com"],
    "travel": ["/travel", "/hotel", "/flight", "/vacation", "booking.com"],
    "food": ["/food", "/recipe", "/restaurant", "/cooking"],
    "health": ["/health", "/medical", "/doctor", "/hospital"],
}

Dictionary = Mapping[str, Sequence[str]]


#: Hits folded at a time when hits of a topic may overlap.
FOLD = 512


def overlapping(words: Sequence[str]) -> bool:
    """Whether two of a topic's terms, or a term and itself, can meet in a text: they share a word."""
    parts = [part for word in words for part in word.split(" ")]
    return len(set(parts)) < len(parts)


def dictionary_table(spark: SparkSession, topics: Dictionary) -> DataFrame:
    rows = [
        (topic, place, word, len(words), nth, 2 * len(word.split(" ")) - 1, overlapping(words))
        for place, (topic, words) in enumerate(topics.items())
        for nth, word in enumerate(words)
    ]
    return spark.createDataFrame(
        rows, "topic string, topic_ord int, term string, n_keywords int, nth int, width int, overlaps boolean"
    )


def leftmost(hits: Column) -> Column:
    """The hits that a scan from left to right finds, of ``array<struct<pos, nth, width, term>>`` in order.

    At a position the term listed first wins, and the scan goes on behind it. The
    fold keeps its lists short: slices of ``FOLD`` hits, then one list of slices.
    """

    def take(state: Column, hit: Column, value: Column) -> Column:
        free = hit["pos"] >= state["free"]
        return F.struct(
            F.when(free, hit["pos"] + hit["width"]).otherwise(state["free"]).alias("free"),
            F.when(free, F.concat(state["kept"], value)).otherwise(state["kept"]).alias("kept"),
        )

    def over(given: Column) -> Column:
        none = F.filter(given, lambda h: F.lit(False))

        def fold(state: Column, first: Column) -> Column:
            begin = F.struct(state["free"].alias("free"), none.alias("kept"))
            part = F.aggregate(F.slice(given, first, F.lit(FOLD)), begin, lambda s, h: take(s, h, F.array(h)))
            return X.let(part, lambda p: F.struct(
                p["free"].alias("free"), F.concat(state["kept"], F.array(p["kept"])).alias("kept")
            ))

        firsts = F.when(F.size(given) > 0, F.sequence(F.lit(1), F.size(given), F.lit(FOLD))).otherwise(
            F.array().cast("array<int>")
        )
        empty = F.struct(F.lit(0).alias("free"), F.filter(F.array(none), lambda k: F.lit(False)).alias("kept"))
        return F.aggregate(firsts, empty, fold, lambda s: F.flatten(s["kept"]))

    return X.let(hits, over)


def classification_text(title: Column, description: Column, keywords: Column, body: Column) -> Column:
    """Non-empty parts joined by one blank."""
    parts = [title, description, F.array_join(keywords, " "), body]
    return F.concat_ws(" ", *[X.blank_to_null(p) for p in parts])


def term_hits(text: Column, topics: Dictionary) -> Column:
    """``array<struct<pos, term>>``: every whole-word occurrence of a dictionary term.

    Words and the gaps between them alternate in the token array, so a phrase
    matches only with exactly its own single blanks in between.
    """
    terms = sorted({w for words in topics.values() for w in words})
    singles = [t for t in terms if " " not in t]
    hits = []

    def over(tokens: Column) -> Column:
        found = [
            F.transform(
                tokens,
                lambda t, i: F.when(t.isin(singles), F.struct(i.alias("pos"), t.alias("term"))),
            )
        ]
        for length in sorted({len(t.split(" ")) for t in terms if " " in t}):
            phrases = [t for t in terms if len(t.split(" ")) == length]
            heads = sorted({p.split(" ")[0] for p in phrases})

            def phrase_at(t: Column, i: Column) -> Column:
                # Single element reads; slicing would copy the token array for every word.
                phrase = F.concat(t, *[F.get(tokens, i + step) for step in range(1, 2 * length - 1)])
                return F.when(
                    t.isin(heads),
                    X.let(phrase, lambda p: F.when(
                        p.isin(phrases), F.struct(i.alias("pos"), p.alias("term"))
                    )),
                )

            found.append(F.transform(tokens, phrase_at))
        return F.filter(F.concat(*found), lambda h: h.isNotNull())

    return X.let(F.regexp_extract_all(F.lower(text), F.lit(X.WORD_OR_GAP), F.lit(0)), over)


def scanned_hits(hits: Column, topics: Dictionary) -> Column:
    """``array<struct<pos, term, _topic>>`` of topics whose terms share words: what a scan from the left finds of each."""
    entries = F.array(*[
        F.struct(F.lit(topic).alias("topic"), F.split(F.lit("\n".join(words)), "\n").alias("words"))
        for topic, words in topics.items()
    ])

    def of_topic(entry: Column, given: Column, terms: Column) -> Column:
        # Membership is settled once per distinct term of the text.
        own = X.let(F.array_intersect(entry["words"], terms), lambda held: F.filter(given, lambda h: F.array_contains(held, h["term"])))
        placed = F.transform(own, lambda h: F.struct(
            h["pos"].alias("pos"), F.array_position(entry["words"], h["term"]).alias("nth"),
            (2 * F.size(F.split(h["term"], " ")) - 1).alias("width"), h["term"].alias("term"),
        ))
        return F.transform(
            leftmost(F.array_sort(placed)),
            lambda h: F.struct(h["pos"].alias("pos"), h["term"].alias("term"), entry["topic"].alias("_topic")),
        )

    def over(given: Column) -> Column:
        terms = F.array_distinct(F.transform(given, lambda h: h["term"]))
        return X.let(terms, lambda t: F.flatten(F.transform(entries, lambda e: of_topic(e, given, t))))

    return X.let(hits, over)


def match_keywords(texts: DataFrame, key: str, topics: Dictionary = TOPIC_KEYWORDS) -> DataFrame:
    """(key, topic, keyword) with hits, first position and the text's chunk count.

    Tokens are tested against the term set in the row, so only hits are exploded
    and joined to the dictionary; their counts are combined before the shuffle.
    Where a topic's terms share words, the hits of one text and topic are put in
    order in the row and scanned from the left; other topics are counted as they come.
    The dictionary, whose terms stand in the plan anyway, goes to every task: hits meet
    by key alone.
    """
    table = dictionary_table(texts.sparkSession, topics)
    mixed = {topic: words for topic, words in topics.items() if overlapping(words)}
    hits = term_hits(F.col("text"), topics)
    found = texts.select(
        key, X.count_chunks(F.col("text")).alias("n_chunks"),
        (X.let(hits, lambda h: F.struct(h.alias("all"), scanned_hits(h, mixed).alias("scanned"))) if mixed else F.struct(hits.alias("all"))).alias("_hits"),
    )
    if mixed:
        # One array, exploded once: hits as they come, and those a scan has placed in a topic.
        entry = F.transform("_hits.all", lambda h: F.struct(h["pos"].alias("pos"), h["term"].alias("term"), F.lit(None).cast("string").alias("_topic")))
        found = found.select(key, "n_chunks", F.concat(entry, "_hits.scanned").alias("hits"))
        table = table.withColumn("_topic", F.when(F.col("overlaps"), F.col("topic")))
        held = unnest(found, "hits", key, "n_chunks").select(key, "n_chunks", "item.pos", "item.term", "item._topic")
        apart = held.alias("h").join(
            F.broadcast(table.withColumnRenamed("term", "_term").withColumnRenamed("_topic", "_of")).alias("t"),
            (F.col("term") == F.col("_term")) & F.col("_topic").eqNullSafe(F.col("_of")),
        )
    else:
        found = found.select(key, "n_chunks", F.col("_hits.all").alias("hits"))
        apart = unnest(found, "hits", key, "n_chunks").select(key, "n_chunks", "item.pos", "item.term").join(F.broadcast(table), "term")
    return apart.groupBy(key, "topic", "topic_ord", "n_keywords", "n_chunks", F.col("term").alias("keyword")).agg(
        F.count(F.lit(1)).alias("hits"), F.min("pos").alias("first_pos")
    )


def topic_score(unique: Column, total: Column, chunks: Column, size: Column | int) -> Column:
    """Share of the topic's keywords, plus capped frequency and diversity boosts."""
    return (
        unique / size
        + F.least(total / chunks * 100, F.lit(0.5))
        + F.least(unique / 10, F.lit(0.3))
    )


def score_topics(matches: DataFrame, key: str) -> DataFrame:
    return (
        matches.groupBy(key, "topic", "topic_ord", "n_keywords", "n_chunks")
        .agg(F.sum("hits").alias("hits"), F.count(F.lit(1)).alias("distinct_keywords"))
        .withColumn(
            "score",
            topic_score(F.col("distinct_keywords"), F.col("hits"), F.col("n_chunks"), F.col("n_keywords")),
        )
        .drop("n_keywords", "n_chunks")
    )


def select_topics(
    scores: DataFrame, key: str, floor: float = S.MIN_TOPIC_CONFIDENCE, limit: int | None = None
) -> DataFrame:
    """Topics at or above ``floor`` ranked by capped confidence, ties in dictionary order; the first ``limit`` if given."""
    kept = scores.filter(F.col("score") >= floor).withColumn(
        "confidence", F.least(F.col("score"), F.lit(1.0))
    )
    order = Window.partitionBy(key).orderBy(F.desc("confidence"), "topic_ord")
    ranked = kept.withColumn("rank", F.row_number().over(order))
    return ranked if limit is None else ranked.filter(F.col("rank") <= limit)


def top_keywords(matches: DataFrame, key: str, limit: int = S.TOPIC_KEYWORDS) -> DataFrame:
    """Most frequent keywords of each (key, topic), ties by first appearance."""
    order = Window.partitionBy(key, "topic").orderBy(F.desc("hits"), "first_pos")
    return (
        matches.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= limit)
        .select(key, "topic", "keyword", "hits", "rank")
    )


def topics_of(
    text: Column,
    topics: Dictionary = TOPIC_KEYWORDS,
    floor: float = S.MIN_TOPIC_CONFIDENCE,
    limit: int | None = None,
) -> Column:
    """Selected topics of one text as ``array<struct<topic, confidence, keywords>>``."""
    mixed = any(map(overlapping, topics.values()))
    entries = F.array(*[
        F.struct(
            F.lit(overlapping(words)).alias("overlaps"),
            F.lit(place).alias("ord"),
            F.lit(topic).alias("topic"),
            F.split(F.lit("\n".join(words)), "\n").alias("words"),
        )
        for place, (topic, words) in enumerate(topics.items())
    ])

    def frequent(hits: Column) -> Column:
        counted = F.transform(
            F.array_distinct(F.transform(hits, lambda h: h["term"])),
            lambda term: X.let(
                F.filter(hits, lambda h: h["term"] == term),
                lambda own: F.struct(
                    (-F.size(own)).alias("n"),
                    F.array_min(F.transform(own, lambda h: h["pos"])).alias("pos"),
                    term.alias("term"),
                ),
            ),
        )
        return F.array_sort(counted)

    def of_topic(entry: Column, hits: Column) -> Column:
        own = F.filter(hits, lambda h: F.array_contains(entry["words"], h["term"]))
        if not mixed:
            return own
        placed = F.transform(own, lambda h: F.struct(
            h["pos"].alias("pos"), F.array_position(entry["words"], h["term"]).alias("nth"),
            (2 * F.size(F.split(h["term"], " ")) - 1).alias("width"), h["term"].alias("term"),
        ))
        scanned = F.transform(
            leftmost(F.array_sort(placed)), lambda h: F.struct(h["pos"].alias("pos"), h["term"].alias("term"))
        )
        return F.when(entry["overlaps"], scanned).otherwise(own)

    def judged(entry: Column, own: Column, chunks: Column) -> Column:
        ranked = frequent(own)
        score = topic_score(F.size(ranked), F.size(own), chunks, F.size(entry["words"]))
        return F.when(
            F.size(own) > 0,
            F.struct(
                (-F.least(score, F.lit(1.0))).alias("down"),
                entry["ord"].alias("ord"),
                score.alias("score"),
                entry["topic"].alias("topic"),
                F.transform(F.slice(ranked, 1, S.TOPIC_KEYWORDS), lambda r: r["term"]).alias("keywords"),
            ),
        )

    def all_topics(t: Column) -> Column:
        scored = F.transform(
            entries,
            lambda e: X.let(of_topic(e, t["hits"]), lambda own: judged(e, own, t["chunks"])),
        )
        kept = F.filter(scored, lambda s: s["score"] >= floor)
        ranked = F.array_sort(kept)
        return F.transform(
            ranked if limit is None else F.slice(ranked, 1, limit),
            lambda s: F.struct(
                s["topic"].alias("topic"), (-s["down"]).alias("confidence"), s["keywords"].alias("keywords")
            ),
        )

    return X.let(
        X.let(
            text,
            lambda t: F.struct(
                X.count_chunks(t).alias("chunks"), term_hits(t, topics).alias("hits")
            ),
        ),
        all_topics,
    )


def url_topics_of(url: Column, patterns: Dictionary = URL_PATTERNS) -> Column:
    """Topics whose patterns occur in the URL: ``array<struct<topic, topic_ord, confidence, keyword>>``."""

    def entry(low: Column, place: int, topic: str, words: Sequence[str]) -> Column:
        first = F.coalesce(*[F.when(F.contains(low, F.lit(w)), F.lit(w.strip("/"))) for w in words])
        return F.when(
            first.isNotNull(),
            F.struct(
                F.lit(topic).alias("topic"),
                F.lit(place).alias("topic_ord"),
                F.lit(S.URL_TOPIC_CONFIDENCE).alias("confidence"),
                first.alias("keyword"),
            ),
        )

    return X.let(
        F.lower(url),
        lambda low: F.filter(
            F.array(*[entry(low, i, t, w) for i, (t, w) in enumerate(patterns.items())]),
            lambda m: m.isNotNull(),
        ),
    )


def classify_urls(pages: DataFrame, key: str, patterns: Dictionary = URL_PATTERNS) -> DataFrame:
    return pages.select(key, F.inline(url_topics_of(F.col("url"), patterns)))


def merge_url_topics(
    content: DataFrame, by_url: DataFrame, key: str, limit: int | None = None
) -> DataFrame:
    """Boost topics found by content and URL, add those found by URL only, rank again.

    Ties keep content topics first, each side in its own order. A topic keeps the
    ``keywords`` its content gave it; one found by URL only has the pattern that matched.
    """
    left = content.select(
        key, "topic", F.col("confidence").alias("by_content"), F.col("rank").alias("place"), F.col("keywords").alias("own")
    )
    right = by_url.select(key, "topic", F.col("confidence").alias("by_url"), "topic_ord", F.array("keyword").alias("matched"))
    merged = left.join(right, [key, "topic"], "full_outer").withColumn(
        "confidence",
        F.when(F.col("by_content").isNull(), F.col("by_url"))
        .when(F.col("by_url").isNull(), F.col("by_content"))
        .otherwise(F.least(F.col("by_content") + S.URL_TOPIC_BOOST, F.lit(1.0))),
    )
    order = Window.partitionBy(key).orderBy(
        F.desc("confidence"), F.col("by_content").isNull(), "place", "topic_ord"
    )
    ranked = merged.withColumn("rank", F.row_number().over(order)).select(
        key, "topic", "confidence", F.when(F.col("by_content").isNull(), F.col("matched")).otherwise(F.col("own")).alias("keywords"), "rank"
    )
    return ranked if limit is None else ranked.filter(F.col("rank") <= limit)


def keyword_lists(matches: DataFrame, key: str, limit: int = S.TOPIC_KEYWORDS) -> DataFrame:
    """``keywords`` of each (key, topic), most frequent first."""
    best = top_keywords(matches, key, limit)
    return best.groupBy(key, "topic").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "keyword"))), lambda k: k["keyword"]).alias("keywords")
    )


def topics_detected(metadata: DataFrame) -> DataFrame:
    """Pages per topic, from a ``topics`` array column."""
    return (
        unnest(metadata, "topics.topic", item="topic")
        .groupBy("topic")
        .agg(F.count(F.lit(1)).alias("pages"))
    )
