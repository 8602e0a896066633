from __future__ import annotations

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from pagemill.operators import topics as T

SMALL = {
    "alpha": ["ai", "machine learning", "data", "été"],
    "beta": ["learning", "data", "game"],
    "gamma": ["game", "shop now"],
}
TEXTS = [
    "", "   ", "no hits here", "AI ai data", "machine learning machine learning", "machine  learning only",
    "machine-learning", "aié été data_x data", "game data game data learning", "shop now, shop\nnow shop now!",
    "data " * 60, "one two three four five six seven eight ai", "learning\u00a0data ai", "ai. data? game;",
    "maï ai 2ai ai2 _ai ai_", "machine learning game " + "x " * 300,
]


def by_regex(text, topics, floor=0.5):
    """The rules told with one alternation per topic."""
    low, words = text.lower(), len(text.split())
    picked = []
    for topic, keys in topics.items():
        hits = re.findall(r"\b(?:" + "|".join(map(re.escape, keys)) + r")\b", low) if words else []
        if hits:
            unique = len(set(hits))
            score = unique / len(keys) + min(len(hits) / words * 100, 0.5) + min(unique / 10, 0.3)
            if score >= floor:
                picked.append((topic, round(min(score, 1.0), 9), [k for k, _ in Counter(hits).most_common(5)]))
    return sorted(picked, key=lambda p: -p[1])[:10]


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "id int, text string")


@pytest.mark.parametrize("topics", [SMALL, T.TOPIC_KEYWORDS])
def test_row_form(texts, topics):
    found = texts.select("id", T.topics_of(F.col("text"), topics).alias("t")).collect()
    for r in found:
        assert [(t.topic, round(t.confidence, 9), list(t.keywords)) for t in r.t] == by_regex(TEXTS[r.id], topics)


def test_join_form_equals_row_form(texts):
    matches = T.match_keywords(texts, "id", SMALL)
    chosen = T.select_topics(T.score_topics(matches, "id"), "id")
    found = {(r.id, r.topic): (r["rank"], round(r.confidence, 9)) for r in chosen.collect()}
    rows = texts.select("id", F.posexplode(T.topics_of(F.col("text"), SMALL)).alias("p", "t")).collect()
    assert found == {(r.id, r.t.topic): (r.p + 1, round(r.t.confidence, 9)) for r in rows}
    words = {}
    for r in sorted(T.top_keywords(matches, "id").collect(), key=lambda r: r["rank"]):
        words.setdefault((r.id, r.topic), []).append(r.keyword)
    assert all(words[(r.id, r.t.topic)] == list(r.t.keywords) for r in rows)


def test_threshold_uses_the_uncapped_score(spark):
    one = {"t": [f"w{i}" for i in range(10)]}
    rows = spark.createDataFrame([(1, "w1 " + "x " * 332), (2, "w1 " + "x " * 333)], "id int, text string")
    sizes = {r.id: r.n for r in rows.select("id", F.size(T.topics_of(F.col("text"), one)).alias("n")).collect()}
    assert sizes == {1: 1, 2: 0}


OVERLAPS = {
    "cities": ["new york", "york", "new york city", "city of york", "city"],
    "order": ["b", "a b", "a", "b a b"],
    "self": ["x y x", "x"],
    "apart": ["data"],
}
MIXED_TEXTS = [
    "", "new york city of york", "York new york", "new  york city", "a b a b b a", "b a b a b", "x y x y x y x", "x x y x",
    "the data of new york city, a b", "new york new york city of york city " * 400, "x y " * 900,
]


def test_terms_that_share_words(spark):
    """Both forms, against one alternation per topic."""
    table = spark.createDataFrame(list(enumerate(MIXED_TEXTS)), "id int, text string")
    rows = table.select("id", T.topics_of(F.col("text"), OVERLAPS).alias("t")).collect()
    for r in rows:
        assert [(t.topic, round(t.confidence, 9), list(t.keywords)) for t in r.t] == by_regex(MIXED_TEXTS[r.id], OVERLAPS)
    counted = {(r.id, r.topic, r.keyword): r.hits for r in T.match_keywords(table, "id", OVERLAPS).collect()}
    want = Counter()
    for n, text in enumerate(MIXED_TEXTS):
        for topic, words in OVERLAPS.items():
            hits = re.findall(r"\b(?:" + "|".join(words) + r")\b", text.lower())
            want.update((n, topic, h) for h in hits)
    assert counted == dict(want)


def test_repeated_keys_are_scanned_text_by_text(spark):
    table = spark.createDataFrame([(1, "new york"), (1, "york city"), (None, "city")], "id int, text string")
    found = {(r.id, r.keyword): r.hits for r in T.match_keywords(table, "id", OVERLAPS).collect()}
    assert found == {(1, "new york"): 1, (1, "york"): 1, (1, "city"): 1, (None, "city"): 1}


def test_topics_of_separate_words_are_not_scanned(spark):
    table = spark.createDataFrame([(1, "ai data")], "id int, text string")
    plan = T.match_keywords(table, "id", T.TOPIC_KEYWORDS)._jdf.queryExecution().toString()
    assert "collect_list" not in plan and not any(map(T.overlapping, T.TOPIC_KEYWORDS.values()))



def test_dictionary_sizes():
    assert [len(v) for v in T.TOPIC_KEYWORDS.values()] == [17, 17, 18, 15, 16, 16, 16, 16, 15, 16, 15, 16]
    assert sum(len(v) for v in T.URL_PATTERNS.values()) == 49


def test_url_topics(spark):
    urls = {
        "http://SHOP.example/Shop/buy": [("ecommerce", "shop")],
        "http://x.edu/": [("education", "edu")],
        "https://github.com/docs": [("technology", "docs")],
        "http://plain.example/": [],
        "http://h/news/music": [("news", "news"), ("entertainment", "music")],
    }
    rows = spark.createDataFrame([(u,) for u in urls], "url string")
    for r in rows.select("url", T.url_topics_of(F.col("url")).alias("t")).collect():
        assert [(t.topic, t.keyword) for t in r.t] == urls[r.url]


def test_merge(spark):
    content = spark.createDataFrame(
        [(1, "news", 0.95, 1, ["n"]), (1, "food", 0.6, 2, ["f"]), (2, "food", 0.7, 1, ["g"])],
        "id int, topic string, confidence double, rank int, keywords array<string>",
    )
    by_url = spark.createDataFrame(
        [(1, "news", 0.7, 1, "u"), (1, "sports", 0.7, 6, "s"), (2, "business", 0.7, 3, "b"), (3, "news", 0.7, 1, "u")],
        "id int, topic string, confidence double, topic_ord int, keyword string",
    )
    found = T.merge_url_topics(content, by_url, "id").collect()
    assert sorted((r.id, r["rank"], *r.keywords) for r in found) == [
        (1, 1, "n"), (1, 2, "s"), (1, 3, "f"), (2, 1, "g"), (2, 2, "b"), (3, 1, "u"),
    ]
    assert len(T.merge_url_topics(content, by_url, "id", limit=1).collect()) == 3
    rows = sorted((r.id, r["rank"], r.topic, round(r.confidence, 3)) for r in found)
    assert rows == [
        (1, 1, "news", 1.0), (1, 2, "sports", 0.7), (1, 3, "food", 0.6), (2, 1, "food", 0.7), (2, 2, "business", 0.7),
        (3, 1, "news", 0.7),
    ]


def test_text_assembly(spark):
    row = spark.range(1).select(
        T.classification_text(F.lit(""), F.lit(None).cast("string"), F.array(F.lit("a"), F.lit("b")), F.lit("body")),
        T.classification_text(F.lit("t"), F.lit("d"), F.array().cast("array<string>"), F.lit("")),
    ).first()
    assert tuple(row) == ("a b body", "t d")


def test_terms_that_share_words_are_scanned_without_gathering_their_hits(spark):
    table = spark.createDataFrame(list(enumerate(MIXED_TEXTS)), "id int, text string")
    plan = T.match_keywords(table, "id", OVERLAPS)._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and "MapInArrow" not in plan
    assert plan.count("hashpartitioning") == 1
