from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from pagemill.llm import dual_tree as D
from tests.llm.helpers import awkward, clashing, documents, nothing, rows

TERM = re.compile("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_ranking(docs, items, k):
    """Every score by its definition. ``docs`` and ``items`` are pairs of id and text."""
    counted = [(i, Counter(terms(t))) for i, t in docs if terms(t)]
    n_docs, total = len(counted), sum(sum(c.values()) for _, c in counted)
    held = Counter(t for _, c in counted for t in c)
    weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1))) for t, n in held.items()}
    out = []
    for item, text in items:
        scored = []
        for doc, c in counted:
            m = 25 + 75 * sum(c.values()) * n_docs // total
            score = sum(weight[t] * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in terms(text) if t in c)
            if score > 0:
                scored.append((-score, doc is None, doc))
        out += [(item, rank, doc, -s) for rank, (s, _, doc) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return sorted(out, key=repr)


def items_table(spark, items):
    return spark.createDataFrame(items, "item_id long, text string")


def texts(seed, count, words):
    r = random.Random(seed)
    return [" ".join(r.choices(words, [1 / (i + 1) for i in range(len(words))], k=r.choice([1, 4, 30, 200]))) for _ in range(count)]


def test_terms_are_the_maximal_runs():
    r = random.Random(1)
    for _ in range(3000):
        text = "".join(r.choices("aZ09 _-.\té 日\x7f\x00{`[@:/", k=r.randrange(40)))
        assert [t.decode() for t in D.terms_of(text.encode())] == terms(text)


def test_equals_the_plain_ranking(spark, monkeypatch):
    monkeypatch.setattr(D, "HELD", 50)
    words = [f"w{i}" for i in range(300)]
    docs = texts(2, 1500, words) + ["W1 w2, w3!"] * 40 + [None, "", " .. "]
    items = list(enumerate(texts(3, 60, words)))
    table = documents(spark, docs).repartition(5)
    found = rows(D.top_documents(table, items_table(spark, items), 7), "item_id", "rank", "doc_id", "score")
    assert found == plain_ranking(list(enumerate(docs)), items, 7)


def test_ties_go_to_the_smaller_id_across_tasks(spark):
    table = documents(spark, ["same words here"] * 900 + ["other"] * 900, ids=list(range(1800, 0, -1))).repartition(7)
    found = D.top_documents(table, items_table(spark, [(5, "same same HERE")]), 10).orderBy("rank").collect()
    assert [r["doc_id"] for r in found] == list(range(901, 911)) and len({r["score"] for r in found}) == 1


def test_groups_of_items_give_the_same_result(spark, monkeypatch):
    words = [f"w{i}" for i in range(80)]
    docs, items = texts(4, 300, words), list(enumerate(texts(5, 30, words)))
    once = rows(D.top_documents(documents(spark, docs), items_table(spark, items), 5))
    monkeypatch.setattr(D, "GROUP_BYTES", 3000)
    assert rows(D.top_documents(documents(spark, docs), items_table(spark, items), 5)) == once


def test_awkward_rows(spark):
    docs = clashing(awkward(spark))
    items = [(1, "one two w5"), (1, "one two w5"), (2, None), (3, ""), (4, "é" * 300), (None, "seven"), (6, "unknown")]
    found = rows(D.top_documents(docs, items_table(spark, items).withColumn("score", F.lit(1)), 3), "item_id", "rank", "doc_id", "score")
    given = [(r["doc_id"], r["text"]) for r in awkward(spark).collect()]
    assert found == plain_ranking(given, sorted(set(items), key=repr), 3)
    assert [r[2] for r in found if r[0] is None] == [1, 1, None]
    assert D.top_documents(nothing(spark), items_table(spark, items)).count() == 0
    assert D.top_documents(docs, items_table(spark, [])).count() == 0
    assert D.top_documents(docs, items_table(spark, items)).columns == ["item_id", "rank", "doc_id", "score"]


def sparse(vectors):
    ends = np.concatenate([[0], np.cumsum([len(v) for v in vectors])]).astype(np.int64)
    flat = [e for v in vectors for e in sorted(v.items())]
    return D.Sparse(ends, np.array([c for c, _ in flat], np.int64), np.array([x for _, x in flat], np.int64))


def test_nodes_hold_the_maxima_and_bound_every_score():
    r = random.Random(6)
    vectors = [{r.randrange(40): r.randrange(1, 99) for _ in range(r.randrange(6))} for _ in range(150)]
    base, above = sparse(vectors), sparse(vectors).maxima(8, 40)
    for n in range(above.rows):
        want = Counter()
        for v in vectors[8 * n : 8 * n + 8]:
            want |= Counter(v)
        part = slice(above.ends[n], above.ends[n + 1])
        assert dict(zip(above.columns[part].tolist(), above.values[part].tolist(), strict=True)) == dict(want)
    dense = np.array([r.randrange(9) for _ in range(40)])
    some = np.array([3, 4, 77, 149])
    assert base.products(some, dense).tolist() == [sum(x * dense[c] for c, x in vectors[i].items()) for i in some]


def test_whole_batches_are_pruned_and_nothing_is_lost():
    """Documents of ten subjects: an item's documents are found without scoring the other subjects' batches."""
    r = random.Random(7)
    vectors = [{100 * (i % 10) + r.randrange(100): r.randrange(1, 1000) for _ in range(20)} for i in range(8192)]
    vectors.sort(key=lambda v: min(v) // 100)
    items = [{100 * (i % 10) + r.randrange(100): 1 for _ in range(12)} for i in range(40)]
    weights = np.ones(1000, np.int64)
    tree = D.ItemTree(items, weights)
    search = D.Search(tree, 10, np.zeros(40, np.int64))
    search.block(np.arange(8192), np.zeros(8192, bool), sparse(vectors))
    place, score, _, doc = search.settle()
    for i, item in enumerate(items):
        want = sorted((-sum(v.get(t, 0) for t in item), d) for d, v in enumerate(vectors))[:10]
        own = tree.order[place] == i
        assert sorted(zip((-score[own]).tolist(), doc[own].tolist(), strict=True)) == want
    assert search.scored < 40 * 8192 / 5
