from __future__ import annotations

import random
import re
from itertools import product

import pytest

from pagemill.operators import search as S


def grams(text):
    return {f"  {w} "[i : i + 3] for w in re.findall(r"[^\W_]+", (text or "").lower()) for i in range(len(w) + 1)}


def similar(a, b):
    a, b = grams(a), grams(b)
    return len(a & b) / len(a | b) if a | b else 0.0


def tables(spark):
    r = random.Random(4)
    words = ["spark", "sparks", "table", "tables", "joined", "join", "ünder", "query", "queries", "x"]
    made = [" ".join(r.choices(words, k=r.randrange(1, 6))) for _ in range(150)]
    left, right = [*made[:60], None, "", "!!"], [*made[40:], *["hot title here"] * 300, None, " "]
    return left, right


@pytest.mark.parametrize("small", [0, 2_000, S.SMALL_GRAMS])
def test_equals_all_pairs(spark, monkeypatch, small):
    monkeypatch.setattr(S, "SMALL_GRAMS", small)
    left, right = tables(spark)
    sets = [S.trigram_sets(spark.createDataFrame(list(enumerate(t)), "id long, t string"), "id", "t") for t in (left, right)]
    for floor in (0.3, 1.0):
        found = {(r["left_text"], r["right_text"]): r for r in S.trigram_join(*sets, floor).collect()}
        want = {(a, b): s for a, b in product(set(left) - {None}, set(right) - {None}) if (s := similar(a, b)) >= floor}
        assert {k: round(r["similarity"], 9) for k, r in found.items()} == {k: round(s, 9) for k, s in want.items()}
        for (a, b), r in found.items():
            assert (r["pairs"], r["left_first"], r["right_first"]) == (left.count(a) * right.count(b), left.index(a), right.index(b))


def test_few_pairs_are_compared_and_each_once(spark):
    r = random.Random(9)
    letters = "abcdefghijklmnopqrstuvwxyz"
    texts = ["the " + " ".join("".join(r.choices(letters, k=6)) for _ in range(4)) for _ in range(400)]
    sets = S.trigram_sets(spark.createDataFrame(list(enumerate(texts)), "id long, t string"), "id", "t")
    pairs = S.trigram_candidates(sets, sets, 0.6)
    assert pairs.count() == pairs.distinct().count() < 400 * 400 / 20


def test_empty_sides(spark):
    none = S.trigram_sets(spark.createDataFrame([], "id long, t string"), "id", "t")
    some = S.trigram_sets(spark.createDataFrame([(1, "abc")], "id long, t string"), "id", "t")
    assert S.trigram_join(none, some).count() == S.trigram_join(some, none).count() == 0
