from __future__ import annotations

import random

import numpy as np
import pytest

from pagemill.llm import hyperminhash as H
from pagemill.llm.links import components
from tests.llm.helpers import awkward, clashing, documents, nothing, rows


def plain(texts, k, percent):
    """Component of each text by comparing all pairs of shingle sets."""
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        n = min(k, len(w))
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set())
    label = list(range(len(texts)))
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if a and b and 100 * len(a & b) >= percent * len(a | b) and label[i] != label[j]:
                    label[i] = label[j] = min(label[i], label[j])
                    changed = True
    return [(i, len(s), label[i], label[i] == i) for i, s in enumerate(sets)]


def some_texts():
    r = random.Random(5)
    texts = []
    for _ in range(25):
        base = [f"w{r.randrange(400)}" for _ in range(r.choice([3, 4, 5, 8, 30, 120]))]
        texts.append(" ".join(base))
        for _ in range(r.randrange(4)):
            copy = list(base)
            for _ in range(r.randrange(1 + len(base) // 12)):
                copy[r.randrange(len(copy))] = "x"
            texts.append(" ".join(copy).upper() if r.random() < 0.3 else " ".join(copy))
    # A chain whose ends are unlike.
    chain = [f"c{i}" for i in range(60)]
    for i in range(8):
        texts.append(" ".join(chain[3 * i :] + [f"d{j}" for j in range(3 * i)]))
    return texts + ["", None, "  "]


@pytest.mark.parametrize("k,percent", [(4, 80), (5, 80)])
def test_components_match_all_pairs(spark, k, percent):
    texts = some_texts()
    found = H.near_duplicates(documents(spark, texts), k, percent)
    assert rows(found, "doc_id", "n_shingles", "component_id", "kept") == sorted(plain(texts, k, percent), key=repr)


def test_awkward_rows(spark):
    docs = awkward(spark)
    found = H.near_duplicates(clashing(docs)).collect()
    by_id = {r["doc_id"]: r for r in found}
    assert len(found) == docs.count()
    assert by_id[5]["component_id"] == 4 and not by_id[5]["kept"] and by_id[4]["kept"]
    assert by_id[2]["n_shingles"] == by_id[3]["n_shingles"] == by_id[6]["n_shingles"] == 0
    assert by_id[2]["component_id"] == 2 and by_id[2]["kept"]
    assert by_id[None]["component_id"] == 1 and not by_id[None]["kept"]
    assert H.near_duplicates(nothing(spark)).count() == 0


def test_estimates_are_near_the_truth():
    r = np.random.default_rng(3)
    pool = r.integers(0, 1 << 64, 4000, dtype=np.uint64)
    a, b = np.unique(pool[:3200]), np.unique(pool[800:])
    sketches = [H.registers(s).reshape(1, -1) for s in (a, b)]
    true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    guess = H.estimate(*sketches, np.array([len(a)]), np.array([len(b)]))[0]
    assert abs(guess - true) < 0.15


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(7, i) for i in range(8, 60)] + [(3, 3)]
    found = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert {found[i] for i in range(100, 141)} == {100} and {found[i] for i in range(7, 60)} == {7}
    assert 3 not in found


@pytest.mark.parametrize("m", [1, 2, 5, 10, 50])
def test_recall_at_the_bound(m):
    """Pairs of sets of exactly 80 %: they meet in a band, and the estimate drops none of them."""
    r = np.random.default_rng(m)
    width, missed, sketches = H.ROWS, 0, []
    for _ in range(300):
        own = r.integers(0, 1 << 64, 10 * m, np.uint64)  # 8m in common, m more on each side
        a, b = (H.registers(np.sort(part)) for part in (own[: 9 * m], np.concatenate([own[: 8 * m], own[9 * m :]])))
        missed += not (a.reshape(-1, width) == b.reshape(-1, width)).all(axis=1).any()
        sketches.append((a, b))
    left, right = (np.array(side) for side in zip(*sketches, strict=True))
    sizes = np.full(300, 9.0 * m)
    error = np.sqrt(0.8 * 0.2 / np.minimum(H.BUCKETS, sizes))
    assert missed == 0 and (H.estimate(left, right, sizes, sizes) >= 0.8 - H.STANDARD_ERRORS * error).all()
