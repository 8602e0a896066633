from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from pagemill.llm import va_file as V


def plain(vectors, k, scale, every):
    whole = []
    for i, v in vectors:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            whole.append((i, [int(np.floor(scale * float(np.float32(x)))) for x in v]))
    out = []
    for q, a in whole:
        if q % every == 0:
            scored = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), i) for i, b in whole if i != q and len(b) == len(a))
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:k])]
    return sorted(out)


def found(df):
    return sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in df.collect())


def table(spark, vectors):
    return spark.createDataFrame(vectors, "vec_id long, embedding array<float>").withColumn("cls", F.lit(1)).withColumn("low", F.lit(2))


def test_top_k_matches_plain(spark, monkeypatch):
    monkeypatch.setattr(V, "DATA_BLOCK", 64)
    monkeypatch.setattr(V, "QUERY_BLOCK", 8)
    r = np.random.default_rng(1)
    vectors = [(i, r.normal(size=6).tolist()) for i in range(300)]
    vectors += [(300 + i, vectors[5][1]) for i in range(120)]  # one vector many share
    vectors += [(1000, None), (1001, [None] * 6), (1002, [float("nan")] * 6), (1003, [float("inf")] * 6), (None, vectors[0][1])]
    vectors += [(1005, [1.0, 2.0]), (1010, [0.5, -1.0]), (1020, [0.0] * 6)]
    assert found(V.top_k(table(spark, vectors), F.col("vec_id") % 5 == 0, 7, 64)) == plain(vectors, 7, 64, 5)


def test_fewer_than_k_and_none(spark):
    few = [(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.0, 1.0])]
    assert found(V.top_k(table(spark, few), F.col("vec_id") == 0, 20, 64)) == [(0, 1, 1, 0), (0, 2, 2, 0)]
    assert V.top_k(table(spark, few).limit(0), F.col("vec_id") == 0, 20, 64).count() == 0
    assert V.top_k(table(spark, few), F.lit(False), 20, 64).count() == 0
