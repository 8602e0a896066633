"""Exact top-k search by inner product over a vector-approximation file.

Components are whole numbers, ``floor(scale * x)``. The file holds, per vector,
one byte per dimension: the number of the cell, of ``2 ** BITS`` even cells
between the dimension's least and greatest value, that the component lies in.

1. Scan. Queries meet the cells in bounded blocks, a block of each per task.
   A cell's corner gives a product that every vector in it exceeds by no more than
   the query's slack, so one product bounds the score from below and above. A
   vector whose upper bound is less than the k-th lower bound is out.
2. Read. The exact vectors of the most promising candidates are read in order of
   their bound; the k-th exact score so found decides which of the rest can still
   matter, and those are read too. Nothing that ties with the k-th is skipped.

Equal vectors form a class, scanned once; its k + 1 least ids are kept, as no
others can be among k results. So a vector that a third of all rows share costs
one row per block. Ties go to the smaller id. The number of candidates has no cap.

Vectors that are null or hold a null, infinite or undefined component take no part, nor
do rows without id. Vectors of another length than the query's are no candidates
of it. Rows that repeat an id are results of their own, except for queries of that
id. An empty table gives an empty result. Further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.plans.scratch import durable

BITS = 6
DATA_BLOCK, QUERY_BLOCK = 16_384, 2_048
#: Queries scored at a time inside a block.
STRIP = 256
FIRST_READ = 4


def whole_vectors(vectors: DataFrame, scale: int) -> DataFrame:
    """``vec_id, vec``: rows that take part, with components as whole numbers."""
    x = F.transform("embedding", lambda v: v.cast("double"))
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return vectors.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & fine).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda v: F.floor(v * scale)).alias("vec")
    )


def classes_of(points: DataFrame, k: int) -> DataFrame:
    """``cls, vec, ids``: distinct vectors with their ``k + 1`` least ids."""
    nth = F.row_number().over(Window.partitionBy("vec").orderBy("vec_id"))
    few = points.withColumn("nth", nth).filter(F.col("nth") <= k + 1)
    return durable(
        few.groupBy("vec").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
        .withColumn("cls", F.monotonically_increasing_id())
    )


def grid(classes: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """The most dimensions met, and each one's least value and cell width: two numbers per dimension."""
    d = classes.agg(F.max(F.size("vec"))).first()[0] or 0
    if not d:
        return 0, np.zeros(0), np.ones(0)
    at = [F.try_element_at("vec", F.lit(i + 1)) for i in range(d)]
    row = classes.agg(*[F.min(a).alias(f"lo{i}") for i, a in enumerate(at)], *[F.max(a).alias(f"hi{i}") for i, a in enumerate(at)]).first()
    lo = np.array([row[f"lo{i}"] for i in range(d)], float)
    hi = np.array([row[f"hi{i}"] for i in range(d)], float)
    return d, lo, np.ceil((hi - lo + 1) / (1 << BITS))


def _approximated(lo: np.ndarray, width: np.ndarray):
    def run(batches):
        for batch in batches:
            cells = []
            for vec in batch.column(1):
                v = np.array(vec.as_py(), float)
                n = len(v)
                cells.append(np.clip((v - lo[:n]) // width[:n], 0, (1 << BITS) - 1).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cells, pa.binary())], ["cls", "cells"])

    return run


def _scan(lo: np.ndarray, width: np.ndarray, k: int):
    """Candidates of a block of queries in a block of cells: ``query_id, qcls, cls, low, high``."""
    schema = pa.schema([("query_id", pa.int64()), ("qcls", pa.int64()), ("cls", pa.int64()), ("low", pa.float64()), ("high", pa.float64())])

    def run(queries: pa.Table, data: pa.Table) -> pa.Table:
        found = []
        by_length: dict[int, list[int]] = {}
        for i, c in enumerate(data.column("cells").to_pylist()):
            by_length.setdefault(len(c), []).append(i)
        vectors = queries.column("vec").to_pylist()
        q_by_length: dict[int, list[int]] = {}
        for i, v in enumerate(vectors):
            q_by_length.setdefault(len(v), []).append(i)
        ids, own = (queries.column(c).to_numpy() for c in ("query_id", "qcls"))
        for n, members in q_by_length.items():
            if n not in by_length:
                continue
            part = data.take(pa.array(by_length[n], pa.int64()))
            cls = part.column("cls").to_numpy()
            cells = np.frombuffer(b"".join(part.column("cells").to_pylist()), np.uint8).reshape(len(cls), n)
            corners = (lo[:n] + cells * width[:n]).T
            for at in range(0, len(members), STRIP):
                rows = np.array(members[at : at + STRIP])
                q = np.array([vectors[i] for i in rows], float).reshape(len(rows), n)
                base = q @ corners
                # Rounding of large products widens the bounds and never narrows them.
                blur = 1e-12 * (np.abs(q) @ np.abs(corners).max(axis=1, initial=0))[:, None] if n else 0.0
                low = base + (np.minimum(q, 0) @ (width[:n] - 1))[:, None] - blur
                high = base + (np.maximum(q, 0) @ (width[:n] - 1))[:, None] + blur
                if len(cls) > k + 1:
                    kth = -np.partition(-low, k, axis=1)[:, k]  # one more than k: the query's own class may count
                    qi, ci = np.nonzero(high >= kth[:, None])
                else:
                    qi, ci = (a.ravel() for a in np.indices(low.shape))
                found.append(pa.table(
                    [ids[rows[qi]], own[rows[qi]], cls[ci], low[qi, ci], high[qi, ci]], schema=schema
                ))
        return pa.concat_tables(found) if found else schema.empty_table()

    return run


def _best(rows: DataFrame, order: list[Column], n: int, into: str = "nth") -> DataFrame:
    return rows.withColumn(into, F.row_number().over(Window.partitionBy("query_id", "qcls").orderBy(*order))).filter(F.col(into) <= n)


def _floor(rows: DataFrame, value: str, k: int) -> DataFrame:
    """Per query, the ``k + 1``-th greatest value, where there are so many."""
    return (
        _best(rows, [F.col(value).desc()], k + 1).groupBy("query_id", "qcls")
        .agg(F.min(value).alias("floor"), F.count(F.lit(1)).alias("n"))
        .select("query_id", "qcls", F.when(F.col("n") > k, F.col("floor")).alias("floor"))
    )


def _read(candidates: DataFrame, classes: DataFrame) -> DataFrame:
    """Exact scores of candidates, from the exact vectors."""
    left = classes.select(F.col("cls").alias("qcls"), F.col("vec").alias("q"))
    right = classes.select("cls", "vec")
    product = F.aggregate(F.zip_with("q", "vec", lambda a, b: a * b), F.lit(0).cast("long"), lambda s, x: s + x)
    return candidates.join(right, "cls").join(left, "qcls").select("query_id", "qcls", "cls", product.alias("score"))


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, scale: int = 64) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` highest scores of every query, all if there are fewer."""
    points = whole_vectors(vectors, scale)
    classes = classes_of(points, k)
    queries = durable(
        points.filter(is_query).distinct().join(classes.select("vec", "cls"), "vec")
        .select(F.col("vec_id").alias("query_id"), F.col("cls").alias("qcls"), "vec")
    )
    d, lo, width = grid(classes)
    n_data, n_queries = classes.count(), queries.count()
    data_blocks, query_blocks = max(1, -(-n_data // DATA_BLOCK)), max(1, -(-n_queries // QUERY_BLOCK))

    def blocked(rows: DataFrame, key: str, own: str, n: int, other: str, copies: int) -> DataFrame:
        return rows.withColumn(own, F.pmod(F.xxhash64(key), F.lit(n)).cast("int")).withColumn(
            other, F.explode(F.sequence(F.lit(0), F.lit(copies - 1)))
        )

    file = classes.select("cls", "vec").mapInArrow(_approximated(lo, width), "cls long, cells binary")
    data = blocked(file, "cls", "p", data_blocks, "g", query_blocks)
    asked = blocked(queries, "query_id", "g", query_blocks, "p", data_blocks)
    scanned = durable(
        asked.groupBy("p", "g").cogroup(data.groupBy("p", "g"))
        .applyInArrow(_scan(lo, width, k), "query_id long, qcls long, cls long, low double, high double")
    )
    key = ["query_id", "qcls"]
    kept = scanned.join(_floor(scanned, "low", k), key).filter(F.col("floor").isNull() | (F.col("high") >= F.col("floor"))).drop("floor")
    ranked = durable(kept.withColumn("nth", F.row_number().over(Window.partitionBy(*key).orderBy(F.col("high").desc(), "cls"))))
    n_first = FIRST_READ * (k + 1)
    first = durable(_read(ranked.filter(F.col("nth") <= n_first), classes))
    rest = ranked.filter(F.col("nth") > n_first).join(_floor(first, "score", k), key).filter(
        F.col("floor").isNull() | (F.col("high") >= F.col("floor"))
    )
    scored = first.unionByName(_read(rest, classes))
    results = scored.join(classes.select("cls", "ids"), "cls").select("query_id", "qcls", "score", F.explode("ids").alias("vec_id"))
    best = _best(results.filter(F.col("vec_id") != F.col("query_id")), [F.col("score").desc(), F.col("vec_id")], k, "rank")
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
