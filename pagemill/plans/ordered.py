"""Running values per key when one key may hold a large share of all rows.

A plain ``Window.partitionBy(key)`` puts a key into one task. Here rows are
range-partitioned on (key, order), so a big key is cut into consecutive chunks
at any point, equal times included. Running values are computed inside each
(key, chunk), and a small table carries the totals of earlier chunks forward.
Only the first key of a chunk can continue from an earlier chunk, so that table
has at most one row per chunk, whatever the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.plans.scratch import durable

CHUNK = "_chunk"


def into_chunks(rows: DataFrame, key: str, order: list[str], chunks: int | None = None) -> DataFrame:
    """Cut the rows into ordered chunks and pin the cut on durable storage.

    The cut comes from sampled range bounds. It is read more than once below,
    so it is written down rather than derived again. Pass narrow rows.
    """
    n = chunks or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = rows.repartitionByRange(n, key, *order)
    return durable(cut.withColumn(CHUNK, F.spark_partition_id()))


def within(key: str, order: list[str]) -> Window:
    """Window over one chunk of a key, from its first row to the current one."""
    return (
        Window.partitionBy(key, CHUNK)
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )


def earlier_chunks(key: str) -> Window:
    """Window over the chunk totals of a key that precede the current chunk."""
    return Window.partitionBy(key).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)


def carry(totals: DataFrame, key: str, **values: Column) -> DataFrame:
    """Chunk totals to the rows that need a value from earlier chunks (at most one per chunk)."""
    numbered = totals.withColumn(
        "_seen", F.count(F.lit(1)).over(earlier_chunks(key))
    ).withColumns(values)
    return numbered.filter(F.col("_seen") > 0).select(key, CHUNK, *values)


def attach(rows: DataFrame, carried: DataFrame, key: str) -> DataFrame:
    """Null-safe on the key: rows without one form a key of their own.

    It also keeps the two readings of the rows identical, so one shuffle serves both.
    """
    right = carried.withColumnsRenamed({key: "_key", CHUNK: "_of"})
    same = rows[key].eqNullSafe(right["_key"]) & rows[CHUNK].eqNullSafe(right["_of"])
    return rows.join(F.broadcast(right), same, "left").drop("_key", "_of")


def running_max(
    rows: DataFrame, key: str, order: list[str], value: str, into: str, chunks: int | None = None
) -> DataFrame:
    """Add ``into``: the largest ``value`` up to and including each row of its key."""
    cut = into_chunks(rows, key, order, chunks)
    totals = cut.groupBy(key, CHUNK).agg(F.max(value).alias("_top"))
    carried = carry(totals, key, _before=F.max("_top").over(earlier_chunks(key)))
    local = cut.withColumn("_here", F.max(value).over(within(key, order)))
    return (
        attach(local, carried, key)
        .withColumn(into, F.greatest("_here", "_before"))
        .drop("_here", "_before", CHUNK)
    )
