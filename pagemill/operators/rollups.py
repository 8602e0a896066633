"""Counters and histograms that are kept, not recomputed: partial sums per batch, folded when read.

A batch of fetches is reduced to one row per label set: counts, bucket counts, sums,
least and greatest times. All of them can be added up, so a reader folds the batches'
rows and never sees a fetch again. A batch has a folder of its own under its number;
writing it once more replaces it, so a replayed batch counts once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.operators.metrics import SECONDS_BUCKETS, bucket_label, or_unknown

LABELS = ("domain", "status", "status_code")


def partial_sums(fetches: DataFrame, bounds: Sequence[float] = SECONDS_BUCKETS) -> DataFrame:
    """One row per domain, status and status code of ``fetches``, which also have ``response_time_ms`` and ``event_at``."""
    seconds = F.col("response_time_ms") / 1000
    return fetches.groupBy(*[or_unknown(F.col(c).cast("string")).alias(c) for c in LABELS]).agg(
        F.count(F.lit(1)).alias("fetches"),
        *[F.count_if(seconds <= b).alias(bucket_label(b)) for b in bounds],
        # Whole numbers, so that the order of adding does not show.
        F.sum(F.col("response_time_ms").cast("long")).alias("ms_sum"),
        F.count("response_time_ms").alias("ms_count"),
        F.min("event_at").alias("first_at"),
        F.max("event_at").alias("last_at"),
    )


def keep_batch(fetches: DataFrame, path: str, batch: int) -> None:
    """Reduce a batch and put it in its folder, in place of an earlier attempt."""
    partial_sums(fetches).write.mode("overwrite").parquet(f"{path}/batch={int(batch)}")


def _folded(rows: DataFrame, labels: Sequence[str]) -> DataFrame:
    fixed = {"batch", *LABELS, "first_at", "last_at"}
    sums: list[Column] = [F.sum(c).alias(c) for c in rows.columns if c not in fixed]
    return rows.groupBy(*labels).agg(*sums, F.min("first_at").alias("first_at"), F.max("last_at").alias("last_at"))


def kept_totals(spark: SparkSession, path: str, *labels: str) -> DataFrame:
    """Totals of all batches per ``labels``, a choice of ``LABELS``; none gives the grand total."""
    return _folded(spark.read.parquet(path), labels)


def merge_batches(spark: SparkSession, path: str, into: str) -> None:
    """All batches as one, under another path: fewer rows to fold, the same totals."""
    _folded(spark.read.parquet(path), LABELS).write.parquet(f"{into}/batch=-1")
