"""Joins whose large side may hold a dominant key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT_ROWS = 2_000_000
NULL_SLICES = 4096


def spread_join(
    large: DataFrame,
    lookup: DataFrame,
    on: list[str],
    spread_by: str,
    how: str = "left",
    hot_rows: int = HOT_ROWS,
    counted: DataFrame | None = None,
) -> DataFrame:
    """Equi-join in which keys with more than ``hot_rows`` rows are split over several tasks.

    The count per key is a map-side-combined aggregate of the key columns only.
    A hot key is cut into ``ceil(rows / hot_rows)`` slices by a hash of
    ``spread_by``; only the look-up rows of hot keys are copied, once per slice.
    At most ``rows / hot_rows`` keys can be hot; their table is broadcast only where
    Spark finds it small.
    ``counted`` names a cheaper table with the same key counts as ``large``.
    """
    hot = (
        (large if counted is None else counted).groupBy(*on)
        .agg(F.count(F.lit(1)).alias("_n"))
        .filter(F.col("_n") > hot_rows)
        .select(*on, F.ceil(F.col("_n") / hot_rows).cast("int").alias("_slices"))
    )
    last = F.coalesce(F.col("_slices"), F.lit(1)) - 1
    # A null key matches nothing, so such rows may go anywhere.
    keyless = F.exists(F.array(*[F.col(c).isNull() for c in on]), lambda missing: missing)
    slices = F.when(keyless, NULL_SLICES).otherwise(last + 1)
    left = (
        large.join(hot, on, "left")
        .withColumn("_slice", F.pmod(F.xxhash64(spread_by), slices).cast("int"))
        .drop("_slices")
    )
    right = (
        lookup.join(hot, on, "left")
        .withColumn("_slice", F.explode(F.sequence(F.lit(0), last)))
        .drop("_slices")
    )
    return left.join(right, [*on, "_slice"], how).drop("_slice")
