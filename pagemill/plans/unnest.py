"""Exploding arrays that are expensive to compute."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unnest(rows: DataFrame, array: str, *keep: str, place: str = "place", item: str = "item") -> DataFrame:
    """One row per element of ``array`` with its position.

    A plain explode makes the optimizer infer ``size(array) > 0`` and push it
    below the projection that builds the array, which is then built again for
    the filter. The outer form infers nothing; the filter stays above it.
    """
    exploded = rows.select(*keep, F.posexplode_outer(array).alias(place, item))
    return exploded.filter(F.col(place).isNotNull())


def keep(rows: DataFrame, condition: Column) -> DataFrame:
    """Filter on a condition over columns that are expensive to compute.

    A plain filter is pushed below the projection that computes them, which
    then runs twice. Over stored columns a plain filter is the right choice.
    """
    kept = rows.withColumn("_kept", F.filter(F.array(F.lit(True)), lambda _: condition))
    return unnest(kept, "_kept", *rows.columns).drop("place", "item")
