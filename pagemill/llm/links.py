"""Connected components of a table of links, without holding any of them on one machine.

Large-star and small-star rounds (Kiveris et al., 2014) in turn: every node's
larger neighbours are tied to its least neighbour, then its smaller ones, until
the links are stars around each component's least node. Least neighbours are
combined before their shuffle; joins back to a hub's links can be split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.plans.scratch import durable


def _least(links: DataFrame) -> DataFrame:
    return links.groupBy("u").agg(F.min("v").alias("m"))


def _large_star(links: DataFrame) -> DataFrame:
    both = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _least(both).withColumn("m", F.least("u", "m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = _least(down)
    tied = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return tied.unionByName(least.select("u", F.col("m").alias("v"))).filter("u <> v")


def _digest(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """``node, component`` for every node of ``links(u, v)``; the component is its least node."""
    stars = durable(links.select("u", "v").filter("u <> v").distinct())
    seen = None
    while (now := _digest(stars)) != seen:
        seen = now
        stars = durable(_small_star(_large_star(stars).distinct()).distinct())
    own = stars.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return stars.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(own)
