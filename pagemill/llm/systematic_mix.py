"""Mixing sources to target weights by systematic sampling. DataFrame functions only.

Every document of a source has the same number of expected copies, the source's
target over its size. The expected copies are summed along the source, one
random offset is added, and a document is emitted once for each integer boundary
that its step crosses. Expected copies are whole multiples of 2**-24, so running
sums are exact integers, whatever the cut into chunks.

Along a source, documents stand in order of size and id. Neighbours are of like
size, so the words taken differ from the target by about one document.

The order is cut by range into chunks that end anywhere inside a source. Chunk
totals, one row per source and chunk, carry the sums forward, so a source with a
third of all rows is never in one task.

Null texts and texts without words have size 0 and are taken for 0 words. A null
source is a source of its own, last in order. Repeated rows are separate
documents. An empty table gives an empty result. Further columns stay in
``emit``; names used inside are unique per call.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.llm.frames import chunk_count, earlier, fresh, ordered_chunks, text_of, word_count
from pagemill.plans.scratch import durable

UNIT = 1 << 24
MOST_COPIES = 3


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = MOST_COPIES) -> DataFrame:
    """``source, source_size`` to ``source, source_size, target``: shares by weight, none above ``most`` times the size.

    Weights repeat along the sources in order of code points, null last. Sources
    are filled in order of limit over weight: one is at its limit if the even
    level of what is left would lift it above; the first that is not sets the
    level for all that follow. This is where resharing the excess ends.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    named = sizes.withColumn("_weight", weight).withColumn("_limit", most * F.col("source_size"))
    order = Window.orderBy(F.col("_limit") / F.col("_weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    onward = order.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    filled = named.withColumn(
        "_level",
        (F.sum("source_size").over(everything) - F.coalesce(F.sum("_limit").over(before), F.lit(0))).cast("double")
        / F.sum("_weight").over(onward),
    )
    free = F.col("_level") * F.col("_weight") <= F.col("_limit")
    # The even level only rises along the order until the first free source.
    level = F.first(F.when(free, F.col("_level")), ignorenulls=True).over(
        order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    )
    return filled.withColumn("_final", level).select(
        "source",
        "source_size",
        F.least(F.col("_limit").cast("double"), F.coalesce(F.col("_final"), F.lit(0.0)) * F.col("_weight")).alias("target"),
    )


def offset_of(source: Column, seed: str) -> Column:
    """The random offset of a source, in units: 24 bits of a digest of the seed and its name."""
    name = F.concat(F.lit(seed), F.coalesce(F.concat(F.lit("="), source), F.lit("null")))
    return F.conv(F.substring(F.md5(name), 1, 6), 16, 10).cast("long")


def systematic(
    rows: DataFrame, part: str, order: list[str], expected: str, offset: Column, into: str, chunks: int | None = None
) -> DataFrame:
    """Add ``into``, the copies of each row: the integer boundaries that its step of the running sum crosses.

    ``expected`` holds expected copies in units, a long. Rows are narrow: they are
    written once, in order.
    """
    chunk, total, before, upto = fresh("chunk"), fresh("total"), fresh("before"), fresh("upto")
    n = chunks or chunk_count(rows.count(), rows.sparkSession)
    keys = [F.col(part).asc_nulls_last(), *[F.col(c).asc_nulls_first() for c in order]]
    cut = ordered_chunks(rows, keys, n, chunk)
    totals = cut.groupBy(part, chunk).agg(F.sum(expected).alias(total))
    carried = totals.select(
        F.col(part).alias(f"{part}{chunk}"),
        F.col(chunk).alias(f"{chunk}_of"),
        F.coalesce(F.sum(total).over(earlier(part, chunk)), F.lit(0)).alias(before),
    )
    along = Window.partitionBy(part, chunk).orderBy(*keys[1:]).rowsBetween(Window.unboundedPreceding, 0)
    summed = cut.withColumn(upto, F.sum(expected).over(along)).join(
        carried,
        F.col(part).eqNullSafe(F.col(f"{part}{chunk}")) & (F.col(chunk) == F.col(f"{chunk}_of")),
    )
    end = F.col(before) + F.col(upto) + offset
    bits = UNIT.bit_length() - 1
    copies = F.shiftright(end, bits) - F.shiftright(end - F.col(expected), bits)
    return summed.withColumn(into, copies).select(*rows.columns, into)


def mix(
    docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = MOST_COPIES, seed: str = "mix"
) -> DataFrame:
    """One row per document: ``doc_id, source, size, source_size, target, copies, taken``."""
    sized = durable(docs.select("doc_id", "source", word_count(text_of()).alias("size")))
    targets = source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most)
    rate = F.col("target") / F.col("source_size")
    units = F.when(F.col("source_size") > 0, F.floor(rate * UNIT)).otherwise(0).cast("long")
    right = targets.withColumnRenamed("source", "_of").withColumn("_units", F.least(units, F.lit(most * UNIT)))
    rated = sized.join(right, sized["source"].eqNullSafe(right["_of"])).drop("_of")
    return (
        systematic(rated, "source", ["size", "doc_id"], "_units", offset_of(F.col("source"), seed), "copies")
        .withColumn("taken", F.col("copies") * F.col("size"))
        .drop("_units")
    )


def emit(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = MOST_COPIES, seed: str = "mix") -> DataFrame:
    """The mixed corpus: each document as often as its copies say, with the columns of ``docs``.

    Rows of one id share their copies: where an id is repeated, it takes the
    copies that all its rows got together, dealt evenly.
    """
    n, total = fresh("rows"), fresh("copies")
    place, copies = fresh("place"), fresh("of")
    per_id = (
        mix(docs, weights, most, seed).groupBy("doc_id")
        .agg(F.sum("copies").alias(total), F.count(F.lit(1)).alias(n))
        .withColumnRenamed("doc_id", place)
    )
    joined = docs.join(per_id, docs["doc_id"].eqNullSafe(per_id[place]))
    # Of several rows with one id, the first ones take what does not divide evenly.
    nth = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.xxhash64("text")))
    share = F.when(F.col(n) == 1, F.col(total)).otherwise(
        F.floor(F.col(total) / F.col(n)) + (F.col(copies) <= F.col(total) % F.col(n)).cast("long")
    )
    return (
        joined.withColumn(copies, nth)
        .withColumn(copies, share)
        .filter(F.col(copies) > 0)
        .select(*docs.columns, F.explode(F.sequence(F.lit(1).cast("long"), F.col(copies))).alias(place))
        .drop(place)
    )
