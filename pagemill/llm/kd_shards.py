"""Sharding by a k-d tree: split at distributed weighted medians along the widest metadata dimension.

A node holds a number of leaves; it is cut along the dimension whose values
spread widest in it, at the point where the bytes divide in proportion to the
leaves of its two children, until every node is one leaf of about the target
bytes. Forty leaves need six levels; all nodes of a level are cut together.

A cut is found by counting bytes per cell and never by sorting. The position of a
row along a dimension is a number of 39 bits: 13 bits of the dimension, 13 bits
of a hash of the text, 13 bits of a hash of the id. Three rounds each sum bytes
over at most 8,192 cells per node, take the running sum and keep the cell in
which the wanted weight lies, so one value that holds a third of all rows is cut
like any other, first between texts and last between ids. Each sum is combined
before its shuffle; what reaches the driver is one row per node.

Null texts weigh ``overhead`` bytes; null metadata counts as an empty value; tied
and repeated rows are told apart by nothing and may only tie in the last cell.
An empty table gives an empty result. Further columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagemill.llm.frames import chunk_count, text_of
from pagemill.plans.scratch import durable

BITS = 13
CELLS = 1 << BITS
ROUNDS = 3
OVERHEAD = 16
#: Bound of the tree, and so of every table of cuts that is broadcast or held by the driver.
MOST_LEAVES = 200_000
SLOT_ROWS = 100_000


def hashed(*columns: Column) -> Column:
    """The cell of a value without a natural order."""
    return F.shiftrightunsigned(F.xxhash64(*columns), 64 - BITS)


def sized(nbytes: Column) -> Column:
    """The cell of a size: its logarithm in steps of 1/256 of a doubling."""
    return F.least(F.lit(CELLS - 1).cast("long"), F.floor(F.log2(nbytes + 1.0) * 256))


def text_points(docs: DataFrame, overhead: int = OVERHEAD) -> DataFrame:
    """Documents as points: identity, bytes, the metadata dimensions ``d0`` to ``d2`` and the hashes that break ties."""
    length = F.octet_length(text_of()).cast("long")
    return docs.select(
        "doc_id",
        (length + overhead).alias("size"),
        F.crc32(text_of().cast("binary")).alias("text_crc32"),
        sized(length).alias("d0"),
        hashed(F.coalesce("source", F.lit(""))).alias("d1"),
        hashed(F.coalesce("lang", F.lit(""))).alias("d2"),
        hashed(text_of(), F.lit("text")).alias("h1"),
        hashed(F.col("doc_id"), F.lit("id")).alias("h2"),
    )


def _bound(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A table of at most one row per node, made from literals; its bound makes it safe to broadcast."""
    return F.broadcast(spark.createDataFrame(rows, schema))


def _position(dim: Column, dims: list[str]) -> Column:
    """The cells of a row along the dimension of its node, coarse to fine."""
    first = F.element_at(F.array(*[F.col(d) for d in dims]), (dim + 1).cast("int"))
    return F.array(first, F.col("h1"), F.col("h2"))


def _cut_level(points: DataFrame, dims: list[str], leaves: dict[int, int]) -> dict[int, tuple[int, list[int]]]:
    """For each node with more than one leaf: its widest dimension and the last position of the left child."""
    spark = points.sparkSession
    open_nodes = [(n, k) for n, k in leaves.items() if k > 1]
    spans = points.groupBy("node").agg(
        F.sum("size").alias("weight"),
        F.array(*[F.max(d) - F.min(d) for d in dims]).alias("spans"),
    )
    found = {
        r["node"]: r
        for r in spans.join(_bound(spark, open_nodes, "node long, leaves int"), "node").collect()  # one row per node
    }
    state = {}
    for node, k in open_nodes:
        row = found.get(node)
        if row is None:  # no rows fell here: any cut will do
            state[node] = (0, 0, [])
            continue
        widest = max(range(len(dims)), key=lambda i: (row["spans"][i], -i))
        state[node] = (widest, row["weight"] * (k // 2) // k, [])
    for turn in range(ROUNDS):
        table = [(n, dim, want, path) for n, (dim, want, path) in state.items()]
        inside = points.join(_bound(spark, table, "node long, dim int, want long, path array<long>"), "node")
        place = _position(F.col("dim"), dims)
        if turn:
            inside = inside.filter(F.slice(place, 1, turn) == F.col("path"))
        cells = inside.groupBy("node", place[turn].alias("cell")).agg(
            F.sum("size").alias("weight"), F.first("want").alias("want")
        )
        along = Window.partitionBy("node").orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)
        reached = (
            cells.withColumn("upto", F.sum("weight").over(along))
            .withColumn("short", F.col("want") - (F.col("upto") - F.col("weight")))
            .withColumn("over", F.col("upto") >= F.col("want"))
            .groupBy("node")
            .agg(F.min(F.when(F.col("over"), F.struct("cell", "short", "weight"))).alias("at"))
        )
        for r in reached.collect():  # one row per node
            dim, _, path = state[r["node"]]
            cell, short, weight = r["at"]
            # In the last round a cell goes to the side that leaves the smaller error.
            if turn == ROUNDS - 1 and 2 * short < weight:
                cell -= 1
            state[r["node"]] = (dim, short, [*path, cell])
    return {n: (dim, path + [CELLS] * (ROUNDS - len(path))) for n, (dim, _, path) in state.items()}


def kd_nodes(points: DataFrame, dims: list[str], leaves: int) -> DataFrame:
    """Add ``node``, the leaf of each point, numbered 0 to ``leaves`` - 1 from left to right."""
    if not 1 <= leaves <= MOST_LEAVES:
        raise ValueError(f"1 to {MOST_LEAVES} leaves")
    spark = points.sparkSession
    found = points.withColumn("node", F.lit(1).cast("long"))
    tree = {1: leaves}
    while any(k > 1 for k in tree.values()):
        cuts = _cut_level(found, dims, tree)
        table = [(n, dim, path) for n, (dim, path) in cuts.items()]
        known = _bound(spark, table, "node long, dim int, path array<long>")
        right = (_position(F.col("dim"), dims) > F.col("path")).cast("long")
        found = found.join(known, "node", "left").withColumn(
            "node", F.when(F.col("dim").isNull(), F.col("node") * 2).otherwise(F.col("node") * 2 + right)
        ).drop("dim", "path")
        tree = {
            child: k
            for n, all_k in tree.items()
            for child, k in (((2 * n, all_k),) if all_k == 1 else ((2 * n, all_k // 2), (2 * n + 1, all_k - all_k // 2)))
        }
    number = _bound(spark, [(n, i) for i, n in enumerate(sorted(tree))], "node long, shard int")
    return found.join(number, "node").drop("node")


def with_slots(rows: DataFrame, shard: str, by: str) -> DataFrame:
    """Add ``slot``, gapless from 0 in each shard. A shard is numbered in many pieces, whose counts are carried forward."""
    kept = durable(rows)
    pieces = chunk_count(kept.count(), rows.sparkSession, SLOT_ROWS)
    cut = kept.withColumn("_piece", F.pmod(F.xxhash64(by, F.lit("slot")), F.lit(pieces)).cast("int"))
    before = Window.partitionBy(shard).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = cut.groupBy(shard, "_piece").agg(F.count(F.lit(1)).alias("_n")).select(
        shard, "_piece", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start")
    )
    inside = F.row_number().over(Window.partitionBy(shard, "_piece").orderBy(by))
    return (
        cut.withColumn("_row", inside).join(starts, [shard, "_piece"])
        .withColumn("slot", F.col("_start") + F.col("_row") - 1)
        .drop("_piece", "_row", "_start")
    )


def shard_documents(
    docs: DataFrame, target_bytes: int | None = None, shards: int | None = None, overhead: int = OVERHEAD
) -> DataFrame:
    """``doc_id, size, text_crc32, shard, slot`` for shards of about ``target_bytes``, or for a fixed number of them."""
    points = durable(text_points(docs, overhead))
    if shards is None:
        if not target_bytes:
            raise ValueError("name target_bytes or shards")
        total = points.agg(F.sum("size")).first()[0] or 0
        shards = max(1, -(-total // target_bytes))
    placed = kd_nodes(points, ["d0", "d1", "d2"], shards)
    return with_slots(placed.select("doc_id", "size", "text_crc32", "shard"), "shard", "doc_id")
