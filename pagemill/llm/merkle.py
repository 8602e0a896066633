"""A Merkle manifest of a dataset, built from levels that are single strings.

Every row is a leaf, the digest of its values. The leaves of a tree (a source)
stand in order of their id; runs of ``fanout`` nodes are hashed into their parent
until one node is left, the tree's root. The roots, in order of their trees, are
the leaves of one more tree, whose root stands for the dataset.

Leaves are numbered along their tree and cut into aligned blocks of ``WIDTH``
whole runs of runs. A block keeps each of its levels as one hex string: parents
are digests of its substrings of fixed width, the siblings of a node are the
substrings that flank it in its run. The roots of the blocks are the nodes of the
next round, so a tree of any size takes some rounds of bounded blocks; on the way
back every node's proof is its siblings in the block and then those of the block.

Numbering cuts the rows by range, in a tree of any share of them. Nothing bigger
than a block meets in one task, and no row carries more than a proof.

A null value is marked as such in its leaf, a null tree is a tree of its own and
stands first, a null id stands first in its tree. Rows of one id are ordered by
their leaves; repeated rows are leaves of their own, with the same digest. An
empty table gives an empty result. Further columns take no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.llm.frames import chunk_count, earlier, ordered_chunks
from pagemill.plans.scratch import durable

FANOUT = 3
#: Levels inside a block; a block has at most FANOUT ** LEVELS nodes.
LEVELS = 6
HEX = 64
_MOST_LEVELS = 40



def _empty() -> Column:
    return F.lit("").cast("binary")


def value_of(column: str | Column) -> Column:
    """A value as the leaf spells it: ``-`` for null, else its length in bytes, a colon, the value."""
    text = (F.col(column) if isinstance(column, str) else column).cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(*columns: str | Column) -> Column:
    """The digest of a row's values."""
    return F.sha2(F.concat(*map(value_of, columns)), 256)


def _div(a: Column, b: Column | int) -> Column:
    """Whole quotient of non-negative numbers below 2 ** 53."""
    return ((a - a % b) / b).cast("long")


def _powers(count: int, fanout: int) -> Column:
    return F.array(*[F.lit(fanout**j if fanout**j < 1 << 62 else 1 << 62).cast("long") for j in range(count)])


def height(nodes: Column, fanout: int = FANOUT, most: int = _MOST_LEVELS) -> Column:
    """How many levels of parents ``nodes`` nodes need, ``most`` at the most."""
    return F.size(F.filter(_powers(most, fanout), lambda p: p < nodes))


def _steps(count: Column, most: int) -> Column:
    """0, 1, … as far as ``count``; none for 0."""
    return F.slice(F.array(*map(F.lit, range(most))), F.lit(1), count)


def parents(level: Column, fanout: int) -> Column:
    """The level above: digests of runs of ``fanout`` nodes of a level kept as one string."""
    width = fanout * HEX
    last = F.ceil(F.octet_length(level) / width).cast("int") - 1
    digests = F.transform(F.sequence(F.lit(0), last), lambda i: F.sha2(F.substring(level, i * width + 1, F.lit(width)), 256))
    return F.array_join(digests, "").cast("binary")


def block_levels(level: Column, count: Column, fanout: int = FANOUT, most: int = LEVELS) -> Column:
    """All levels of a block from its lowest one up, ``count`` of them above it."""
    return F.aggregate(
        _steps(count, most), F.array(level), lambda found, _: F.concat(found, F.array(parents(F.element_at(found, -1), fanout)))
    )


def siblings(levels: Column, place: Column, fanout: int = FANOUT, most: int = LEVELS) -> Column:
    """The nodes that flank the node at ``place`` of a block in its run, level by level to the block's root."""
    powers = _powers(most, fanout)

    def flanks(proof: Column, j: Column) -> Column:
        level = F.element_at(levels, j + 1)
        node = _div(place, F.element_at(powers, j + 1)).cast("int")
        own = node % fanout
        left = F.substring(level, (node - own) * HEX + 1, own * HEX)
        right = F.substring(level, (node + 1) * HEX + 1, (fanout - 1 - own) * HEX)
        return F.concat(proof, left, right)

    return F.aggregate(_steps(F.size(levels) - 1, most), _empty(), flanks)


def fold(node: Column, proof: Column, place: Column, nodes: Column, fanout: int = FANOUT) -> Column:
    """The root that a node and its siblings lead to, for the node at ``place`` of a tree of ``nodes`` leaves."""

    def state(node: Column, at: Column, place: Column, nodes: Column) -> Column:
        return F.struct(node.alias("node"), at.alias("at"), place.alias("place"), nodes.alias("nodes"))

    def up(s: Column, _: Column) -> Column:
        own = (s["place"] % fanout).cast("int")
        run = F.least(F.lit(fanout).cast("long"), s["nodes"] - (s["place"] - own)).cast("int")
        left = F.substring(proof, s["at"] + 1, own * HEX)
        right = F.substring(proof, s["at"] + own * HEX + 1, (run - 1 - own) * HEX)
        return state(
            F.sha2(F.concat(left, s["node"], right), 256).cast("binary"),
            s["at"] + (run - 1) * HEX, _div(s["place"], fanout), _div(s["nodes"] + fanout - 1, fanout),
        )

    begin = state(node.cast("binary"), F.lit(0), place.cast("long"), nodes.cast("long"))
    return F.aggregate(_steps(height(nodes, fanout), _MOST_LEVELS), begin, up, lambda s: s["node"].cast("string"))


def numbered(rows: DataFrame, tree: str, order: list[str]) -> DataFrame:
    """Add ``place``, gapless from 0 along each tree, and ``nodes``, the rows of the tree.

    Rows are narrow and written already; the range cut goes through a tree wherever it falls.
    """
    chunk, of, key = "_chunk", "_chunk_of", "_tree_of"
    keys = [F.col(tree), *[F.col(c).asc_nulls_first() for c in order]]
    cut = ordered_chunks(rows, keys, chunk_count(rows.count(), rows.sparkSession), chunk)
    totals = cut.groupBy(tree, chunk).agg(F.count(F.lit(1)).alias("_rows"))
    carried = totals.select(
        F.col(tree).alias(key), F.col(chunk).alias(of),
        F.coalesce(F.sum("_rows").over(earlier(tree, chunk)), F.lit(0)).alias("_before"),
        F.sum("_rows").over(Window.partitionBy(tree)).alias("nodes"),
    )
    within = F.row_number().over(Window.partitionBy(tree, chunk).orderBy(*keys[1:]))
    joined = cut.withColumn("_nth", within).join(carried, (F.col(tree) == F.col(key)) & (F.col(chunk) == F.col(of)))
    return joined.select(*rows.columns, (F.col("_before") + F.col("_nth") - 1).alias("place"), "nodes")


def climb(nodes: DataFrame, fanout: int = FANOUT, levels: int = LEVELS) -> list[DataFrame]:
    """Rounds of blocks from ``tree, place, nodes, digest`` and further columns, which stay with their node.

    A round has ``tree, block, nodes, members, levels``; the last one has a block per tree.
    """
    width = fanout**levels
    most = nodes.agg(F.max("nodes")).first()[0] or 1
    rounds: list[DataFrame] = []
    while True:
        held = [c for c in nodes.columns if c not in ("tree", "nodes")]
        blocks = nodes.groupBy("tree", _div(F.col("place"), width).alias("block"), "nodes").agg(
            F.array_sort(F.collect_list(F.struct("place", *[c for c in held if c != "place"]))).alias("members")
        )
        lowest = F.array_join(F.transform("members", lambda m: m["digest"]), "").cast("binary")
        above = block_levels(lowest, height(F.col("nodes"), fanout, levels), fanout, levels)
        rounds.append(durable(blocks.withColumn("levels", above)))
        if most <= width:
            return rounds
        most = -(-most // width)
        nodes = rounds[-1].select(
            "tree", F.col("block").alias("place"), _div(F.col("nodes") + width - 1, width).alias("nodes"),
            F.element_at("levels", -1).cast("string").alias("digest"),
        )


def roots(rounds: list[DataFrame]) -> DataFrame:
    """``tree, digest`` of the trees' roots."""
    return rounds[-1].select("tree", F.element_at("levels", -1).cast("string").alias("digest"))


def descend(rounds: list[DataFrame], known: DataFrame, fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """Per leaf its columns, ``tree, place, nodes, proof`` and what ``known`` says of its tree.

    ``known`` has a row per tree. Every join is of blocks, whose keys are unique on both sides.
    """
    width = fanout**levels
    carried = [c for c in known.columns if c != "tree"]
    above = known.withColumn("block", F.lit(0).cast("long")).withColumn("rest", _empty())
    for n in reversed(range(len(rounds))):
        joined = rounds[n].join(above, ["tree", "block"])
        member = joined.select("tree", "nodes", "levels", "rest", *carried, F.explode("members").alias("m"))
        place = (F.col("m.place") % width).cast("int")
        proof = F.concat(siblings(F.col("levels"), place, fanout, levels), F.col("rest"))
        if n:
            above = member.select("tree", F.col("m.place").alias("block"), proof.alias("rest"), *carried)
        else:
            leaves = member.select("tree", "nodes", proof.alias("proof"), *carried, "m.*")
    return leaves


def manifest(
    docs: DataFrame, columns: tuple[str, ...], tree: str = "source", order: str = "doc_id",
    fanout: int = FANOUT, levels: int = LEVELS, **beside: Column,
) -> DataFrame:
    """Per row ``doc_id`` (of ``order``), ``leaf, place, nodes, proof`` in its tree, and ``subroot``, then
    ``tree_place, trees, tree_proof`` of its tree in the dataset, and ``root``; ``beside`` adds columns.
    """
    # A key that is never null and keeps the order: nulls first, then by bytes.
    key = F.coalesce(F.concat(F.lit("="), F.col(tree).cast("string")), F.lit(""))
    rows = durable(docs.select(
        key.alias("tree"), F.col(order).alias("doc_id"), leaf_of(*columns).alias("digest"),
        *[c.alias(name) for name, c in beside.items()],
    ))
    rounds = climb(numbered(rows, "tree", ["doc_id", "digest"]), fanout, levels)
    subroots = durable(roots(rounds).select(F.lit("").alias("all"), F.col("tree").alias("name"), "digest"))
    upper = climb(numbered(subroots, "all", ["name"]).withColumnRenamed("all", "tree"), fanout, levels)
    top = descend(upper, roots(upper).withColumnRenamed("digest", "root"), fanout, levels)
    known = top.select(
        F.col("name").alias("tree"), F.col("digest").alias("subroot"), F.col("place").alias("tree_place"),
        F.col("nodes").alias("trees"), F.col("proof").alias("tree_proof"), "root",
    )
    found = descend(rounds, known, fanout, levels).withColumnRenamed("digest", "leaf")
    return found.select(
        "doc_id", "leaf", "place", "nodes", "proof", "subroot", "tree_place", "trees", "tree_proof", "root", *beside
    )


def folded(leaf: Column, fanout: int = FANOUT) -> Column:
    """The dataset's root that a leaf and the proofs of ``manifest`` lead to."""
    subroot = fold(leaf, F.col("proof"), F.col("place"), F.col("nodes"), fanout)
    return fold(subroot, F.col("tree_proof"), F.col("tree_place"), F.col("trees"), fanout)


def whole_proof() -> Column:
    """All siblings of a row of ``manifest`` from its leaf to the root."""
    return F.concat("proof", "tree_proof")
