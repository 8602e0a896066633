"""Near-duplicate documents by HyperMinHash sketches, with every link confirmed on full sets.

A document is the set of its distinct shingles of ``k`` words; ASCII letters are
lower-cased and words end at space and U+0009 to U+000D. A shingle's hash picks
one of ``BUCKETS`` buckets; a bucket keeps the least value seen as a register of
16 bits, 6 for its leading zeros and 10 for the mantissa bits that follow. An
empty bucket borrows from a fixed random order of the others, so short texts
have full sketches.

1. Documents with equal sets form a class, found by one combined aggregate; its
   least id stands for it from here on. Sets too small to reach the similarity
   with any other set go no further.
2. Registers are cut into ``BANDS`` bands of ``ROWS``. Representatives that agree
   on a band meet. At 80 % similarity a pair meets in no band with probability
   (1 - 0.8 ** 5) ** 32, about 3 in a million.
3. In each band every member is held against the least one: k members give k - 1
   candidates. The estimate, corrected for registers that agree by chance, drops
   candidates five standard errors below the bound; the rest are confirmed on
   full sets. Components of the confirmed links are found.
4. Where members of one band are still in different components, the members
   outside the band's largest component are held against all others of it, on full
   sets and in bounded blocks, from which only links come out. What a component
   already joins is never compared again, so a band of a million linked near copies
   costs a million candidates. No candidate is dropped by count.

Null and wordless texts have an empty set and no links. Rows of one id are one
node. Rows without id take the component of their class, or none. An empty table
gives an empty result. Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.llm.links import components
from pagemill.plans.scratch import durable

BANDS, ROWS = 32, 5
BUCKETS = BANDS * ROWS
MANTISSA = 10
EMPTY = 0xFFFF
#: Words whose hashes a task remembers.
CACHE_WORDS = 1 << 19
STANDARD_ERRORS = 5.0
#: Shingles in a block of full sets.
BLOCK_SHINGLES = 1 << 20

_PROBES = np.argsort(np.random.default_rng(20240229).random((BUCKETS, BUCKETS)), axis=1)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def _finish(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(text: bytes | None, k: int, words: dict) -> np.ndarray:
    """The distinct hashes of a text's shingles, ascending; of the whole sequence if it has fewer than ``k`` words."""
    parts = text.lower().split() if text else []
    n = len(parts)
    if not n:
        return np.empty(0, np.uint64)
    single = np.fromiter(map(words.__getitem__, parts), np.uint64, n)
    width = min(k, n)
    folded = np.full(n - width + 1, width, np.uint64)
    for j in range(width):
        folded = (folded ^ single[j : n - width + 1 + j]) * np.uint64(0x9E3779B97F4A7C15)
        folded ^= folded >> np.uint64(32)
    return np.unique(_finish(folded))


def registers(hashes: np.ndarray) -> np.ndarray:
    """The ``BUCKETS`` registers of a non-empty set, densified."""
    bucket = ((hashes >> np.uint64(32)) * np.uint64(BUCKETS)) >> np.uint64(32)
    ordered = np.sort((bucket << np.uint64(32)) | (hashes & np.uint64(0xFFFFFFFF)))
    held, first = np.unique(ordered >> np.uint64(32), return_index=True)
    least = (ordered[first] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    length = np.frexp(least.astype(np.float64))[1]
    mantissa = ((least << (32 - length)) >> (31 - MANTISSA)) & ((1 << MANTISSA) - 1)
    out = np.full(BUCKETS, EMPTY, np.uint16)
    out[held.astype(np.int64)] = ((32 - length) << MANTISSA) | mantissa
    full = out != EMPTY
    if not full.all():
        lender = _PROBES[np.arange(BUCKETS), full[_PROBES].argmax(axis=1)]
        # A borrowed value also names its bucket, so that tiny sets don't agree by chance.
        lent = (out[lender].astype(np.uint32) * 40503 + lender.astype(np.uint32) * 2654435) & 0x7FFF
        out = np.where(full, out, lent.astype(np.uint16))
    return out


def _signed(x: np.uint64) -> int:
    return int(np.uint64(x).astype(np.int64))


def sketch_rows(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _WordHashes()
        for batch in batches:
            counts, left, right, sketches = [], [], [], []
            for text in batch.column(1):
                found = shingle_hashes(text.as_py(), k, words)
                counts.append(len(found))
                left.append(_signed(found.sum(dtype=np.uint64)))
                right.append(_signed(np.bitwise_xor.reduce(_finish(found))) if len(found) else 0)
                sketches.append(registers(found).tobytes() if len(found) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(left, pa.int64()),
                 pa.array(right, pa.int64()), pa.array(sketches, pa.binary())],
                ["doc_id", "n_shingles", "k1", "k2", "sketch"],
            )

    return run


def set_rows(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _WordHashes()
        for batch in batches:
            for start in range(0, batch.num_rows, 256):  # sets are larger than texts
                part = batch.slice(start, 256)
                sets = [shingle_hashes(t.as_py(), k, words).astype(np.int64) for t in part.column(1)]
                ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
                values = pa.array(np.concatenate(sets), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.ListArray.from_arrays(pa.array(ends), values)], ["doc_id", "shingles"]
                )

    return run


def sketches(docs: DataFrame, k: int) -> DataFrame:
    """``doc_id, n_shingles, k1, k2, sketch``: set size, digest of the set and registers."""
    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    kind = f"doc_id {dict(docs.dtypes)['doc_id']}, n_shingles long, k1 long, k2 long, sketch binary"
    return rows.mapInArrow(sketch_rows(k), kind)


def estimate(left: np.ndarray, right: np.ndarray, n_left: np.ndarray, n_right: np.ndarray) -> np.ndarray:
    """Similarity from two blocks of registers, less the agreements that chance explains."""
    ratio = np.maximum(n_left, n_right) / np.minimum(n_left, n_right)
    chance = 0.169919487159739 * BUCKETS / (1 << MANTISSA) * 4 * ratio / (1 + ratio) ** 2
    return ((left == right).sum(axis=1) - chance) / (BUCKETS - chance)


def _promising(percent: int):
    bound = percent / 100

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (
                np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, BUCKETS) for c in ("sa", "sb")
            )
            na, nb = (batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("na", "nb"))
            error = np.sqrt(bound * (1 - bound) / np.minimum(BUCKETS, np.minimum(na, nb)))
            good = estimate(a, b, na, nb) >= bound - STANDARD_ERRORS * error
            yield batch.select(["a", "b"]).filter(pa.array(good))

    return run


def _sets(nodes: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """``doc_id, shingles``: the full sets of the documents named, kept for every step that needs them.

    Texts move once; repeated rows go where they arrive, before sets are made of them.
    """
    kind = dict(docs.dtypes)["doc_id"]
    texts = docs.select("doc_id", F.col("text").cast("binary").alias("text")).join(nodes, "doc_id", "left_semi")
    return durable(texts.dropDuplicates(["doc_id"]).mapInArrow(set_rows(k), f"doc_id {kind}, shingles array<long>"))


def _confirmed(pairs: DataFrame, nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The links among candidate pairs ``a, b``: by size, then by estimate, then on full sets."""
    kind = dict(nodes.dtypes)["doc_id"]
    known = nodes.select("doc_id", F.col("n_shingles").alias("n"), F.col("sketch").alias("s"))
    first = known.select(F.col("doc_id").alias("a"), F.col("n").alias("na"), F.col("s").alias("sa"))
    second = known.select(F.col("doc_id").alias("b"), F.col("n").alias("nb"), F.col("s").alias("sb"))
    sized = (
        pairs.join(first, "a").join(second, "b")
        .filter(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
    )
    likely = durable(sized.select("a", "b", "na", "nb", "sa", "sb").mapInArrow(_promising(percent), f"a {kind}, b {kind}"))
    joined = (
        likely.join(sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("y")), "b")
        .join(sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("x")), "a")
        .withColumn("both", F.size(F.array_intersect("x", "y")))
    )
    union = F.size("x") + F.size("y") - F.col("both")
    return durable(joined.filter(100 * F.col("both") >= percent * union).select(F.col("a").alias("u"), F.col("b").alias("v")))


def _bands(nodes: DataFrame) -> DataFrame:
    width = 2 * ROWS
    keys = F.transform(
        F.sequence(F.lit(0), F.lit(BANDS - 1)),
        lambda i: F.xxhash64(i, F.substring(F.col("sketch"), i * width + 1, F.lit(width))),
    )
    return nodes.select("doc_id", F.explode(keys).alias("band"))


def _labelled(bands: DataFrame, found: DataFrame) -> DataFrame:
    """Bands with the component that each member is in so far."""
    return bands.join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn(
        "component", F.coalesce("component", "doc_id")
    )


def _linked(percent: int):
    """Links between the outsiders and the members of one block, by counting common shingles; one per outsider and component."""

    def run(outside: pa.Table, inside: pa.Table) -> pa.Table:
        kind = inside.schema.field("doc_id").type
        schema = pa.schema([("u", kind), ("v", kind)])
        sizes = pa.compute.list_value_length(inside.column("shingles")).to_numpy()
        if not outside.num_rows or not inside.num_rows:
            return schema.empty_table()
        flat = inside.column("shingles").combine_chunks().flatten().to_numpy()
        owner = np.repeat(np.arange(len(sizes)), sizes)
        order = np.argsort(flat, kind="stable")
        flat, owner = flat[order], owner[order]
        ids, parts = inside.column("doc_id").to_pylist(), np.array(inside.column("component").to_pylist())
        found = set()
        for x, part, own in zip(*(outside.column(c) for c in ("doc_id", "component", "shingles")), strict=True):
            mine = own.values.to_numpy()
            lo, hi = np.searchsorted(flat, mine, "left"), np.searchsorted(flat, mine, "right")
            n = hi - lo
            at = np.repeat(lo - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())
            both = np.bincount(owner[at], minlength=len(sizes))
            good = (100 * both >= percent * (len(mine) + sizes - both)) & (parts != part.as_py())
            _, first = np.unique(parts[good], return_index=True)
            found |= {(x.as_py(), ids[i]) for i in np.flatnonzero(good)[first]}
        columns = list(zip(*sorted(found), strict=True)) if found else ((), ())
        return pa.table([pa.array(c, kind) for c in columns], schema=schema)

    return run


def _across(bands: DataFrame, nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between members of one band that are in different components.

    Those outside the band's largest component are compared with all others of the
    band, on full sets, in blocks of ``BLOCK_SHINGLES`` a side; only links come out.
    A band of two members has been settled already.
    """
    kind = dict(nodes.dtypes)["doc_id"]
    mixed = (
        bands.groupBy("band")
        .agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("n"))
        .filter("lo <> hi AND n > 2")
    )
    inside = durable(bands.join(mixed.select("band"), "band").join(nodes.select("doc_id", "n_shingles"), "doc_id"))
    groups = inside.groupBy("band", "component").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("held"))
    largest = durable(
        groups.groupBy("band")
        .agg(F.max(F.struct("n", "component", "held")).alias("top"), F.sum("held").alias("all"))
        .select(
            "band", F.col("top.component").alias("most"),
            F.ceil(F.col("all") / BLOCK_SHINGLES).cast("int").alias("ins"),
            F.ceil((F.col("all") - F.col("top.held")) / BLOCK_SHINGLES).cast("int").alias("outs"),
        )
    )
    placed = inside.select("doc_id", "band", "component").join(largest, "band")

    def block(own: str, other: str, turn: int) -> list[Column]:
        mine = F.pmod(F.xxhash64("doc_id", F.lit(turn)), F.col(own)).cast("int")
        return [mine, F.explode(F.sequence(F.lit(0), F.col(other) - 1))]

    i, j = block("outs", "ins", 1)
    outside = placed.filter(F.col("component") != F.col("most")).select("doc_id", "band", "component", i.alias("i"), j.alias("j"))
    j, i = block("ins", "outs", 2)
    members = placed.select("doc_id", "band", "component", j.alias("j"), i.alias("i"))
    key = ["band", "i", "j"]
    columns = [*key, "doc_id", "component", "shingles"]
    # Named anew, or the two sides would share their columns.
    left, right = (
        side.join(sets, "doc_id").select(*[F.col(c).alias(c) for c in columns]) for side in (outside, members)
    )
    return durable(
        left.groupBy(*key).cogroup(right.groupBy(*key))
        .applyInArrow(_linked(percent), f"u {kind}, v {kind}")
    )


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept``: one row per document.

    Documents are linked if their sets' intersection is at least ``percent``
    hundredths of their union; the least id of a component is its id and is kept.
    """
    if not 50 <= percent <= 100:
        raise ValueError("the bands are laid out for similarities of 50 to 100 percent")
    rows = durable(sketches(docs, k))
    filled = rows.filter("n_shingles > 0")
    classes = filled.groupBy("k1", "k2", "n_shingles").agg(F.min("doc_id").alias("node"))
    # The most alike of different sets hold n and n + 1 shingles, all n in common.
    reaches = (F.col("n_shingles") + 1) * percent <= 100 * F.col("n_shingles")
    nodes = durable(
        filled.filter(reaches).join(classes.select(F.col("node").alias("doc_id")).distinct(), "doc_id", "left_semi")
        .dropDuplicates(["doc_id"]).select("doc_id", "n_shingles", "sketch")
    )
    bands = _bands(nodes)
    shared = bands.groupBy("band").agg(F.min("doc_id").alias("a"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    met = durable(bands.join(shared, "band"))
    stars = met.filter("a <> doc_id").select("a", F.col("doc_id").alias("b")).distinct()
    sets = _sets(met.select("doc_id").distinct(), docs, k)
    links = _confirmed(stars, nodes, sets, percent)
    found = durable(components(links))
    rest = _across(_labelled(met.drop("a"), found), nodes, sets, percent)
    found = durable(components(links.unionByName(rest)))
    ids = classes.join(found, "node", "left").select(
        "k1", "k2", "n_shingles", F.coalesce("component", "node").alias("component_id")
    )
    alone: Column = F.col("n_shingles") == 0
    joined = filled.select("doc_id", "n_shingles", "k1", "k2").join(ids, ["k1", "k2", "n_shingles"])
    empty = rows.filter(alone).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return joined.select("doc_id", "n_shingles", "component_id").unionByName(empty).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False))
    )
