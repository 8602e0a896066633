"""Document fingerprints from closed syncmers. DataFrame functions only.

A window of k consecutive words is a closed syncmer if the least of its inner
s-word substrings, by hash, is the first or the last. Whether a window is chosen
depends on its own words alone, so an edit elsewhere moves no anchor. Words are
taken after lower-casing; with fewer than k words, the whole sequence is the
only anchor; without words there is none.

The fingerprint holds every anchor in order, as its hash of 32 bits and its
distance in words from the anchor before it; written, each takes nine hex digits.
Likeness matches anchors by position: an anchor agrees if the other fingerprint
has the same one at the same distance behind the same anchor, wherever the passage
stands. It is the share of agreeing places among all different ones of the two.
Two documents without anchors are alike (1); one with and one without are not (0).

Null texts count as empty. Equal texts have equal fingerprints. Repeated ids and
rows stay as they are; the next document is taken in order of id, then text. A
single document is followed by itself. An empty table gives an empty result.
Further columns are ignored.
"""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.llm.frames import text_of, words_of

K_WORDS = 3
S_WORDS = 1
CHUNK_BYTES = 64 << 20
#: Hex digits of a written anchor: eight of its hash, the first of its distance.
DIGITS = 9
HASH = 0xFFFFFFFF


def anchors(text: Column, k: int = K_WORDS, s: int = S_WORDS) -> Column:
    """``array<struct<position int, hash bigint>>`` of a text's closed syncmers; positions count words from 0."""

    def of_words(words: Column) -> Column:
        hashes = F.transform(words, lambda w: F.xxhash64(w))

        def of_hashes(h: Column) -> Column:
            inner = k - s  # the last inner substring starts here

            def substring(i: Column) -> Column:
                return h[i] if s == 1 else F.xxhash64(*[h[i + j] for j in range(s)])

            def chosen(i: Column) -> Column:
                least = F.least(*[substring(i + j) for j in range(inner + 1)])
                return (substring(i) == least) | (substring(i + inner) == least)

            starts = F.sequence(F.lit(0), F.size(h) - k)
            picked = F.transform(
                F.filter(starts, chosen),
                lambda i: F.struct(i.alias("position"), F.xxhash64(*[h[i + j] for j in range(k)]).alias("hash")),
            )
            whole = F.array(F.struct(F.lit(0).alias("position"), F.xxhash64(h, F.lit(k)).alias("hash")))
            none = F.filter(whole, lambda _: F.lit(False))
            return F.when(F.size(h) >= k, picked).when(F.size(h) > 0, whole).otherwise(none)

        return F.transform(F.array(hashes), of_hashes)[0]

    return F.transform(F.array(words_of(F.lower(text))), of_words)[0]


def fingerprint(found: Column) -> Column:
    """``array<bigint>`` of all anchors in order: the distance from the one before, then 32 bits of the hash.

    Neighbours stand at most ``k - s`` words apart, which has to fit one hex digit.
    """

    def of_anchors(a: Column) -> Column:
        def entry(x: Column, i: Column) -> Column:
            before = F.when(i == 0, 0).otherwise(F.get(a, i - 1)["position"])
            return F.shiftleft((x["position"] - before).cast("long"), 32).bitwiseOR(x["hash"].bitwiseAND(F.lit(HASH)))

        return F.transform(a, entry)

    return F.transform(F.array(found), of_anchors)[0]


def written(entries: Column) -> Column:
    """A fingerprint as text."""
    return F.lower(F.array_join(F.transform(entries, lambda e: F.lpad(F.hex(e), DIGITS, "0")), ""))


def places(entries: Column) -> Column:
    """The different places of a fingerprint: an anchor, its distance from the one before, and that one's hash."""

    def of_entries(e: Column) -> Column:
        return F.transform(
            e, lambda x, i: F.when(i == 0, x).otherwise(F.xxhash64(F.get(e, i - 1).bitwiseAND(F.lit(HASH)), x))
        )

    return F.array_distinct(F.transform(F.array(entries), of_entries)[0])


def likeness(left: Column, right: Column) -> Column:
    """Share of common places among all of two fingerprints' ``places``, 0 to 1."""

    def of_common(common: Column) -> Column:
        union = F.size(left) + F.size(right) - common
        return F.when(union == 0, 1.0).otherwise(common / union)

    return F.transform(F.array(F.size(F.array_intersect(left, right))), of_common)[0]


def fingerprints(docs: DataFrame, k: int = K_WORDS, s: int = S_WORDS) -> DataFrame:
    """``doc_id, fingerprint, anchors`` of every document."""
    found = docs.select("doc_id", anchors(text_of(), k, s).alias("anchors"))
    return found.select("doc_id", written(fingerprint(F.col("anchors"))).alias("fingerprint"), "anchors")


def _chunked(docs: DataFrame) -> DataFrame:
    """Documents with ``chunk``, a function of the id alone that cuts the order of ids into even ranges.

    The bounds are one id per ``CHUNK_BYTES`` of text, eight bytes in some ten millions
    of them, from one cut of the ids alone. A row finds its range in two steps, each over
    about as many bounds as the root of their number. Null ids come first.
    """
    spark = docs.sparkSession
    total = docs.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("bytes")).first()
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(total["bytes"] or 0) // CHUNK_BYTES))
    n = max(1, min(n, total["n"]))
    cut = docs.select("doc_id").repartitionByRange(n, "doc_id").groupBy(F.spark_partition_id()).agg(F.min("doc_id").alias("least"))
    bounds = sorted(r["least"] for r in cut.collect() if r["least"] is not None)
    if not bounds:
        return docs.withColumn("chunk", F.lit(0))
    step = isqrt(len(bounds))
    ranges = [(g + 1, bounds[i : i + step]) for g, i in enumerate(range(0, len(bounds), step))]
    tops = F.array(*[F.lit(inner[0]).cast("long") for _, inner in ranges])
    inner = spark.createDataFrame(ranges, "range int, inner array<long>")
    reached = F.size(F.filter(tops, lambda b: b <= F.col("doc_id")))
    placed = docs.withColumn("range", F.when(F.col("doc_id").isNull(), 0).otherwise(reached)).join(F.broadcast(inner), "range", "left")
    within = F.size(F.filter("inner", lambda b: b <= F.col("doc_id")))
    chunk = F.when(F.col("range") < 1, 0).otherwise((F.col("range") - 1) * step + within)
    return placed.withColumn("chunk", chunk).drop("range", "inner")


def _followed(cut: DataFrame) -> DataFrame:
    """The documents, and the first of each chunk once more as the ``tail`` of the chunk before it.

    Chunks form a ring, the last leads to the first. One narrow row per chunk is
    broadcast; the texts travel with the others.
    """
    order = F.struct("doc_id", F.xxhash64("text").alias("digest"))
    firsts = cut.groupBy("chunk").agg(F.min(order).alias("first"))
    ring = Window.orderBy("chunk")
    everything = ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = F.coalesce(F.lag("chunk").over(ring), F.last("chunk").over(everything))
    firsts = firsts.select(F.col("chunk").alias("of"), "first", before.alias("before"))
    heads = F.when(order.eqNullSafe(F.col("first")), F.array(F.struct(F.col("before").alias("chunk"), F.lit(1).alias("tail"))))
    own = F.array(F.struct(F.col("chunk"), F.lit(0).alias("tail")))
    none = F.filter(own, lambda _: F.lit(False))
    return (
        cut.join(F.broadcast(firsts), F.col("chunk") == F.col("of"))
        .select("doc_id", "text", F.explode(F.concat(own, F.coalesce(heads, none))).alias("place"))
        .select("doc_id", "text", "place.chunk", "place.tail")
    )


def compare_edited(docs: DataFrame, k: int = K_WORDS, s: int = S_WORDS) -> DataFrame:
    """Fingerprints of every document and of its edited text, and their likeness to it and to the next document.

    The edited text has its last quarter of characters replaced by the first ones
    of the next document. Texts move once, to their place in the order of ids.
    """
    if not 0 <= k - s < 16:
        raise ValueError("anchors may stand at most 15 words apart")
    inside = Window.partitionBy("chunk").orderBy("tail", F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))

    def entries(text: Column) -> Column:
        return fingerprint(anchors(text, k, s))

    n_chars = F.length("text")
    moved = F.floor(n_chars / 4).cast("int")
    edited = F.concat(F.col("text").substr(F.lit(1), n_chars - moved), F.col("next").substr(F.lit(1), moved))
    told = (
        _followed(_chunked(docs.select("doc_id", text_of().alias("text"))))
        .repartition("chunk")
        .withColumn("own", entries(F.col("text")))
        .withColumn("next", F.lead("text").over(inside))
        .withColumn("after", F.lead("own").over(inside))
        .filter("tail = 0")
        .select("doc_id", n_chars.cast("long").alias("n_chars"), edited.alias("edited"), "own", "after")
        .select(
            "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
            "own", entries(F.col("edited")).alias("other"), "after",
        )
        .select(
            "doc_id", "n_chars", "edited_sha256",
            written(F.col("own")).alias("fingerprint"), written(F.col("other")).alias("edited_fingerprint"),
            *[places(F.col(c)).alias(c) for c in ("own", "other", "after")],
        )
    )
    return told.select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("own"), F.col("other")).alias("near_edited"),
        likeness(F.col("own"), F.col("after")).alias("near_next"),
    )
