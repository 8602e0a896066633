"""Scoring documents by the difference of two language models' cross-entropies (Moore and Lewis, 2010).

Two bigram models, one of a target corpus and one of all documents, share one
vocabulary, one order and one smoothing, so a difference in loss per token comes
from the texts alone. A lower difference means closer to the target.

Words are lower-cased and end at blanks. Every word and every pair of words of the
corpus is counted, under hashes of 64 bits. A pair is smoothed towards the frequency
of its second word with ``PRIOR`` pseudo-tokens, and that one by adding one to the
count of each word and of one more, which stands for words that were not counted.

1. Chunks. Texts become chunks of about ``HELD`` tokens: ids, sizes, the chunk's
   words and one number per token, packed. They are written once, to the shared
   folder, and all that follows reads them.
2. Counts. A chunk counts its own words and pairs and sends them, sorted and packed,
   to buckets by the leading bits of their hash; there are so many buckets that one
   gets about ``BUCKET`` tokens' worth. A word or pair that a third of all texts hold is
   one entry per chunk, so no bucket is hot. A bucket adds up and answers
   each chunk with the corpus's counts, in the order of the entries.
3. Losses. A chunk meets its answers and sums the loss of each of its texts.

Two totals, the number of words and the number of chunks' tokens are all that
reaches the driver; nothing is broadcast. Texts that were not counted may be scored:
their chunks ask without adding to the counts.

Null and wordless texts have no tokens and null losses. Documents are in the
target if one of their labels says so; rows that repeat count each. Without target
texts, the target model is uniform. An empty table gives an empty result. Further
columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from pagemill.plans.scratch import scratch_path

PRIOR = 500.0
#: Tokens after which a chunk ends, with the text it is in, and the texts it may have at most.
HELD = 1 << 20
MOST_TEXTS = 1 << 16
#: Tokens' worth of entries in a bucket.
BUCKET = 1 << 21
WORDS, PAIRS = 0, 1


def _hash(word: str) -> int:
    return xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))


_START = np.uint64(_hash(""))  # stands before the first word


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One number for two."""
    x = a * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(32))) + b
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays of numbers from 0, each by planes of as many bytes as its largest number needs."""
    parts = []
    for a in arrays:
        wide = np.ascontiguousarray(a, "<u8")
        width = (int(wide.max()).bit_length() + 7) // 8 if len(wide) else 0
        parts += [len(wide).to_bytes(8, "little"), bytes([width])]
        parts.append(np.ascontiguousarray(wide.view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes())
    return zstandard.compress(b"".join(parts), 1)


def _unpack(packed: bytes) -> list[np.ndarray]:
    data = np.frombuffer(zstandard.decompress(packed), np.uint8)
    out, at = [], 0
    while at < len(data):
        n, width = int.from_bytes(data[at : at + 8].tobytes(), "little"), int(data[at + 8])
        at += 9
        wide = np.zeros((n, 8), np.uint8)
        wide[:, :width] = data[at : at + n * width].reshape(width, n).T
        out.append(wide.reshape(-1).view("<u8"))
        at += n * width
    return out


def _chunks(kind: pa.DataType, most: int):
    """``doc_id, text, wanted`` to chunks: ids, ``tokens``, and packed words, numbers of tokens, sizes and target flags."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, wanted, sizes, numbers, held = [], [], [], [], 0
        known: dict[str, int] = {}

        def emit() -> pa.RecordBatch:
            words = np.fromiter(map(_hash, known), np.uint64, len(known))
            sequence = np.concatenate([np.empty(0, np.int64), *numbers])
            content = _pack(words, sequence, np.array(sizes, np.int64), np.array(wanted, np.int64))
            target = sum(n for n, w in zip(sizes, wanted, strict=True) if w)
            return pa.RecordBatch.from_arrays(
                [pa.array([ids], pa.list_(kind)), pa.array([held], pa.int64()), pa.array([target], pa.int64()), pa.array([content], pa.binary())],
                ["ids", "tokens", "target", "content"],
            )

        for batch in batches:
            for doc_id, text, flag in zip(*batch.columns, strict=True):
                words = (text.as_py() or "").lower().split()
                for word in set(words).difference(known):
                    known[word] = len(known)
                ids.append(doc_id.as_py())
                wanted.append(flag.as_py())
                sizes.append(len(words))
                numbers.append(np.fromiter(map(known.__getitem__, words), np.int64, len(words)))
                held += len(words)
                if held >= most or len(ids) >= MOST_TEXTS:
                    yield emit()
                    ids, wanted, sizes, numbers, held = [], [], [], [], 0
                    known = {}
        if ids:
            yield emit()

    return run


class _Chunk:
    """A chunk's tokens as places among its sorted words and sorted pairs."""

    def __init__(self, content: bytes):
        words, sequence, sizes, wanted = _unpack(content)
        self.sizes = sizes.astype(np.int64)
        self.wanted = np.repeat(wanted.astype(bool), self.sizes)
        # Before the first word of a text stands the start, a word of its own.
        self.words, place = np.unique(np.append(words, _START), return_inverse=True)
        own = place[sequence.astype(np.int64)]
        before = np.empty_like(own)
        before[1:] = own[:-1]
        before[(np.cumsum(self.sizes) - self.sizes)[self.sizes > 0]] = place[-1]
        self.own, self.before = own, before
        self.pairs, self.pair = np.unique(_mixed(self.words[before], self.words[own]), return_inverse=True)

    def counts(self, kind: int) -> list[np.ndarray]:
        """Counts everywhere and in the target: of pairs, or of words and of words with another behind."""
        size = len(self.words if kind == WORDS else self.pairs)
        return [
            np.bincount(places[which], minlength=size)
            for places in ((self.own, self.before) if kind == WORDS else (self.pair,))
            for which in (slice(None), self.wanted)
        ]


def _bucket_rows(bits: int, adds: bool):
    """``chunk, content`` to ``bucket, kind, chunk, entries``: packed steps between keys and, if they add, counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(*batch.columns, strict=True):
                chunk, rows = _Chunk(content.as_py()), []
                for kind, keys in ((WORDS, chunk.words), (PAIRS, chunk.pairs)):
                    counts = chunk.counts(kind) if adds else []
                    edges = np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits) if bits else np.zeros(1, np.uint64)
                    cuts = np.append(np.searchsorted(keys, edges), len(keys))
                    for bucket in np.flatnonzero(np.diff(cuts)):
                        lo, hi = cuts[bucket], cuts[bucket + 1]
                        # Steps from the bucket's edge on: they need fewer bytes than keys.
                        steps = np.diff(keys[lo:hi], prepend=edges[bucket])
                        rows.append((int(bucket), kind, name.as_py(), adds, _pack(steps, *(c[lo:hi] for c in counts))))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), _BUCKET_TYPES, strict=True)],
                    ["bucket", "kind", "chunk", "adds", "entries"],
                )

    return run


_BUCKET_TYPES = [pa.int64(), pa.int32(), pa.int64(), pa.bool_(), pa.binary()]
_BUCKET_ROW = "bucket long, kind int, chunk long, adds boolean, entries binary"


def _answers(asks: bool):
    """A bucket's entries of one kind to ``chunk, kind, bucket, sums``: the sums of counts, for the chunks that ask.

    Chunks ask by their own entries, which add, or by entries without counts.
    """

    def run(table: pa.Table) -> pa.Table:
        bucket, kind = table.column("bucket")[0].as_py(), table.column("kind")[0].as_py()
        names, adds = table.column("chunk").to_pylist(), table.column("adds").to_pylist()
        keys, counts = [], []
        for entries, adding in zip(table.column("entries"), adds, strict=True):
            steps, *own = _unpack(entries.as_py())
            keys.append(np.cumsum(steps, dtype=np.uint64))
            counts.append(own if adding else [np.zeros(len(steps), np.uint64)] * (4 if kind == WORDS else 2))
        _, place = np.unique(np.concatenate(keys), return_inverse=True)
        # Counts below 2 ** 53 are whole in the doubles that bincount adds.
        sums = [np.bincount(place, weights=np.concatenate(c)).astype(np.uint64) for c in zip(*counts, strict=True)]
        ends = np.cumsum([len(k) for k in keys])
        rows = []
        for name, adding, own, end in zip(names, adds, keys, ends, strict=True):
            if adding == asks:
                at = place[end - len(own) : end]
                rows.append((name, kind, bucket, _pack(*(s[at] for s in sums))))
        columns = list(zip(*rows, strict=True)) if rows else [()] * 4
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.binary()]
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["chunk", "kind", "bucket", "sums"])

    return run


@dataclass
class Model:
    """One corpus: which of the two counts of each entry are its own, and how many tokens it has."""

    side: int
    tokens: int

    def losses(self, pair: np.ndarray, own: np.ndarray, before: np.ndarray, words: int) -> np.ndarray:
        """The negative log-probability of a pair, from its count, that of its second word and that of pairs with its first."""
        base = (own + 1) / (self.tokens + words + 1)
        return np.log(before + PRIOR) - np.log(pair + PRIOR * base)


def _score_rows(kind: pa.DataType, words: int, models: tuple[Model, Model]):
    """A chunk and its answers to the losses of its texts."""

    def run(chunks: pa.Table, answers: pa.Table) -> pa.Table:
        ids = chunks.column("ids").combine_chunks().flatten()
        chunk = _Chunk(chunks.column("content")[0].as_py())
        sums = {}
        for which in (WORDS, PAIRS):
            mine = answers.filter(pc.equal(answers.column("kind"), which)).sort_by("bucket")
            parts = [_unpack(s.as_py()) for s in mine.column("sums")]
            sums[which] = [np.concatenate(p).astype(np.float64) for p in zip(*parts, strict=True)]
        text = np.repeat(np.arange(len(chunk.sizes)), chunk.sizes)
        empty = chunk.sizes == 0
        means = []
        for model in models:
            if len(text):
                pair, own, before = sums[PAIRS][model.side], sums[WORDS][model.side], sums[WORDS][2 + model.side]
                loss = model.losses(pair[chunk.pair], own[chunk.own], before[chunk.before], words)
                total = np.bincount(text, weights=loss, minlength=len(empty))
            else:
                total = np.zeros(len(empty))
            means.append(total / np.maximum(chunk.sizes, 1))
        means.append(means[0] - means[1])
        return pa.Table.from_arrays(
            [pa.array(ids, kind), pa.array(chunk.sizes), *(pa.array(m, mask=empty) for m in means)],
            ["doc_id", "n_tokens", "target_loss", "background_loss", "difference"],
        )

    return run


class Counts:
    """The chunks of counted documents; its length is the number of different words."""

    def __init__(self, docs: DataFrame, chunks: DataFrame, words: int, held: int):
        self.docs, self.chunks, self.words, self.held = docs, chunks, words, held

    def __len__(self) -> int:
        return self.words


def _id_type(docs: DataFrame) -> tuple[str, pa.DataType]:
    field = docs.schema["doc_id"]
    return field.dataType.simpleString(), to_arrow_type(field.dataType)


def _written_chunks(flagged: DataFrame, most: int) -> DataFrame:
    spark = flagged.sparkSession
    name, kind = _id_type(flagged)
    made = flagged.select("doc_id", "text", "wanted").mapInArrow(_chunks(kind, most), f"ids array<{name}>, tokens long, target long, content binary")
    path = scratch_path(spark, "chunks")
    # The number of a chunk is fixed by being written.
    made.withColumn("chunk", F.monotonically_increasing_id()).write.parquet(path)
    return spark.read.parquet(path)


def _distinct_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for content in batch.column(0):
            yield pa.RecordBatch.from_arrays([pa.array(_unpack(content.as_py())[0].view(np.int64))], ["word"])


def train(docs: DataFrame, targets: DataFrame, held: int = HELD) -> tuple[Counts, Model, Model]:
    """The counts and the models of the documents named in ``targets(doc_id)`` and of all documents."""
    named = targets.select(F.col("doc_id").alias("_of")).distinct().withColumn("wanted", F.lit(True))
    # The named documents grow with the corpus: they are never broadcast, at any size.
    flagged = docs.select("doc_id", "text").join(named.hint("merge"), F.col("doc_id") == F.col("_of"), "left")
    chunks = _written_chunks(flagged.withColumn("wanted", F.coalesce("wanted", F.lit(False))), held)
    words = chunks.select("content").mapInArrow(_distinct_words, "word long").distinct().count()
    tokens, target = chunks.agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("tokens", "target"))).first()
    return Counts(docs, chunks, words, held), Model(1, target), Model(0, tokens)


def score(docs: DataFrame, counts: Counts, target: Model, background: Model, per_bucket: int = BUCKET) -> DataFrame:
    """``doc_id, n_tokens, target_loss, background_loss, difference`` from whole texts."""
    name, kind = _id_type(docs)
    same = docs.sameSemantics(counts.docs)
    chunks = counts.chunks if same else _written_chunks(docs.withColumn("wanted", F.lit(False)), counts.held)
    asked = background.tokens if same else background.tokens + chunks.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    bits = max(0, math.ceil(math.log2(max(asked, 1) / per_bucket)))
    entries = counts.chunks.select("chunk", "content").mapInArrow(_bucket_rows(bits, True), _BUCKET_ROW)
    if not same:
        entries = entries.unionByName(chunks.select("chunk", "content").mapInArrow(_bucket_rows(bits, False), _BUCKET_ROW))
    answers = entries.groupBy("bucket", "kind").applyInArrow(_answers(same), "chunk long, kind int, bucket long, sums binary")
    result = f"doc_id {name}, n_tokens long, target_loss double, background_loss double, difference double"
    return (
        chunks.select("chunk", "ids", "content").groupBy("chunk")
        .cogroup(answers.groupBy("chunk"))
        .applyInArrow(_score_rows(kind, counts.words, (target, background)), result)
    )
