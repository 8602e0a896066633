"""Token ids in Parquet files that can be read in part.

Documents are cut by range of their id into shards of a bounded number of bytes;
a task sorts its shard, encodes it and writes one file, so the files hold the
corpus in ascending order of ids. A row is a document: its id, its shard, the ids
before it in the shard, its number of ids, the columns kept beside it, and the ids
as a list. Row groups and pages have set sizes and a page index, ids are encoded
by dictionary or by delta, and everything but the list can be read without it. A
second small table holds the ids before each shard.

A null text is an empty one and has its end id only; a null id stands first.
Rows of one id stand beside each other in the order of a hash of their text,
repeated rows as often as they occur. An empty table gives files without rows.
Further columns are written only where ``keep`` names them, inside one struct, so
their names can't clash.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagemill.llm.frames import fresh
from pagemill.llm.vector_packing import _byte_of_character

END = 0
SHARD_BYTES = 1 << 30
BLOCK_BYTES = 1 << 23  # at most as many ids
KNOWN_PIECES = 900_000
PIECE_CHARS = 48

# Letters, digits and blanks up to U+024F and of general punctuation, which all Unicode versions class alike.
_LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
_DIGITS = "0-9²³¹¼-¾"
_BLANKS = "\t-\r \u0085\u00a0"
_OTHERS = r"[^\x{0}-\x{24f}\x{2010}-\x{2027}\x{2030}-\x{205e}]"
# Fixed value: how byte-level vocabularies cut a text before merging, with the classes spelled out.
_PIECE = re.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]++| ?[{_DIGITS}]++| ?[^{_LETTERS}{_DIGITS}{_BLANKS}]++"
    rf"|[{_BLANKS}]+(?![^{_BLANKS}])|[{_BLANKS}]+"
)
# The patterns that are plain strings are matched on whole columns.
_ONE_PIECE = rf"\A ?[{_LETTERS}]+\z"
# A blank between a blank and a space, or at the end behind a blank: a cut before it would part a run of blanks.
_INSIDE_BLANKS = rf"[{_BLANKS}] (?:[{_BLANKS}]|\z)"
_SPELLED = {byte: char for char, byte in _byte_of_character().items()}
_SPACE = _SPELLED[ord(" ")]


class TokenIds:
    """Ids of a text as little-endian 32-bit numbers, all from the tokenizer of the file.

    A byte-level vocabulary merges inside pieces only, so a piece seen before needs
    no second call, and a new one goes straight to the tokenizer's model; up to about
    ``KNOWN_PIECES`` short ones are remembered. A piece starts at
    every space that is first or last of a run of blanks, so texts without other
    spaces are cut there first. Texts with characters outside the
    listed classes, or that spell an added token, go to the tokenizer whole, as do
    all texts of other vocabularies.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        given = json.loads(self.tokenizer.to_str())
        cut = given.get("pre_tokenizer") or {}
        self.by_piece = (
            given.get("normalizer") is None
            and given["model"].get("type") == "BPE"
            and not given["model"].get("dropout")
            and cut.get("type") == "ByteLevel"
            and cut.get("use_regex", True)
            and not cut.get("add_prefix_space")
        )
        self.added = [t["content"] for t in given["added_tokens"]]
        self.model = self.tokenizer.model
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def encode(self, text: str) -> bytes:
        return self.encode_block([text])[0].tobytes()

    def encode_block(self, texts: list[str] | pa.StringArray, end: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, each text's followed by ``end``, and where each text's begin and end.

        Texts are cut before spaces, each different chunk is cut into pieces once, and each different piece is looked up once.
        """
        if isinstance(texts, list):
            texts = pa.array(texts, pa.string())
        whole, pieces = self._kinds(texts)
        spaced = ~(whole | pieces)
        split = pc.split_pattern(texts.filter(pa.array(spaced)), " ")
        chunks, cuts = split.values.dictionary_encode(), split.offsets.to_numpy()
        codes = chunks.indices.to_numpy().copy()
        heads = chunks.take(pa.array(cuts[:-1])).cast(pa.string())  # no space before these
        codes[cuts[:-1]] = len(chunks.dictionary) + np.arange(len(heads))
        units = pa.concat_arrays([pc.binary_replace_slice(chunks.dictionary, 0, 0, " "), heads, texts.filter(pa.array(pieces))])
        last = len(units) + int(whole.sum())
        rest = [*map(self._whole, _strings(texts.filter(pa.array(whole)))), np.array(end, "<u4").tobytes()]
        lists = pa.concat_arrays([self._units(units), pa.array(rest, pa.large_binary())])

        sizes = np.full(len(texts), 2)  # one unit, or as many as chunks, and the end
        sizes[spaced] = np.diff(cuts) + 1
        ends = np.cumsum(sizes)
        order = np.full(sizes.sum(), last, np.int32)
        for kind, which in (
            (spaced, codes),
            (pieces, np.arange(len(units) - int(pieces.sum()), len(units))),
            (whole, np.arange(len(units), last)),
        ):
            of_kind = np.repeat(kind, sizes)
            of_kind[ends - 1] = False
            order[of_kind] = which
        _, bounds, ids = _strung(lists, order, ends).buffers()
        bounds = np.frombuffer(bounds, np.int64) // 4
        return np.frombuffer(ids or b"", "<u4", bounds[-1]), bounds

    def _kinds(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """Which texts go to the tokenizer whole, and which of the others are cut into pieces without a cut before spaces."""
        if not self.by_piece:
            return np.ones(len(texts), bool), np.zeros(len(texts), bool)
        whole = pc.match_substring_regex(texts, _OTHERS)
        for content in self.added:
            whole = pc.or_(whole, pc.match_substring(texts, content))
        pieces = pc.and_not(pc.match_substring_regex(texts, _INSIDE_BLANKS), whole)
        return whole.to_numpy(zero_copy_only=False), pieces.to_numpy(zero_copy_only=False)

    def _units(self, units: pa.StringArray) -> pa.LargeBinaryArray:
        """Ids of texts that are encoded by piece."""
        single = pc.match_substring_regex(units, _ONE_PIECE).to_numpy(zero_copy_only=False)
        cut = list(map(_PIECE.findall, _strings(units.filter(pa.array(~single)))))
        sizes = np.ones(len(units), np.int64)
        sizes[~single] = np.fromiter(map(len, cut), np.int64, len(cut))
        cut = pa.array(list(chain.from_iterable(cut)), pa.string())
        pieces = pa.concat_arrays([units.filter(pa.array(single)), cut]).dictionary_encode()
        codes, which, alone = pieces.indices.to_numpy(), np.empty(sizes.sum(), np.int32), np.repeat(single, sizes)
        which[alone], which[~alone] = np.split(codes, [len(codes) - len(cut)])
        found = self._pieces(_strings(pieces.dictionary))
        return _strung(pa.array(found, pa.large_binary()), which, np.cumsum(sizes))

    def _pieces(self, names: list[str]) -> list[bytes]:
        """Ids of different pieces."""
        found = list(map(self.known.get, names))  # one look-up per different piece
        for i in [i for i, ids in enumerate(found) if ids is None]:
            name = names[i]
            found[i] = ids = self.older.get(name) or self._learned(name)
            if len(name) <= PIECE_CHARS:
                self.known[name] = ids
        if len(self.known) > KNOWN_PIECES // 2:  # what is still in use moves over
            self.older, self.known = self.known, {name: ids for name, ids in zip(names, found, strict=True) if len(name) <= PIECE_CHARS}
        return found

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learned(self, piece: str) -> bytes:
        plain = piece.isascii() and piece.isprintable()  # only the space is spelled otherwise
        spelled = piece.replace(" ", _SPACE) if plain else piece.encode().decode("latin-1").translate(_SPELLED)
        tokens = self.model.tokenize(spelled)
        return struct.pack(f"<{len(tokens)}I", *[t.id for t in tokens])


def _strings(column: pa.StringArray) -> list[str]:
    return column.to_numpy(zero_copy_only=False).tolist()  # without a scalar for each, as to_pylist has


def _strung(lists: pa.LargeBinaryArray, which: np.ndarray, ends: np.ndarray) -> pa.LargeBinaryArray:
    """The lists ``which``, in that order and as often as named, put together up to each of ``ends``."""
    taken = lists.take(pa.array(which))
    _, bounds, ids = taken.buffers()
    bounds = np.frombuffer(bounds, np.int64, len(taken) + 1)[np.append(0, ends)]
    return pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(bounds), ids])


@lru_cache(maxsize=1)
def token_ids(path: str) -> TokenIds:
    """One per worker process."""
    return TokenIds(path)


def _encoder(path: str, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = token_ids(path).encode_block
        shard, at = TaskContext.get().partitionId(), 0

        def emit(part: pa.RecordBatch, texts: pa.StringArray) -> pa.RecordBatch:
            nonlocal at
            ids, bounds = encode(texts, (end,))
            columns = [
                part.column(0), part.column(2),
                pa.array(np.full(len(texts), shard, np.int32)), pa.array(at + bounds[:-1]), pa.array(np.diff(bounds)),
                pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids.view("<i4"))),
            ]
            at += int(bounds[-1])
            return pa.RecordBatch.from_arrays(columns, ["doc_id", "kept", "shard", "at", "n_tokens", "tokens"])

        for batch in batches:
            texts = pc.fill_null(batch.column(1), "")
            ends = np.cumsum(pc.binary_length(texts).to_numpy(), dtype=np.int64)
            begin = 0
            while begin < batch.num_rows:  # a block ends with the text that fills it
                full = (ends[begin - 1] if begin else 0) + BLOCK_BYTES
                stop = min(int(np.searchsorted(ends, full)) + 1, batch.num_rows)
                yield emit(batch.slice(begin, stop - begin), texts.slice(begin, stop - begin))
                begin = stop

    return run


def write_tokens(
    docs: DataFrame,
    path: str,
    tokenizer: str,
    keep: tuple[str, ...] = (),
    encoding: str = "dictionary",
    end: int = END,
    group_bytes: int = 64 << 20,
    page_bytes: int = 256 << 10,
    shard_bytes: int = SHARD_BYTES,
) -> None:
    """Write ``docs`` (``doc_id``, ``text``) to ``path`` in ascending order of ids.

    ``encoding`` is ``dictionary`` or ``delta``. ``tokenizer`` is the path of a
    tokenizer file that every machine can read.
    """
    if encoding not in ("dictionary", "delta"):
        raise ValueError(f"unknown encoding {encoding!r}")
    spark = docs.sparkSession
    tie = fresh("tie")
    kept = F.struct(*[F.col(c) for c in keep]) if keep else F.struct(F.lit(True).alias("all"))
    rows = docs.select("doc_id", "text", kept.alias("kept")).withColumn(tie, F.xxhash64("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // shard_bytes))
    order = [F.col("doc_id").asc_nulls_first(), F.col(tie)]
    in_order = rows.repartitionByRange(shards, *order).sortWithinPartitions(*order, "text").drop(tie)
    key, held = dict(docs.dtypes)["doc_id"], dict(rows.dtypes)["kept"]
    encoded = in_order.mapInArrow(
        _encoder(tokenizer, end),
        f"doc_id {key}, kept {held}, shard int, at long, n_tokens long, tokens array<int>",
    )
    (
        encoded.write.option("compression", "zstd")
        .option("parquet.writer.version", "PARQUET_2_0")  # delta encoding and page checks need the second version
        .option("parquet.enable.dictionary#tokens.list.element", str(encoding == "dictionary").lower())
        .option("parquet.dictionary.page.size", str(4 << 20))
        .option("parquet.block.size", str(group_bytes))
        .option("parquet.page.size", str(page_bytes))
        .option("parquet.page.row.count.limit", "4096")
        # A row may be a very long document: sizes are looked at every few rows.
        .option("parquet.page.size.row.check.min", "10")
        .option("parquet.page.size.row.check.max", "1000")
        .parquet(f"{path}/rows")
    )
    totals = _rows(spark, path).groupBy("shard").agg(F.sum("n_tokens").alias("ids"))
    # One row per shard, so one task orders at most the corpus' bytes over ``shard_bytes`` rows.
    before = F.sum("ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    totals.select("shard", F.coalesce(before, F.lit(0)).alias("before")).write.parquet(f"{path}/shards")


def _rows(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/rows")


def _started(spark: SparkSession, path: str, rows: DataFrame) -> DataFrame:
    shards = spark.read.parquet(f"{path}/shards")
    return rows.join(shards, "shard").withColumn("start", F.col("before") + F.col("at")).drop("before", "at", "shard")


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, n_tokens, start, kept`` of all documents; the ids stay unread."""
    return _started(spark, path, _rows(spark, path).drop("tokens"))


def read_tokens(spark: SparkSession, path: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """``doc_id, n_tokens, tokens, start`` of the documents from id ``first`` to ``last``.

    Files are in order of ids, so the bounds leave out files and row groups by their
    statistics and pages by the index.
    """
    rows = _rows(spark, path).drop("kept")
    if first is not None:
        rows = rows.filter(F.col("doc_id") >= first)
    if last is not None:
        rows = rows.filter(F.col("doc_id") <= last)
    return _started(spark, path, rows)


def token_digests(spark: SparkSession, path: str) -> DataFrame:
    """Per document of the files ``doc_id, start, n_tokens, ids_crc32``, counted and summed from the ids read back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            ends = lists.offsets.to_numpy()
            data = memoryview(lists.values.to_numpy(zero_copy_only=False).astype("<u4")).cast("B")
            sums = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            columns = [*(batch.column(i) for i in range(3)), pa.array(np.diff(ends).astype(np.int64)), pa.array(sums, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "shard", "at", "n_tokens", "ids_crc32"])

    rows = _rows(spark, path)
    read = rows.select("doc_id", "shard", "at", "tokens").mapInArrow(
        run, f"doc_id {dict(rows.dtypes)['doc_id']}, shard int, at long, n_tokens long, ids_crc32 long"
    )
    return _started(spark, path, read).select("doc_id", "start", "n_tokens", "ids_crc32")
