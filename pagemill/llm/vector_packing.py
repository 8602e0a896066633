"""Packing examples into sequences: vector bin packing by the dot-product heuristic.

A sequence has a limit in several dimensions at once: tokens, segments, and
tokens that bear loss. An example is a vector in the same dimensions. A sequence
is filled by taking, again and again, the example that still fits and whose
vector has the largest dot product with what is left in it, each dimension
weighted by how scarce it is among the examples (Panigrahy et al., 2011).

Examples longer than a sequence are cut into full sequences first; only their
last parts are packed. Where cutting is allowed, the emptiest sequences of a
block are taken apart at the end and their tokens, cut to measure, fill the gaps
of the others.

A block is at most ``BLOCK`` examples of one scan task, so memory is bounded by a
block and nothing is shuffled. A task has one sequence that is not full per
block. Sequence ids are made of the task's number and a counter.

A null text is an empty one and has its end token only; a null id is kept.
Repeated rows are packed as often as they occur. An empty table gives an empty
result. Further columns are ignored.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LENGTH = 1024
SEGMENTS = 64
BLOCK = 16_384
END = 0
# Fixed value: how byte-level vocabularies cut a text before merging.
BYTE_LEVEL_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_OTHER = re.compile("[^\x00-\u024f\u2010-\u2027\u2030-\u205e]")

PIECES = (
    "doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
)


def _byte_of_character() -> dict[str, int]:
    """How byte-level vocabularies spell bytes: printable ones as themselves, the others as characters from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(0x100 + i): b for i, b in enumerate(others)}


class Encoder:
    """Token ids of texts as little-endian 32-bit numbers, ending with ``END``.

    The ids are those of the tokenizer file. For a plain byte-level vocabulary,
    whose ids are in order of merging, a faster encoder is made of the same
    vocabulary; it takes texts of characters that every Unicode version classes
    alike and that spell no special token. All others go to the tokenizer itself.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.end = np.array([END], "<u4").tobytes()
        self.fast = None
        given = json.loads(self.tokenizer.to_str())
        splits, model = given.get("pre_tokenizer") or {}, given["model"]
        plain = (
            splits.get("type") == "ByteLevel" and not splits.get("add_prefix_space") and splits.get("use_regex", True)
            and given.get("normalizer") is None and model.get("type") == "BPE" and not model.get("ignore_merges")
            and not model.get("dropout") and not model.get("continuing_subword_prefix") and not model.get("end_of_word_suffix")
        )
        self.special = re.compile("|".join(re.escape(t["content"]) for t in given["added_tokens"]) or r"(?!)")
        if plain:
            import tiktoken

            byte_of, added = _byte_of_character(), {t["content"] for t in given["added_tokens"]}
            ranks = {bytes(map(byte_of.__getitem__, t)): i for t, i in model["vocab"].items() if t not in added}
            self.fast = tiktoken.Encoding("same", pat_str=BYTE_LEVEL_SPLIT, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str | None) -> bytes:
        if not text:
            return self.end
        if self.fast is None or _OTHER.search(text) or self.special.search(text):
            ids = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")
        else:
            ids = self.fast.encode_to_numpy(text, disallowed_special=()).astype("<u4")
        return ids.tobytes() + self.end


@lru_cache(maxsize=1)
def encoder_of(path: str) -> Encoder:
    """One encoder per worker process."""
    return Encoder(path)


def pack_vectors(sizes: np.ndarray, limits: np.ndarray) -> list[list[int]]:
    """Bins of example numbers. ``sizes`` has a row per example and a column per dimension; each fits ``limits``.

    Examples of equal size vectors are kept together, so a step looks at kinds, of
    which there are few, and not at examples.
    """
    if not len(sizes):
        return []
    kinds, kind_of = np.unique(sizes, axis=0, return_inverse=True)
    members: list[list[int]] = [[] for _ in kinds]
    for i, kind in enumerate(kind_of.ravel()):
        members[kind].append(i)
    for stack in members:
        stack.reverse()
    left_of_kind = np.array([len(m) for m in members])
    share = kinds / limits
    need = share * (share.T @ left_of_kind)  # scarce dimensions weigh more
    bins: list[list[int]] = []
    alive = np.arange(len(kinds))
    while len(alive):
        room, held = limits.astype(np.int64).copy(), []
        while True:
            fits = alive[(kinds[alive] <= room).all(axis=1)]
            if not len(fits):
                break
            best = fits[np.argmax(need[fits] @ (room / limits))]
            held.append(members[best].pop())
            room -= kinds[best]
            left_of_kind[best] -= 1
            if not left_of_kind[best]:
                alive = alive[alive != best]
        bins.append(held)
    return bins


def fill_gaps(bins: list[list[tuple]], length: int, segments: int) -> list[list[tuple]]:
    """Take the emptiest bins apart and fill the others with parts cut from their pieces.

    A bin is a list of pieces ``(document, start, length)``; every token bears loss.
    """
    used = sorted((sum(p[2] for p in b), i) for i, b in enumerate(bins))
    gaps = sum(length - u for u, _ in used)
    spare: list[tuple] = []
    while used and gaps > 0:
        total, i = used[0]
        # A bin is worth taking apart only if the others have room for all of it.
        if gaps - (length - total) < total:
            break
        spare += bins[i]
        gaps -= length - total + total
        used.pop(0)
    kept = [bins[i] for _, i in used]
    for held in kept:
        room = length - sum(p[2] for p in held)
        while room and spare and len(held) < segments:
            doc, start, size = spare.pop()
            take = min(room, size)
            held.append((doc, start, take))
            if take < size:
                spare.append((doc, start + take, size - take))
            room -= take
    while spare:  # where the limit on segments left gaps
        room, held = length, []
        while room and spare and len(held) < segments:
            doc, start, size = spare.pop()
            take = min(room, size)
            held.append((doc, start, take))
            if take < size:
                spare.append((doc, start + take, size - take))
            room -= take
        kept.append(held)
    return kept


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1)
        for i in range(batch.num_rows):
            yield ids[i].as_py(), texts[i].as_py()


def _emit(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def packer(path: str, length: int, segments: int, key: pa.DataType):
    schema = pa.schema(
        [("doc_id", key)]
        + [(n, pa.int64()) for n in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(path)
        number = TaskContext.get().partitionId() << 32
        rows = _blocks(batches)
        while block := list(islice(rows, 1)):
            out: list[tuple] = []
            tails: list[tuple] = []  # doc, ids of the tail, its start, tokens of the document
            while block:
                doc, text = block.pop()
                ids = encoder.encode(text)
                tokens = len(ids) // 4
                full = tokens - tokens % length
                for start in range(0, full, length):
                    part = ids[4 * start : 4 * (start + length)]
                    out.append((doc, start, length, zlib.crc32(part), tokens, number, 0))
                    number += 1
                if tokens > full:
                    tails.append((doc, ids[4 * full :], full, tokens))
                if len(out) >= 4 * BLOCK:
                    yield _emit(out, schema)
                    out = []
                if len(tails) < BLOCK:
                    block = list(islice(rows, 1))
            sizes = np.array([(len(t[1]) // 4, 1, len(t[1]) // 4) for t in tails], np.int64).reshape(-1, 3)
            bins = pack_vectors(sizes, np.array([length, segments, length]))
            pieces = [[(i, 0, int(sizes[i][0])) for i in b] for b in bins]
            for held in fill_gaps(pieces, length, segments):
                offset = 0
                for i, start, size in held:
                    doc, ids, at, tokens = tails[i]
                    crc = zlib.crc32(ids[4 * start : 4 * (start + size)])
                    out.append((doc, at + start, size, crc, tokens, number, offset))
                    offset += size
                number += 1
            yield _emit(out, schema)

    return run


def pack_documents(docs: DataFrame, tokenizer: str, length: int = LENGTH, segments: int = SEGMENTS) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``.

    ``tokenizer`` is the path of a tokenizer file that every machine can read.
    """
    kind = dict(docs.dtypes)["doc_id"]
    key = pa.int64() if kind == "bigint" else pa.int32() if kind == "int" else pa.string()
    return docs.select("doc_id", F.col("text")).mapInArrow(
        packer(tokenizer, length, segments, key), PIECES.format(kind=kind)
    )


def pack_examples(
    examples: DataFrame, length: int, segments: int, loss_tokens: int, block_rows: int = BLOCK
) -> DataFrame:
    """Instruction data: ``example_id, tokens, loss`` to ``example_id, sequence_id, position``. Examples stay whole.

    An example that exceeds a limit by itself gets a sequence of its own. Null counts as 0.
    """
    kind = dict(examples.dtypes)["example_id"]
    limits = np.array([length, segments, loss_tokens])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for at in range(0, batch.num_rows, block_rows):
                part = batch.slice(at, block_rows)
                tokens, loss = (part.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in (1, 2))
                sizes = np.stack([tokens, np.ones_like(tokens), loss], axis=1)
                over = (sizes > limits).any(axis=1)
                small = np.flatnonzero(~over)
                bins = [[int(small[i]) for i in b] for b in pack_vectors(sizes[small], limits)]
                bins += [[int(i)] for i in np.flatnonzero(over)]
                order = [i for b in bins for i in b]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(pa.array(order, pa.int64())),
                        pa.array([number + n for n, b in enumerate(bins) for _ in b], pa.int64()),
                        pa.array([p for b in bins for p in range(len(b))], pa.int64()),
                    ],
                    ["example_id", "sequence_id", "position"],
                )
                number += len(bins)

    given = examples.select(
        "example_id", *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("tokens", "loss")]
    )
    return given.mapInArrow(run, f"example_id {kind}, sequence_id long, position long")
