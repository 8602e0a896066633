"""Exact removal of long substrings that an earlier document holds, by suffix columns of the whole collection.

A byte goes if it lies in a substring of ``width`` bytes that also starts in a
document with a smaller id. Texts are UTF-8 bytes; matches don't cross documents.

1. Anchors. Every window of ``width`` bytes is represented by the least hash of its
   substrings of ``K`` bytes, so equal windows have equal anchors, and neighbours
   mostly share one: about one anchor per 20 bytes.
2. Anchors that two documents share. Rows meet by anchor and stream past in sorted
   order, one row held. What is known to be shared inside a batch passes on by
   itself; only one row per batch goes to its anchor's place, so an anchor that a
   third of all documents hold doesn't fill a task with them.
3. Pieces. Stretches of windows with one shared anchor, at most ``STRETCH`` of them,
   meet by anchor again. A piece that the same batch holds in an earlier document
   is settled there and not sent. Anchors with more than ``HOT`` documents are cut
   into single windows, which spread by their own content.
4. Columns. The distinct pieces of a block of anchors form a collection, whose
   transform and common prefixes are built column by column (``bcr``). Suffixes that
   share ``width`` bytes stand together; the least id of their documents decides.
5. Removal. Each document's windows come back as bit masks and are cut from its text.

A document equal to an earlier one goes whole, if it has ``width`` bytes, and takes
no part in 3 and 4. Null texts count as empty. Rows without id are neither a source nor
changed. Rows of one id are told apart by a checksum of their texts; none is
earlier than the other. An empty table gives an empty result. Further columns are
ignored. Ids are whole numbers.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.bcr import least_owner_values
from pagemill.plans.scratch import durable, written

WIDTH = 50
K = 16
STRETCH = 31
SLICE = 1 << 20
BLOCK = 4096
#: Bytes of pieces that are settled together, and pieces whose bytes are put together at once.
PIECE_BYTES = 32 << 20
PARTS = 20_000
HOT = 500_000
#: Hot anchors, 16 bytes each, that may be broadcast.
MOST_BROADCAST = 500_000
_STEP = 0x9E3779B97F4A7C15
_BITS = 1 << np.arange(STRETCH, dtype=np.int64)


def _finish(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(n: int) -> np.uint64:
    return np.uint64(pow(_STEP, n, 1 << 64))


def _substring_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all substrings of ``k`` bytes, put together from those of powers of two."""
    part, size = data.astype(np.uint64) + np.uint64(1), 1
    whole, done = None, 0
    while True:
        if k & size:
            if whole is None:
                whole, done = part, size
            else:
                n = len(data) - (done + size) + 1
                whole, done = whole[:n] * _power(size) + part[done : done + n], done + size
        if 2 * size > k:
            return _finish(whole)
        part = part[:-size] * _power(size) + part[size:]
        size *= 2


def _least_of(values: np.ndarray, n: int) -> np.ndarray:
    """The least of every ``n`` values in a row."""
    least, size = values, 1
    while 2 * size <= n:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if size < n:
        count = len(values) - n + 1
        least = np.minimum(least[:count], least[n - size : n - size + count])
    return least


def stretches(data: np.ndarray, ends: np.ndarray, width: int, k: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Runs of windows with one anchor, slice by slice: start, number of windows, anchor, document.

    ``data`` holds documents one after another; ``ends`` says where each ends. Runs may be cut anywhere.
    """
    last = len(data) - width + 1
    for lo in range(0, max(last, 0), SLICE):
        hi = min(lo + SLICE, last)
        anchor = _least_of(_substring_hashes(data[lo : hi + width - 1], k), width - k + 1)
        first, past = np.searchsorted(ends, [lo, hi - 1], side="right") + (0, 1)
        sizes = np.diff(np.append(lo, np.minimum(ends[first:past], hi)))
        document = np.repeat(np.arange(first, past), sizes)
        inside = np.arange(lo + width, hi + width) <= np.repeat(ends[first:past], sizes)
        change = (anchor[1:] != anchor[:-1]) | (document[1:] != document[:-1]) | (inside[1:] != inside[:-1])
        start = np.concatenate([[0], np.flatnonzero(change) + 1])
        count = np.diff(np.append(start, hi - lo))
        good = inside[start]
        start, count = start[good], count[good]
        yield start + lo, count, anchor[start].astype(np.int64), document[start]


def _joined(texts: list[bytes | None]) -> tuple[bytes, np.ndarray, np.ndarray]:
    ends = np.cumsum([len(t or b"") for t in texts], dtype=np.int64)
    flat = b"".join(t for t in texts if t)
    return flat, np.frombuffer(flat, np.uint8), ends


def _anchor_rows(width: int, k: int):
    """``anchor, doc_id, docs, alone``: each document's anchors; ``docs`` counts the batch's documents that have it.

    A row is ``alone`` if its anchor is known to be shared and another row of the batch stands for it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, data, ends = _joined(batch.column(1).to_pylist())
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            parts = [(a, d) for _, _, a, d in stretches(data, ends, width, k)]
            if not parts:
                continue
            anchor, document = (np.concatenate(p) for p in zip(*parts, strict=True))
            order = np.lexsort((document, anchor))
            anchor, document = anchor[order], document[order]
            new = np.append(True, (anchor[1:] != anchor[:-1]) | (document[1:] != document[:-1]))
            anchor, document = anchor[new], document[new]
            first = np.append(True, anchor[1:] != anchor[:-1])
            counts = np.diff(np.append(np.flatnonzero(first), len(anchor)))
            docs = np.repeat(counts, counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array(anchor), pa.array(ids[document]), pa.array(docs, pa.int64()), pa.array(~first)],
                ["anchor", "doc_id", "docs", "alone"],
            )

    return run


def _shared_rows(hot: int):
    """Rows sorted by anchor to ``doc_id, anchor`` of shared ones, and a row without id for each hot anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_anchor, held, known, total, told = None, None, False, 0, False
        for batch in batches:
            if not batch.num_rows:
                continue
            anchor, ids, docs = (batch.column(c).to_numpy(zero_copy_only=False) for c in range(3))
            alone = batch.column(3).to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1]))
            sizes = np.diff(np.append(starts, len(anchor)))
            # An anchor is shared if a row counts several documents, or rows of different documents meet.
            shared = (np.maximum.reduceat(docs, starts) > 1) | (
                np.minimum.reduceat(ids, starts) != np.maximum.reduceat(ids, starts)
            )
            counted = np.add.reduceat(np.where(alone, 0, docs), starts)
            out_ids, out_anchors, hots = [], [], []
            if open_anchor is not None and open_anchor == anchor[0]:
                shared[0] |= known or held != ids[0]
                if shared[0] and not known and held is not None:
                    out_ids.append([held])
                    out_anchors.append([open_anchor])
                counted[0] += total
                told_first = told
            else:
                told_first = False
            passed = np.repeat(shared, sizes)
            out_ids.append(ids[passed])
            out_anchors.append(anchor[passed])
            over = counted > hot
            if told_first:
                over[0] = False
            hots = anchor[starts][over]
            told = bool(over[-1]) or (told_first and len(starts) == 1)
            open_anchor, known, total = anchor[-1], bool(shared[-1]), int(counted[-1])
            held = None if known else ids[-1]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([*np.concatenate(out_ids).tolist(), *[None] * len(hots)], pa.int64()),
                    pa.array(np.concatenate([*out_anchors, hots]).astype(np.int64)),
                ],
                ["doc_id", "anchor"],
            )

    return run


_MASKS = ["doc_id", "tag", "start", "mask"]
_PIECES = "anchor long, doc_id long, tag long, start long, windows int, piece binary, mask long"


def _among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which values are in the sorted ``known``."""
    if not len(known):
        return np.zeros(len(values), bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def _parts(data: np.ndarray, at: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """The substrings of ``data`` that begin at ``at``."""
    bounds = np.append(0, np.cumsum(sizes))
    out = np.empty(bounds[-1], np.uint8)
    for lo in range(0, len(at), PARTS):
        hi = min(lo + PARTS, len(at))
        out[bounds[lo] : bounds[hi]] = data[np.repeat(at[lo:hi] - bounds[lo:hi], sizes[lo:hi]) + np.arange(bounds[lo], bounds[hi])]
    return pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(out)])


def _least_by(codes: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """The least value of each code below ``n``."""
    least = np.full(n, np.iinfo(np.int64).max)
    np.minimum.at(least, codes, values)
    return least


def _piece_rows(width: int, k: int):
    """``doc_id, text, anchors, hot`` to pieces, or masks where the batch settles them.

    Shared anchors are shared by all documents that have them, so a batch has one list of them. Equal pieces have
    equal anchors. Pieces are made and settled by about ``PIECE_BYTES`` at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["anchor", "doc_id", "tag", "start", "windows", "piece", "mask"]
        for batch in batches:
            texts = batch.column(1).to_pylist()
            _, data, ends = _joined(texts)
            begins = np.append(0, ends[:-1])
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            tags = np.fromiter((zlib.crc32(t or b"") for t in texts), np.int64, len(texts))
            wanted, hot = (np.unique(batch.column(c).flatten().to_numpy(zero_copy_only=False)) for c in (2, 3))

            def settled(held: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
                anchor, document, at, windows, single = (np.concatenate(x) for x in zip(*held, strict=True))
                pieces = _parts(data, at, windows + (width - 1))
                kinds = pieces.dictionary_encode()
                codes, own = kinds.indices.to_numpy(), ids[document]
                early = own > _least_by(codes, own, len(kinds.dictionary))[codes]  # an earlier document holds the piece
                if single.any():
                    which, code = np.unique(codes[single], return_inverse=True)
                    hashes = [xxhash.xxh64_intdigest(p) - (1 << 63) for p in kinds.dictionary.take(pa.array(which)).to_pylist()]
                    anchor[single] = np.array(hashes, np.int64)[code]
                rows = pa.RecordBatch.from_arrays(
                    [
                        pa.array(anchor, mask=early), pa.array(own), pa.array(tags[document]), pa.array(at - begins[document]),
                        pa.array(windows.astype(np.int32)), pc.if_else(pa.array(early), pa.scalar(None, pa.binary()), pieces),
                        pa.array((1 << windows) - 1, mask=~early),
                    ],
                    names,
                )
                for lo in range(0, rows.num_rows, 10_000):
                    yield rows.slice(lo, 10_000)

            held, size = [], 0
            for start, count, anchor, document in stretches(data, ends, width, k):
                keep = _among(anchor, wanted)
                start, count, anchor, document = (x[keep] for x in (start, count, anchor, document))
                step = np.where(_among(anchor, hot), 1, STRETCH)
                parts = -(-count // step)
                of = np.repeat(np.arange(len(start)), parts)
                at = start[of] + (np.arange(len(of)) - np.repeat(np.cumsum(parts) - parts, parts)) * step[of]
                windows = np.minimum(step[of], start[of] + count[of] - at)
                held.append((anchor[of], document[of], at, windows, step[of] == 1))
                size += int(windows.sum()) + (width - 1) * len(of)
                if size >= PIECE_BYTES:
                    yield from settled(held)
                    held, size = [], 0
            if size:
                yield from settled(held)

    return run


def _least_documents(pieces: list[bytes], own: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Pieces that share a window, and a row for each: per start of a window, the least document whose pieces hold that window.

    Windows whose hash no other window has need no comparison. What is left of each
    piece, from its first other window to its last, forms the collection.
    """
    ends = np.cumsum([len(p) for p in pieces])
    starts = ends - [len(p) for p in pieces]
    flat = np.frombuffer(b"".join(pieces), np.uint8)
    hashes = _substring_hashes(flat, width)
    of = np.repeat(np.arange(len(pieces)), ends - starts)[: len(hashes)]
    at = np.flatnonzero(np.arange(len(hashes)) + width <= ends[of])
    _, kind, count = np.unique(hashes[at], return_inverse=True, return_counts=True)
    at = at[count[kind] > 1]
    if not len(at):
        return at, np.empty((0, STRETCH), np.int64)
    held, first = np.unique(of[at], return_index=True)
    lo = at[first]
    hi = at[np.append(first[1:], len(at)) - 1] + width
    cuts = np.append(0, np.cumsum(hi - lo))
    collection = np.concatenate([flat[a:b] for a, b in zip(lo, hi, strict=True)])
    found = np.repeat(own[held], STRETCH).reshape(-1, STRETCH)
    for i, (a, values) in enumerate(zip(lo - starts[held], least_owner_values(collection, cuts, width, own[held]), strict=True)):
        found[i, a : a + len(values)] = values
    return held, found


def _settle(rows: pa.Table, width: int) -> pa.RecordBatch:
    """Masks of a block of whole anchors: rows ``anchor, doc_id, tag, start, windows, piece``."""
    anchor, doc, tag, start, windows = (rows.column(c).to_numpy() for c in range(5))
    kinds = rows.column(5).dictionary_encode().combine_chunks()
    codes = kinds.indices.to_numpy()
    least = _least_by(codes, doc, len(kinds.dictionary))
    whole = (np.int64(1) << windows.astype(np.int64)) - 1
    mask = np.where(least[codes] < doc, whole, 0)
    # An anchor with a single piece has nothing to compare; the others form the collection.
    anchors = np.empty(len(least), np.int64)
    anchors[codes] = anchor
    _, group, count = np.unique(anchors, return_inverse=True, return_counts=True)
    several = np.flatnonzero(count[group] > 1)
    if len(several):
        held, found = _least_documents(kinds.dictionary.take(pa.array(several)).to_pylist(), least[several], width)
        line = np.full(len(least), -1)
        line[several[held]] = np.arange(len(held))
        compared = np.flatnonzero(line[codes] >= 0)
        for lo in range(0, len(compared), PARTS):
            which = compared[lo : lo + PARTS]
            mask[which] = ((found[line[codes[which]]] < doc[which, None]) @ _BITS) & whole[which]
    some = mask != 0
    return pa.RecordBatch.from_arrays([pa.array(x[some]) for x in (doc, tag, start, mask)], _MASKS)


def _mask_rows(width: int):
    """Pieces sorted by anchor to ``doc_id, tag, start, mask``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, last = [], 0, None
        for batch in batches:
            yield pa.RecordBatch.from_arrays(batch.filter(batch.column(5).is_null()).select([1, 2, 3, 6]).columns, _MASKS)
            rows = batch.filter(batch.column(5).is_valid()).select(list(range(6)))
            if not rows.num_rows:
                continue
            held.append(rows)
            size += rows.num_rows
            before, last = last, rows.column(0)[-1].as_py()
            if size < BLOCK or before == last:
                continue  # no anchor ends behind a full block
            table, begin = pa.Table.from_batches(held), 0
            anchor = table.column(0).to_numpy()
            changes = np.flatnonzero(anchor[1:] != anchor[:-1]) + 1
            while (i := np.searchsorted(changes, begin + BLOCK)) < len(changes):
                yield _settle(table.slice(begin, changes[i] - begin), width)
                begin = changes[i]
            held, size = table.slice(begin).to_batches(), table.num_rows - begin
        if size:
            yield _settle(pa.Table.from_batches(held), width)

    return run


def _cut_rows(width: int):
    """``doc_id, text, copy, cuts`` to the result: what is removed and what is left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            bounds, held = batch.column(3).offsets.to_numpy(), batch.column(3).values
            tags, starts, masks = (held.field(c).to_numpy(zero_copy_only=False) for c in ("tag", "start", "mask"))
            for i, (text, copy) in enumerate(zip(batch.column(1), batch.column(2), strict=True)):
                data = text.as_py() or b""
                if copy.as_py() and len(data) >= width:
                    gone = np.ones(len(data), bool)
                else:
                    own = slice(bounds[i], bounds[i + 1])
                    ours = tags[own] == zlib.crc32(data)
                    at = starts[own][ours][:, None] + np.arange(STRETCH)
                    begins = np.zeros(len(data), np.int8)
                    begins[at[(masks[own][ours][:, None] & _BITS) != 0]] = 1
                    edge = begins.copy()
                    edge[width:] -= begins[: max(len(data) - width, 0)]
                    gone = np.cumsum(edge, dtype=np.int64) > 0
                left = np.frombuffer(data, np.uint8)[~gone].tobytes()
                spans = int((gone & ~np.append(False, gone[:-1])[: len(gone)]).sum())
                rows.append((len(data), int(gone.sum()), spans, hashlib.sha256(left).hexdigest(), left))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 5
            kinds = [pa.int64()] * 3 + [pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
            )

    return run


def remove_repeats(docs: DataFrame, width: int = WIDTH, k: int = K, hot: int = HOT) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept``; ``kept`` holds the remaining bytes of each document."""
    if not 1 <= k <= width:
        raise ValueError("anchors are substrings of the windows")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    named = rows.filter(F.col("doc_id").isNotNull())

    digests = named.select("doc_id", F.sha2("text", 256).alias("digest"))
    firsts = digests.groupBy("digest").agg(F.min("doc_id").alias("first"))
    # Equal texts may share a digest with a third of all rows; the join on it can be split.
    copies = durable(
        digests.join(firsts, "digest").filter(F.col("doc_id") > F.col("first"))
        .select("doc_id", F.col("digest").alias("copied")).distinct()
    )

    anchors = named.mapInArrow(_anchor_rows(width, k), "anchor long, doc_id long, docs long, alone boolean")
    place = F.when(F.col("alone"), F.xxhash64("anchor", "doc_id")).otherwise(F.col("anchor"))
    # What meets here is wide on disk and read once: it goes before the next step begins, and so do the pieces.
    shared = written(
        anchors.repartition(place).sortWithinPartitions("anchor").mapInArrow(_shared_rows(hot), "doc_id long, anchor long"),
        "shared-anchors",
    )
    hot_anchors = durable(shared.filter(F.col("doc_id").isNull()).select("anchor", F.lit(True).alias("hot")).distinct())
    if hot_anchors.count() <= MOST_BROADCAST:
        hot_anchors = F.broadcast(hot_anchors)  # beyond that, a shuffled join
    marked = shared.filter(F.col("doc_id").isNotNull()).join(hot_anchors, "anchor", "left")
    wanted = marked.groupBy("doc_id").agg(
        F.collect_list("anchor").alias("anchors"), F.collect_list(F.when(F.col("hot"), F.col("anchor"))).alias("hot")
    )

    text = named.repartition("doc_id")
    own = text.join(copies.withColumnRenamed("doc_id", "of"), F.col("doc_id") == F.col("of"), "left").select(
        "doc_id", "text", F.coalesce(F.sha2("text", 256) == F.col("copied"), F.lit(False)).alias("copy")
    )
    pieces = own.filter(~F.col("copy")).join(wanted, "doc_id").select("doc_id", "text", "anchors", "hot").mapInArrow(
        _piece_rows(width, k), _PIECES
    )
    meet = F.coalesce("anchor", F.xxhash64("doc_id", "tag", "start"))
    masks = written(
        pieces.repartition(meet).sortWithinPartitions("anchor").mapInArrow(
            _mask_rows(width), "doc_id long, tag long, start long, mask long"
        ),
        "masks",
    )
    cuts = masks.groupBy("doc_id").agg(F.collect_list(F.struct("tag", "start", "mask")).alias("cuts"))
    ready = own.join(cuts, "doc_id", "left").select("doc_id", "text", "copy", "cuts")
    unnamed = rows.filter(F.col("doc_id").isNull()).select(
        "doc_id", "text", F.lit(False).alias("copy"), F.lit(None).cast("array<struct<tag:bigint,start:bigint,mask:bigint>>").alias("cuts")
    )
    return ready.unionByName(unnamed).mapInArrow(
        _cut_rows(width), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    )
