from __future__ import annotations

import hashlib
import random
import sys

import numpy as np
import pyarrow as pa
import pytest

from pagemill.llm import bcr
from pagemill.llm import suffix_dedup as S
from tests.llm.helpers import awkward, clashing, documents, nothing


def plain(docs, width):
    first, out = {}, {}
    for d, text in sorted(docs):
        b = (text or "").encode()
        gone = [False] * len(b)
        for i in range(len(b) - width + 1):
            if first.setdefault(b[i : i + width], d) < d:
                gone[i : i + width] = [True] * width
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out[d] = (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def of(found):
    return {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in found.collect()}


@pytest.mark.parametrize("seed", range(40))
def test_columns_are_sorted_suffixes_with_their_common_prefixes(seed):
    r = random.Random(seed)
    strings = [bytes(r.choices(b"ab", k=r.randrange(12))) for _ in range(r.randrange(1, 9))]
    starts = np.cumsum([0, *map(len, strings)])
    flat = np.frombuffer(b"".join(strings), np.uint8)
    common, owner, size = bcr.suffix_columns(flat, starts, 50)
    suffixes = [strings[o][len(strings[o]) - n :] for o, n in zip(owner, size, strict=True)]
    assert len(suffixes) == sum(map(len, strings)) + len(strings)
    for a, b, n in zip(suffixes, suffixes[1:], common[1:].tolist(), strict=False):
        assert a <= b
        assert n == next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))


def test_columns_in_files(monkeypatch):
    monkeypatch.setattr(bcr, "IN_MEMORY", 0)
    strings = [b"banana", b"ananas", b"", b"bandana"]
    starts = np.cumsum([0, *map(len, strings)])
    flat = np.frombuffer(b"".join(strings), np.uint8)
    found = bcr.least_owner_values(flat, starts, 3, np.array([5, 2, 1, 0]))
    values = [5, 2, 1, 0]
    expected = [
        [min(v for t, v in zip(strings, values, strict=True) if s[i : i + 3] in t) for i in range(len(s) - 2)] for s in strings
    ]
    assert [f.tolist() for f in found] == expected


@pytest.mark.parametrize("hot", [S.HOT, 1])
def test_removal_matches_plain(spark, hot):
    r = random.Random(9)
    passage = " ".join(f"p{r.randrange(1000)}" for _ in range(40))
    texts = []
    for i in range(60):
        own = " ".join(f"q{r.randrange(10**6)}" for _ in range(r.randrange(30)))
        cut = r.randrange(len(passage) - 60)
        kind = i % 6
        texts.append([own, own + passage[cut:], passage[cut : cut + 50 + r.randrange(-1, 2)] + own, own + passage, "é" * r.randrange(90), texts[-1] if texts else own][kind])
    texts += ["a" * 200, "a" * 49, "a" * 50, "ab" * 100, "ba" * 30]
    order = list(range(len(texts)))
    r.shuffle(order)
    docs = documents(spark, [texts[i] for i in order], order)
    assert of(S.remove_repeats(docs, 50, hot=hot)) == plain(list(enumerate(texts)), 50)


def test_awkward_rows(spark):
    docs = awkward(spark)
    found = S.remove_repeats(clashing(docs), 20, 8).collect()
    assert len(found) == docs.count()
    by_id = {r["doc_id"]: r for r in found}
    assert by_id[5]["n_removed"] == by_id[5]["n_bytes"] > 0 and by_id[5]["n_spans"] == 1 and by_id[4]["n_removed"] == 0
    assert by_id[2]["n_bytes"] == 0 and by_id[2]["kept_sha256"] == hashlib.sha256(b"").hexdigest()
    assert by_id[1]["n_removed"] == 0 and by_id[None]["n_removed"] == 0
    assert S.remove_repeats(nothing(spark)).count() == 0


def test_pieces_cost_no_python_step_each():
    r = random.Random(4)
    passage = " ".join(f"p{r.randrange(10**6)}" for _ in range(600))
    texts = [(f"q{i} " + passage[r.randrange(300) :]).encode() for i in range(200)]
    _, data, ends = S._joined(texts)
    anchors = np.unique(np.concatenate([a for _, _, a, _ in S.stretches(data, ends, 50, 16)]))
    lists = pa.array([anchors.tolist()] * 200)
    docs = pa.RecordBatch.from_arrays([pa.array(range(200)), pa.array(texts), lists, pa.array([[]] * 200, pa.list_(pa.int64()))], ["doc_id", "text", "anchors", "hot"])
    calls = 0

    def count(frame, event, arg):
        nonlocal calls
        calls += event in ("call", "c_call")

    sys.setprofile(count)
    try:
        rows = list(S._piece_rows(50, 16)(iter([docs])))
    finally:
        sys.setprofile(None)
    pieces = sum(b.num_rows for b in rows)
    assert pieces > 10_000 and calls < pieces / 4, (pieces, calls)


def test_blocks_and_slices_may_be_small(monkeypatch):
    r = random.Random(5)
    passage = "".join(r.choices("abcdefgh ", k=400))
    texts = ["", *[passage[r.randrange(200) :] + str(i) for i in range(30)], "", "ab" * 90, "x", passage]
    docs = [(i, t.encode()) for i, t in enumerate(texts)]

    def masks():
        _, data, ends = S._joined([t for _, t in docs])
        found = [np.stack(x, 1) for x in S.stretches(data, ends, 50, 16)]
        anchors = np.unique(np.concatenate([f[:, 2] for f in found]))
        n = len(docs)
        batch = pa.RecordBatch.from_arrays(
            [pa.array([d for d, _ in docs]), pa.array([t for _, t in docs]), pa.array([anchors] * n), pa.array([anchors[:3]] * n)],
            ["doc_id", "text", "anchors", "hot"],
        )
        rows = pa.Table.from_batches(list(S._piece_rows(50, 16)(iter([batch])))).sort_by("anchor").combine_chunks()
        bits = set()
        for part in S._mask_rows(50)(iter(rows.to_batches(7))):
            for d, start, mask in zip(*(part.column(c).to_pylist() for c in (0, 2, 3)), strict=True):
                bits |= {(d, start + i) for i in range(S.STRETCH) if mask >> i & 1}
        return bits

    first, expected = {}, set()
    for d, t in docs:
        for i in range(len(t) - 49):
            if first.setdefault(t[i : i + 50], d) < d:
                expected.add((d, i))
    assert masks() == expected
    for name, size in {"SLICE": 37, "PIECE_BYTES": 500, "BLOCK": 5, "PARTS": 3}.items():
        monkeypatch.setattr(S, name, size)
        assert masks() == expected
