from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from pagemill.llm import kd_shards as D
from pagemill.llm import syncmers as Y
from pagemill.llm import systematic_mix as M
from tests.llm.helpers import awkward, clashing, documents, nothing


def filled(sizes, weights, most):
    """Targets by sharing and resharing, step by step."""
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, target, free = sum(sizes.values()), {}, set(names)
    while free:
        left = total - sum(target.values())
        unit = left / sum(weight[s] for s in free)
        over = {s for s in free if unit * weight[s] > most * sizes[s]}
        if not over:
            target |= {s: unit * weight[s] for s in free}
            break
        target |= {s: float(most * sizes[s]) for s in over}
        free -= over
    return target


@pytest.mark.parametrize("sizes", [
    {"a": 100}, {"a": 1, "b": 1, "c": 1000}, {"a": 5, "b": 0, "c": 5, "d": 100, None: 7},
    {f"s{i:02}": i * i for i in range(20)}, {"a": 0},
])
def test_targets(spark, sizes):
    given = spark.createDataFrame([(k, v) for k, v in sizes.items()], "source string, source_size long")
    found = {r["source"]: r["target"] for r in M.source_targets(given).collect()}
    for name, value in filled(sizes, (1, 2, 3), 3).items():
        assert found[name] == pytest.approx(value)


def test_mix_is_near_target_bounded_and_repeatable(spark):
    texts = ["w " * (1 + i % 37) for i in range(900)]
    sources = ["hot" if i % 3 else f"s{i % 4}" for i in range(900)]
    docs = documents(spark, texts, sources=sources)
    first, again = (sorted(map(tuple, M.mix(docs.repartition(n)).collect())) for n in (1, 5))
    assert first == again
    taken, target = Counter(), {}
    for r in M.mix(docs).collect():
        assert r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    assert all(abs(taken[s] - target[s]) <= 40 for s in target)
    copies = {r["doc_id"]: r["copies"] for r in M.mix(docs).collect()}
    emitted = Counter(r["doc_id"] for r in M.emit(docs).collect())
    assert emitted == Counter({d: n for d, n in copies.items() if n})


def test_mix_awkward(spark):
    docs = clashing(awkward(spark))
    assert M.mix(docs).count() == 9
    assert M.mix(nothing(spark)).count() == 0 and M.emit(nothing(spark)).count() == 0
    assert M.emit(docs).columns == docs.columns
    assert all(r["taken"] == 0 for r in M.mix(docs).collect() if r["doc_id"] in (2, 3, 6))


@pytest.mark.parametrize("shards", [1, 3, 7, 40])
def test_shards_are_even_and_slots_gapless(spark, shards):
    texts = ["x" * (20 + 7 * i % 90) for i in range(800)] + ["same text"] * 400
    rows = D.shard_documents(documents(spark, texts), shards=shards).collect()
    assert sorted(r["doc_id"] for r in rows) == list(range(len(texts)))
    size, slots = Counter(), {}
    for r in rows:
        assert r["size"] == len(texts[r["doc_id"]]) + 16 and r["text_crc32"] == zlib.crc32(texts[r["doc_id"]].encode())
        size[r["shard"]] += r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert set(size) == set(range(shards))
    assert max(size.values()) - min(size.values()) <= 8 * 126
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_shards_awkward(spark):
    docs = clashing(awkward(spark))
    assert D.shard_documents(docs, shards=4).count() == 9
    assert D.shard_documents(docs, target_bytes=50_000).agg(F.countDistinct("shard")).first()[0] > 1
    assert D.shard_documents(nothing(spark), shards=40).count() == 0


def plain_anchors(text, k, spark):
    """Closed syncmers of one-word substrings, from hashes taken one by one."""
    words = [w for w in text.lower().replace("\t", " ").replace("\n", " ").split(" ") if w]
    if not words:
        return []
    h = [spark.sql(f"SELECT xxhash64('{w}')").first()[0] for w in words]
    if len(h) < k:
        return [0]
    return [i for i in range(len(h) - k + 1) if min(h[i : i + k]) in (h[i], h[i + k - 1])]


def test_anchors_and_context(spark):
    text = "The quick brown fox jumps over the lazy dog and runs off"
    df = documents(spark, [text, "zero one " + text, "two words", ""])
    found = [[a["position"] for a in r["anchors"]] for r in Y.fingerprints(df).orderBy("doc_id").collect()]
    assert found[0] == plain_anchors(text, 3, spark) and found[2] == [0] and found[3] == []
    # Anchors don't depend on what stands before them.
    assert {p + 2 for p in found[0]} <= set(found[1])


def test_edited_texts(spark):
    texts = [f"{i} " + " ".join(f"w{(i * 31 + j * j) % 501}" for j in range(80)) for i in range(40)] + ["", None, "é"]
    rows = {r["doc_id"]: r for r in Y.compare_edited(documents(spark, texts)).collect()}
    import hashlib

    for i, text in enumerate(texts):
        text, after = text or "", texts[(i + 1) % len(texts)] or ""
        cut = len(text) // 4
        edited = text[: len(text) - cut] + after[:cut]
        assert rows[i]["n_chars"] == len(text)
        assert rows[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= rows[i]["near_edited"] <= 1
    assert all(rows[i]["near_edited"] > rows[i]["near_next"] for i in range(40))
    assert all((rows[i]["fingerprint"] == rows[i]["edited_fingerprint"]) <= (rows[i]["near_edited"] == 1) for i in rows)


def plain_fingerprint(text, k=3):
    """Entries ``(distance, hash)`` of every closed syncmer of one-word substrings, from hashes taken one by one."""

    def chained(values, seed=42):
        for v in values:
            seed = xxhash.xxh64_intdigest((v & (1 << 64) - 1).to_bytes(8, "little"), seed)
        return seed

    words = [w for w in re.split("[ \t-\r]+", text.lower()) if w]
    h = [xxhash.xxh64_intdigest(w.encode(), 42) for w in words]
    signed = [x - (1 << 64) if x >> 63 else x for x in h]
    if len(h) < k:
        return None if h else []
    found, last = [], 0
    for i in range(len(h) - k + 1):
        if min(signed[i : i + k]) in (signed[i], signed[i + k - 1]):
            found.append((i - last, chained(h[i : i + k]) & 0xFFFFFFFF))
            last = i
    return found


def plain_likeness(left, right):
    a, b = ({(None if i == 0 else f[i - 1][1], *f[i]) for i in range(len(f))} for f in (left, right))
    return len(a & b) / len(a | b) if a | b else 1.0


def test_every_column_against_a_plain_version(spark):
    """Fingerprints, edits and both likenesses, over chunks of every size."""
    r = random.Random(3)
    texts = [" ".join(f"w{r.randrange(40)}" for _ in range(r.choice([3, 4, 17, 200]))) for _ in range(60)] + ["", None]
    texts[7] = texts[6]
    ids = r.sample(range(-500, 5000), len(texts))
    rows = {x["doc_id"]: x for x in Y.compare_edited(documents(spark, texts, ids)).collect()}
    text = dict(zip(ids, (t or "" for t in texts), strict=True))
    order = sorted(ids)
    for i, after in zip(order, [*order[1:], order[0]], strict=True):
        moved = len(text[i]) // 4
        edited = text[i][: len(text[i]) - moved] + text[after][:moved]
        own, other, following = (plain_fingerprint(t) for t in (text[i], edited, text[after]))
        assert rows[i]["fingerprint"] == "".join(f"{d:x}{h:08x}" for d, h in own)
        if other is not None:
            assert rows[i]["edited_fingerprint"] == "".join(f"{d:x}{h:08x}" for d, h in other)
            assert rows[i]["near_edited"] == pytest.approx(plain_likeness(own, other))
        assert rows[i]["near_next"] == pytest.approx(plain_likeness(own, following))


def test_likeness_matches_positions(spark):
    """A short passage of long texts counts where it stands as one; the same words apart from each other don't."""
    passage = [f"p{i}" for i in range(50)]
    texts = [" ".join([*[f"{n}x{i}" for i in range(2000)], *passage, *[f"{n}y{i}" for i in range(2000)]]) for n in "ab"]
    rows = Y.compare_edited(documents(spark, texts)).collect()
    common = plain_likeness(*map(plain_fingerprint, texts))
    assert common > 0 and all(r["near_next"] == pytest.approx(common) for r in rows)
    # Every anchor of three words is common, yet they never follow one another alike.
    triples = [" ".join(passage[i : i + 3]) for i in range(0, 48, 3)]
    apart = [" ".join(f"{t} {n}{i} {n}{i}z {n}{i}y" for i, t in enumerate(triples)) for n in "ab"]
    assert all(r["near_next"] < 0.02 for r in Y.compare_edited(documents(spark, apart)).collect())


@pytest.mark.parametrize("chunk_bytes", [1, 200, 1 << 30])
def test_chunks_change_nothing(spark, monkeypatch, chunk_bytes):
    df = documents(spark, [f"a{i} b{i} c{i % 5} d{i % 3} e f" for i in range(50)], ids=[i * i - 40 for i in range(50)])
    whole = sorted(map(tuple, Y.compare_edited(df).collect()))
    monkeypatch.setattr(Y, "CHUNK_BYTES", chunk_bytes)
    assert sorted(map(tuple, Y.compare_edited(df).collect())) == whole and len(whole) == 50


def test_edited_awkward(spark):
    rows = Y.compare_edited(clashing(awkward(spark))).collect()
    assert len(rows) == 9
    prints = {r["doc_id"]: r["fingerprint"] for r in rows}
    assert prints[4] == prints[5] and prints[1] == prints[None] and prints[2] == prints[3] == ""
    assert Y.compare_edited(nothing(spark)).count() == 0
    alone = Y.compare_edited(documents(spark, ["a b c d e f g h"])).first()
    assert alone["near_next"] == 1.0
