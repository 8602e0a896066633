from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from pagemill.llm import merkle as M
from pagemill.llm import token_files as K
from pagemill.llm.catalog import tokenizer_path
from pagemill.plans.scratch import scratch_path
from tests.llm.helpers import awkward, clashing, documents, nothing


def plain_ids(text):
    from tokenizers import Tokenizer

    if not hasattr(plain_ids, "tokenizer"):
        plain_ids.tokenizer = Tokenizer.from_file(tokenizer_path())
    return plain_ids.tokenizer.encode(text or "", add_special_tokens=False).ids + [0]


def test_pieces_give_the_tokenizers_ids():
    r = random.Random(3)
    encode = K.TokenIds(tokenizer_path()).encode
    known = [chr(c) for c in [*range(0x250), *range(0x2010, 0x2028), *range(0x2030, 0x205F)]]
    parts = [*known, *["a", "word", " ", "  ", "\n", "'s", "'ll", "é", "12", ".", "<|endoftext|>", "日本", "²", "\x1c", "\x85", "\xa0"] * 40]
    texts = ["".join(r.choices(parts, k=r.randrange(40))) for _ in range(3000)] + [f"a{c} {c}{c}b 1{c}" for c in known]
    for text in texts:
        assert encode(text) == np.array(plain_ids(text)[:-1], "<u4").tobytes(), repr(text)


def test_a_full_memory_of_pieces_is_emptied(monkeypatch):
    monkeypatch.setattr(K, "KNOWN_PIECES", 5)
    encode = K.TokenIds(tokenizer_path()).encode
    text = " ".join(f"word{i} " + "x" * i for i in range(60))
    assert encode(text) == np.array(plain_ids(text)[:-1], "<u4").tobytes()


def written(spark, docs, **options):
    path = scratch_path(spark, "tokens")
    K.write_tokens(docs, path, tokenizer_path(), **options)
    return path


@pytest.mark.parametrize("encoding", ["dictionary", "delta"])
def test_files_hold_every_id_in_order(spark, encoding):
    r = random.Random(5)
    texts = [" ".join(r.choices(["alpha", "Übung", "12", "日本"], k=r.choice([0, 1, 20, 900]))) for _ in range(300)] + [None, ""]
    ids = r.sample(range(10_000), len(texts))
    path = written(spark, documents(spark, texts, ids=ids).repartition(5), encoding=encoding, shard_bytes=20_000, keep=("lang", "n_chars"))
    at, want = 0, []
    for doc, text in sorted(zip(ids, texts, strict=True)):
        own = np.array(plain_ids(text), "<u4")
        want.append((doc, at, len(own), zlib.crc32(own.tobytes())))
        at += len(own)
    found = sorted(tuple(r) for r in K.token_digests(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32").collect())
    assert found == want
    told = sorted((r["doc_id"], r["start"], r["n_tokens"]) for r in K.read_metadata(spark, path).collect())
    assert told == [w[:3] for w in want]
    lengths = {r["doc_id"]: (r["kept"]["lang"], r["kept"]["n_chars"]) for r in K.read_metadata(spark, path).collect()}
    assert lengths == {i: ("en", None if t is None else len(t)) for i, t in zip(ids, texts, strict=True)}
    some = K.read_tokens(spark, path, 2000, 3000).collect()
    by_id = dict(zip(ids, texts, strict=True))
    assert {r["doc_id"]: r["tokens"] for r in some} == {i: plain_ids(t) for i, t in by_id.items() if 2000 <= i <= 3000}


def column_of(path, name):
    from pathlib import Path

    out = []
    for file in sorted(Path(path, "rows").glob("*.parquet")):
        meta = pq.ParquetFile(file).metadata
        for g in range(meta.num_row_groups):
            out += [c for i in range(meta.num_columns) if (c := meta.row_group(g).column(i)).path_in_schema.startswith(name)]
    return out


def test_encodings_row_groups_and_page_indexes_are_as_asked(spark):
    r = random.Random(8)
    texts = [" ".join(r.choices([f"w{i}" for i in range(4000)], k=1500)) for _ in range(300)]
    docs = documents(spark, texts).coalesce(1)
    dictionary = column_of(written(spark, docs), "tokens")
    delta = column_of(written(spark, docs, encoding="delta"), "tokens")
    assert all("RLE_DICTIONARY" in c.encodings for c in dictionary)
    assert all("DELTA_BINARY_PACKED" in c.encodings and "RLE_DICTIONARY" not in c.encodings for c in delta)
    assert all(c.has_offset_index and c.has_column_index for c in column_of(written(spark, docs), "doc_id"))
    small = written(spark, docs, shard_bytes=1 << 30, group_bytes=60_000, page_bytes=10_000)
    assert len(column_of(small, "doc_id")) > len(column_of(written(spark, docs), "doc_id"))


def test_reads_touch_only_what_they_need(spark):
    path = written(spark, documents(spark, ["a b c"] * 50))
    told = K.read_metadata(spark, path).select("doc_id", "n_tokens")._jdf.queryExecution().toString()
    assert "tokens:array" not in told.split("ReadSchema")[1]
    part = K.read_tokens(spark, path, 10, 12)._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(doc_id,10)" in part and "LessThanOrEqual(doc_id,12)" in part
    with pytest.raises(ValueError):
        K.write_tokens(documents(spark, ["a"]), path, tokenizer_path(), encoding="none")


def test_awkward_token_rows(spark):
    docs = clashing(awkward(spark))
    path = written(spark, docs, keep=("score", "text"))
    found = K.token_digests(spark, path).orderBy("start").collect()
    assert [r["doc_id"] for r in found] == [None, 1, 1, 2, 3, 4, 5, 6, 7]
    given = sorted(((r["doc_id"] or 0, r["text"]) for r in awkward(spark).collect()), key=lambda x: x[0])
    at = 0
    for r, (_, text) in zip(found, given, strict=True):
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(plain_ids(text)), zlib.crc32(np.array(plain_ids(text), "<u4").tobytes()))
        at += r["n_tokens"]
    empty = written(spark, nothing(spark))
    assert K.token_digests(spark, empty).count() == K.read_metadata(spark, empty).count() == 0


# --- manifest -----------------------------------------------------------------------------------


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(values):
    return digest(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def plain_tree(leaves, fanout):
    """The root, and per leaf its siblings level by level."""
    proofs, level, places = ["" for _ in leaves], list(leaves), list(range(len(leaves)))
    while len(level) > 1:
        for i, p in enumerate(places):
            run = range(p - p % fanout, min(p - p % fanout + fanout, len(level)))
            proofs[i] += "".join(level[q] for q in run if q != p)
        level = [digest(*level[i : i + fanout]) for i in range(0, len(level), fanout)]
        places = [p // fanout for p in places]
    return level[0], proofs


COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


@pytest.mark.parametrize("fanout,levels", [(3, 6), (3, 1), (2, 2), (5, 2)])
def test_manifest_equals_the_plain_trees(spark, fanout, levels):
    sizes = {None: 2, "a": 1, "b": 3, "c": 4, "é": 10, "z": 29, "Z": 83}
    rows = [(s, f"text {s} {i} é\n") for s, n in sizes.items() for i in range(n)]
    random.Random(1).shuffle(rows)
    docs = documents(spark, [t for _, t in rows], ids=[7 * i % 997 for i in range(len(rows))], sources=[s for s, _ in rows])
    given = [tuple(r[c] for c in COLUMNS) for r in docs.collect()]
    want, roots = {}, []
    for name in sorted(sizes, key=lambda s: (s is not None, (s or "").encode())):
        own = sorted((v for v in given if v[1] == name), key=lambda v: v[0])
        root, proofs = plain_tree([leaf(v) for v in own], fanout)
        roots.append(root)
        want |= {v[0]: (leaf(v), root, p, len(roots) - 1) for v, p in zip(own, proofs, strict=True)}
    top, above = plain_tree(roots, fanout)
    found = M.manifest(docs.repartition(6), COLUMNS, fanout=fanout, levels=levels, other=M.leaf_of(F.lit("x")))
    told = found.select(
        "*", M.folded(F.col("leaf"), fanout).alias("again"), M.folded(F.col("other"), fanout).alias("changed"),
        M.whole_proof().cast("string").alias("whole"),
    ).collect()
    assert len(told) == len(given)
    for r in told:
        own, subroot, proof, place = want[r["doc_id"]]
        assert (r["leaf"], r["subroot"], r["root"], r["whole"]) == (own, subroot, top, proof + above[place])
        assert r["again"] == top != r["changed"]


def test_awkward_rows_in_a_manifest(spark):
    docs = clashing(awkward(spark))
    found = M.manifest(docs, COLUMNS).withColumn("again", M.folded(F.col("leaf"))).collect()
    assert len(found) == 9 and {r["again"] for r in found} == {found[0]["root"]}
    assert sorted(r["leaf"] for r in found) == sorted(leaf([r[c] for c in COLUMNS]) for r in docs.collect())
    again = M.manifest(docs.repartition(3), COLUMNS).select("root").distinct().collect()
    assert [r["root"] for r in again] == [found[0]["root"]]
    assert M.manifest(nothing(spark), COLUMNS).count() == 0
    alone = M.manifest(documents(spark, ["x"]), COLUMNS).collect()
    assert alone[0]["root"] == alone[0]["subroot"] == alone[0]["leaf"] and alone[0]["proof"] == b""


def test_known_pieces_are_looked_up_once_and_long_ones_forgotten():
    import public_tokenizers

    from pagemill.llm import token_files

    class Counted(dict):
        again = 0

        def __getitem__(self, key):
            self.again += 1
            return super().__getitem__(key)

    ids = token_files.TokenIds(public_tokenizers.path("byte_bpe_50k.json"))
    ids.known = Counted()
    texts = ["", "one two  two\n\nthree 's 12", "x" * 200 + " one", "two one é", "中 one", "<|endoftext|> one"]
    for text in texts * 2:
        assert ids.encode(text) == ids._whole(text)
    assert ids.known and max(map(len, ids.known)) <= token_files.PIECE_CHARS
    ids.known.again = 0
    ids.encode("one two two one")
    first, ids.known.again = ids.known.again, 0
    ids.encode("one two two one")
    assert first <= 4 and ids.known.again == 0


def test_a_block_of_texts_asks_for_each_piece_once():
    import public_tokenizers

    from pagemill.llm import token_files

    class Counted(dict):
        asked = 0

        def get(self, key, default=None):
            Counted.asked += 1
            return super().get(key, default)

    ids = token_files.TokenIds(public_tokenizers.path("byte_bpe_50k.json"))
    blanks = ["a  b", "a   b", "a\n b", "a \nb", "a \n b", "a\n \n b", " a", "  a", "a ", "a  ", "a\n ", " ", "  ", " 's it's", "a\xa0 b", "a \xa0 b", "a 中 b"]
    texts = ["", *blanks, "<|endoftext|> a", *[f"{x} {y}" for x in blanks for y in blanks], "x" * 200 + " y" * 50]
    found, bounds = ids.encode_block(texts, (7,))
    for text, a, b in zip(texts, bounds[:-1], bounds[1:], strict=True):
        assert found[a:b].tobytes() == ids._whole(text) + b"\x07\0\0\0", repr(text)
    assert bounds[0] == 0 and bounds[-1] == len(found)
    assert [len(x) for x in ids.encode_block([])] == [0, 1]

    ids.known, words = Counted(), [f"w{i}" for i in range(50)]
    ids.encode_block([" ".join(words * 20)] * 30)
    assert Counted.asked <= 110  # 30,000 words, 100 different pieces and the first one without a space


def test_pieces_in_use_outlast_a_full_memory(monkeypatch):
    monkeypatch.setattr(K, "KNOWN_PIECES", 20)
    ids = K.TokenIds(tokenizer_path())
    for i in range(40):
        text = f"kept word {i} " + " ".join(f"other{i}x{j}" for j in range(3))
        assert ids.encode(text) == np.array(plain_ids(text)[:-1], "<u4").tobytes()
        assert " word" in ids.known and len(ids.known) + len(ids.older) <= 60


def test_only_chunks_of_several_pieces_are_cut(monkeypatch):
    class Counted:
        cut: list[str] = []

        def findall(self, text, plain=K._PIECE):
            self.cut.append(text)
            return plain.findall(text)

    monkeypatch.setattr(K, "_PIECE", Counted())
    ids = K.TokenIds(tokenizer_path())
    words = ["".join(random.Random(i).choices("abcdeéñß", k=9)) for i in range(500)]
    texts = [" ".join(words), "Übung, " + " ".join(words[::-1]), "12 it's\nend " + words[0]]
    found, bounds = ids.encode_block(texts)
    for text, a, b in zip(texts, bounds[:-1], bounds[1:], strict=True):
        assert found[a:b].tobytes() == ids._whole(text)
    assert set(["Übung,", "12", " it's\nend"]) <= set(Counted.cut) and len(Counted.cut) <= 5  # and none of the 500 words


def test_blocks_of_every_size_give_the_same_rows(monkeypatch):
    class Task:
        get = classmethod(lambda cls: cls)
        partitionId = classmethod(lambda cls: 3)

    monkeypatch.setattr(K, "TaskContext", Task)
    texts = [None, "", "one two", "a  b", "中 one", None, "x" * 60 + " y", "<|endoftext|> a", "é ñ\n\nz", ""] * 3
    rows = pa.RecordBatch.from_arrays([pa.array(range(30)), pa.array(texts, pa.string()), pa.array(["k"] * 30)], ["doc_id", "text", "kept"])
    for size in (1, 10, 64, 1 << 20):
        monkeypatch.setattr(K, "BLOCK_BYTES", size)
        found = [r for b in K._encoder(tokenizer_path(), 0)(iter([rows.slice(0, 11), rows.slice(11, 0), rows.slice(11)])) for r in b.to_pylist()]
        assert [r["tokens"] for r in found] == [plain_ids(t) for t in texts]
        assert [r["n_tokens"] for r in found] == [len(plain_ids(t)) for t in texts]
        assert [r["at"] for r in found] == [sum(len(plain_ids(t)) for t in texts[:i]) for i in range(30)]
        assert [(r["doc_id"], r["shard"], r["kept"]) for r in found] == [(i, 3, "k") for i in range(30)]
