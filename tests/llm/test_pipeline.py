"""The pipeline's stages on a small corpus, each against a plain version, and the registered queries."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as driver
import corpus_pipeline as C
from pagemill.llm import catalog, hyperminhash, systematic_mix, toxicity
from tests.llm.helpers import clashing, documents
from tests.llm.test_near_duplicates import plain as plain_components
from tests.llm.test_sampling_and_shards import filled
from tests.llm.test_texts import plain_spans, tokens

FOLDER = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r = random.Random(11)
    texts = []
    for i in range(240):
        words = [f"w{r.randrange(900)}" for _ in range(r.choice([2, 9, 60, 300]))]
        if i % 10 == 0:
            words += ["idiot", "moron", "scum"]
        if i % 7 == 0:
            words.insert(1, f"mail{i}@host{i}.example.org")
        texts.append(" ".join(words))
    texts += [texts[3], texts[5] + " x"] + ["same words over and over again and again"] * 80 + ["", None]
    docs = documents(spark, texts, sources=[None if i % 50 == 49 else f"s{i % 4}" for i in range(len(texts))])
    labels = spark.createDataFrame([(i, int(i % 10 == 0), 1) for i in range(240)], "doc_id long, toxic int, quality int")
    place = str(tmp_path_factory.mktemp("corpus"))
    docs.write.parquet(f"{place}/documents.parquet")
    labels.write.parquet(f"{place}/labels.parquet")
    return place


@pytest.fixture(scope="module")
def stages(spark, folder, tmp_path_factory):
    """What goes into each stage, and what comes out of the last."""
    place, docs, found = str(tmp_path_factory.mktemp("stages")), spark.read.parquet(f"{folder}/documents.parquet"), []
    for name, stage in C.STAGES:
        found.append(docs.collect())
        stage(spark, docs, folder).write.parquet(f"{place}/{name}")
        docs = spark.read.parquet(f"{place}/{name}")
        assert name == "packing" or docs.columns == COLUMNS
    return [*found, docs.collect()]


def test_names_and_order():
    assert [n for n, _ in C.STAGES] == ["toxicity", "near_dedup", "pii", "mixing", "packing"] and C.ORACLE_SQL is None


def test_toxic_documents_go_and_others_stay(stages):
    kept = {r["doc_id"] for r in stages[1]}
    assert kept == {r["doc_id"] for r in stages[0]} - set(range(0, 240, 10))


def test_one_document_of_each_group_stays(stages):
    given = sorted(stages[1], key=lambda r: r["doc_id"])
    plain = plain_components([r["text"] for r in given], 5, 80)
    wanted = [given[i]["doc_id"] for i, _, _, kept in plain if kept]
    assert sorted(r["doc_id"] for r in stages[2]) == wanted


def test_texts_that_share_an_id_are_documents_of_their_own(spark, folder):
    """Whatever the partitioning, and with columns of clashing names, the same rows stay."""
    base = " ".join(f"a{i}" for i in range(60))
    other = " ".join(f"b{i}" for i in range(60))
    texts = [base, other, other + " x", base, "alone at last", "alone at last", base, base]
    ids = [10, 10, 11, 9, 7, 7, None, None]
    docs = clashing(documents(spark, texts, ids, sources=[*"abcdefgh"])).withColumn("notes", F.create_map(F.lit("k"), F.lit(1)))
    found = []
    for parts in (1, 2, 7):
        kept = C.drop_near_duplicates(spark, docs.repartition(parts, "text", "source"), folder)
        assert kept.columns == docs.columns
        found.append(sorted(((r["doc_id"], r["text"], r["source"]) for r in kept.collect()), key=repr))
    assert found[0] == found[1] == found[2]
    # 9 stands for both copies of the first text, 10 for its other text, 7 leaves one row; rows without an id stay.
    assert [(i, t) for i, t, _ in found[0]] == sorted(
        [(9, base), (10, other), (7, "alone at last"), (None, base), (None, base)], key=repr
    )


def test_identifiers_are_replaced(stages):
    before = {r["doc_id"]: r["text"] for r in stages[2]}
    for r in stages[3]:
        text, spans = before[r["doc_id"]], plain_spans(before[r["doc_id"]] or "")
        for start, end, kind in reversed(spans):
            text = text[:start] + f"[{kind.upper()}]" + text[end:]
        assert r["text"] == text and r["n_chars"] == (None if text is None else len(text))
    assert len(stages[3]) == len(stages[2])


def test_copies_follow_the_sums(stages):
    """Systematic sampling by hand: a running sum of steps and the boundaries it crosses."""
    size = {r["doc_id"]: len((r["text"] or "").split()) for r in stages[3]}
    by_source = {}
    for r in stages[3]:
        by_source.setdefault(r["source"], []).append(r["doc_id"])
    targets = filled({s: sum(size[d] for d in ids) for s, ids in by_source.items()}, (1, 2, 3), 3)
    expected, unit = Counter(), systematic_mix.UNIT
    for source, ids in by_source.items():
        total = sum(size[d] for d in ids)
        step = min(3 * unit, int(targets[source] / total * unit)) if total else 0
        name = "mix" + ("null" if source is None else "=" + source)
        at = int(hashlib.md5(name.encode()).hexdigest()[:6], 16)
        for d in sorted(ids, key=lambda d: (size[d], d)):
            expected[d] = (at + step) // unit - at // unit
            at += step
    assert Counter(r["doc_id"] for r in stages[4]) == Counter({d: n for d, n in expected.items() if n})


def test_packing_covers_every_token(stages):
    count = Counter(r["doc_id"] for r in stages[4])
    text = {r["doc_id"]: r["text"] for r in stages[4]}
    length = dict(zip(text, (len(t) for t in tokens(list(text.values()))), strict=True))
    covered = Counter()
    for p in stages[5]:
        covered[p["doc_id"]] += p["length"]
    assert covered == Counter({d: n * length[d] for d, n in count.items()})


def test_run_gives_the_last_stage(spark, folder, stages):
    key = ("doc_id", "start", "length", "ids_crc32", "doc_tokens")
    cut = {tuple(p[k] for k in ("doc_id", "doc_tokens")) for p in stages[5]}
    found = C.run(spark, folder).collect()
    assert {(p["doc_id"], p["doc_tokens"]) for p in found} == cut and set(key) <= set(found[0].asDict())


def test_an_empty_corpus_passes(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in C.STAGES:
        assert stage(spark, docs, folder).count() == 0


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, name):
    """Every registered query runs over its whole table; those with SQL equal it."""
    found = driver.queries()[name](spark, FOLDER)
    rows = found.collect()
    if "doc_id" in found.columns and "start" not in found.columns:
        assert len(rows) == spark.read.parquet(f"{FOLDER}/documents.parquet").count()
    sql = driver.oracle_sql().get(name)
    if sql:
        duck = duckdb.connect()
        for t in ("documents", "embeddings", "labels", "benchmark"):
            duck.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
        expected = duck.sql(sql)
        order = sorted(found.columns)
        assert order == sorted(expected.columns)
        place = [expected.columns.index(c) for c in order]
        assert sorted(tuple(r[c] for c in order) for r in rows) == sorted(tuple(e[i] for i in place) for e in expected.fetchall())


def test_toxic_scores_hold_out_a_third(spark):
    held = catalog.op7_toxicity(spark, FOLDER).agg(F.avg(F.col("held_out").cast("int"))).first()[0]
    assert 0.2 < held < 0.5 and toxicity.REJECT == 0.7 and hyperminhash.BUCKETS == 160
