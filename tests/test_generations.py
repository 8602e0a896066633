from __future__ import annotations

import random
from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemill.plans.scratch import scratch_path
from pagemill.sources.generations import Store

SCHEMA = T.StructType().add("crawl_id", "string").add("status", "string").add("created_at", "timestamp")
DAY = datetime(2024, 1, 1)


def rows(spark, days, per_day, status="completed"):
    made = [(f"{d:02d}-{i:05d}", status, DAY + timedelta(days=d, minutes=i // 3)) for d in range(days) for i in range(per_day)]
    random.Random(1).shuffle(made)
    return spark.createDataFrame(made, SCHEMA)


def store(spark):
    return Store(spark, scratch_path(spark, "generations"), SCHEMA)


def files(store):
    return {p: p.stat().st_mtime_ns for p in Path(store.root, "data").rglob("*.parquet")}


def keys(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "crawl_id string")


def held(df):
    return sorted((r["crawl_id"], r["status"]) for r in df.collect())


def test_a_change_rewrites_its_dates_only_and_readers_keep_theirs(spark):
    s = store(spark)
    assert s.current().number == 0 and s.read().count() == 0
    first = s.append(rows(spark, 4, 20))
    before, whole = files(s), held(s.read())
    deleted = s.delete(keys(spark, "01-00003", "01-00004", "none"))
    updated = s.upsert(spark.createDataFrame([("02-00001", "failed", DAY + timedelta(days=2)), ("new", "retry", DAY + timedelta(days=9))], SCHEMA))
    purged = s.purge(F.lit(DAY + timedelta(days=2)), 1)
    after = files(s)
    assert all(after[p] == t for p, t in before.items())  # nothing is written over
    shared = [set(a.entries) & set(b.entries) for a, b in ((first, deleted), (deleted, updated), (updated, purged))]
    assert [sorted(e.on_date.day for e in both) for both in shared] == [[1, 3, 4], [1, 2, 4], [2, 3, 3, 4, 10]]
    assert held(s.read(first)) == whole
    assert held(s.read(deleted)) == [r for r in whole if r[0] not in ("01-00003", "01-00004")]
    now = dict(held(s.read()))
    assert now["02-00001"] == "failed" and now["new"] == "retry" and len(now) == 80 - 2 + 1 - 20
    assert not any(k.startswith("00-") for k in now)
    assert s.current() == s.generation(4) and sum(e.rows for e in s.current().entries) == len(now)


def test_a_change_that_touches_nothing_keeps_all_files(spark):
    s = store(spark)
    first = s.append(rows(spark, 2, 5))
    assert set(s.delete(keys(spark, "none")).entries) == set(s.purge(F.lit(DAY), 30).entries) == set(first.entries)


def test_a_second_writer_is_refused(spark):
    s = store(spark)
    base = s.append(rows(spark, 1, 5))
    s.append(rows(spark, 1, 1, "x"))
    with pytest.raises(RuntimeError):
        s._commit(base, list(base.entries))
    assert s.current().number == 2


def test_a_look_up_reads_few_rows(spark):
    s = store(spark)
    s.append(rows(spark, 1, 30_000).coalesce(1))
    found = s.look_up("00-01234")
    assert [r["crawl_id"] for r in found.collect()] == ["00-01234"]
    leaves = found._jdf.queryExecution().executedPlan().collectLeaves()
    read = leaves.head().metrics().apply("numOutputRows").value()
    assert 0 < read <= 4000
    assert s.look_up("01-00000").count() == 0


def test_pages_by_seek_key_read_the_newest_dates(spark):
    s = store(spark)
    s.append(rows(spark, 12, 10))
    want = sorted(((r["created_at"], r["crawl_id"]) for r in s.read().collect()), key=lambda r: (-r[0].timestamp(), r[1]))
    page = s.page(15)
    assert len({f.split("on_date=")[1][:10] for f in page.inputFiles()}) == 2
    got, after = [], None
    while part := [(r["created_at"], r["crawl_id"]) for r in s.page(13, after).collect()]:
        got, after = got + part, part[-1]
    assert got == want
    late = s.page(5, (want[30][0], want[30][1]))
    assert len({f.split("on_date=")[1][:10] for f in late.inputFiles()}) <= 2
    rare = s.page(3, where=F.col("crawl_id").endswith("-00007")).collect()
    assert [r["crawl_id"] for r in rare] == ["11-00007", "10-00007", "09-00007"]
    assert s.page(5, (DAY - timedelta(days=3), "")).count() == 0


def test_folders_follow_the_rows_not_the_dates(spark):
    s = store(spark)
    made = rows(spark, 900, 2)
    first = s.append(made)
    assert len(first.entries) <= 64 and sum(e.rows for e in first.entries) == 1800
    s.append(rows(spark, 3, 1, "x").withColumn("crawl_id", F.concat(F.lit("x"), "crawl_id")))
    deleted = s.delete(keys(spark, "500-00001", "899-00000"))
    assert len(set(first.entries) - set(deleted.entries)) == 2
    updated = s.upsert(spark.createDataFrame([("501-00000", "failed", DAY + timedelta(days=400))], SCHEMA))
    want = {r["crawl_id"]: (r["created_at"], r["status"]) for r in s.read(updated).collect()}
    assert len(want) == 1800 + 3 - 2 and want["501-00000"] == (DAY + timedelta(days=400), "failed")
    order = sorted(((at, k) for k, (at, _) in want.items()), key=lambda r: (-r[0].timestamp(), r[1]))
    page = s.page(400)
    assert [(r["created_at"], r["crawl_id"]) for r in page.collect()] == order[:400]
    assert len(page.inputFiles()) < 40
    for n in (0, 700, 1000, 1790):
        assert [(r["created_at"], r["crawl_id"]) for r in s.page(25, order[n]).collect()] == order[n + 1 : n + 26]
    one = (DAY + timedelta(days=7)).date()
    assert {r["created_at"].date() for r in s.read(updated, [one]).collect()} == {one}
    purged = s.purge(F.lit(DAY + timedelta(days=700)), 1)
    left = {k for k, (at, status) in want.items() if status not in ("completed", "failed") or at >= DAY + timedelta(days=699)}
    assert {r["crawl_id"] for r in s.read(purged).collect()} == left
