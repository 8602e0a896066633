"""Streams over several files, so that state really crosses micro-batches."""

from __future__ import annotations

import itertools
import random

import pytest
from pyspark.sql import functions as F

from pagemill.streaming import fresh, jobs, polite
from tests.test_skew import SECOND, lapsing

SCHEMA = "n long, crawl_id string, status string, event_at timestamp, arrival_us long, crawl_delay double"


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    """Five files in time order."""
    folder = str(tmp_path_factory.mktemp("events"))
    for part in range(5):
        rows = spark.range(part * 40, part * 40 + 40).select(
            F.col("id").alias("n"),
            (F.col("id") % 7).cast("string").alias("crawl_id"),
            F.element_at(F.array(*map(F.lit, ["pending", "processing", "failed", "completed"])), (F.col("id") % 4).cast("int") + 1).alias("status"),
            F.timestamp_seconds(F.col("id") * 9).alias("event_at"),
            (F.col("id") * 3 * SECOND + F.when(F.col("id") >= 100, 7200 * SECOND).otherwise(0)).alias("arrival_us"),
            F.when(F.col("id") % 2 == 0, 5.0).alias("crawl_delay"),
        )
        rows.coalesce(1).write.mode("append").parquet(folder)
    return folder


def stream(spark, folder):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)


def test_status_crosses_batches(spark, files):
    found = jobs.run_updates(jobs.status_stream(stream(spark, files)), "t-status", "crawl_id")
    last = {str(k): max(n for n in range(200) if n % 7 == k) for k in range(7)}
    names = ["pending", "processing", "failed", "completed"]
    assert {r.crawl_id: r.status for r in found.collect()} == {k: names[n % 4] for k, n in last.items()}


def test_closed_windows_only(spark, files):
    counts = jobs.run_to_files(jobs.metric_stream(stream(spark, files), "status", late="30 seconds"), "t-metrics")
    total = counts.agg(F.sum("events"), F.max(F.unix_seconds("window_start"))).first()
    closed = [n for n in range(200) if n * 9 // 15 * 15 + 15 <= 199 * 9 - 30]
    assert tuple(total) == (len(closed), max(n * 9 // 15 * 15 for n in closed))


def test_results_repeat_only_after_their_lifetime(spark, files):
    found = jobs.run_to_files(fresh.fresh_result_stream(stream(spark, files).select("crawl_id", "event_at")), "t-dedup")
    assert found.count() == 7


def test_results_return_after_their_lifetime(spark, tmp_path):
    times = [0, 3000, 7200, 7300, 10_900, 10_700, 14_400]  # from a base, as nothing is later than the first watermark of all, 0
    base = 1_000_000
    for n, at in enumerate(times):
        rows = spark.createDataFrame([("a", at), ("b", 0)] if n < 2 else [("a", at)], "crawl_id string, at long")
        rows.select("crawl_id", F.timestamp_seconds(F.col("at") + base).alias("event_at")).coalesce(1).write.mode("append").parquet(str(tmp_path))
    rows = spark.readStream.schema("crawl_id string, event_at timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path))
    found = jobs.run_to_files(fresh.fresh_result_stream(rows, late="2 hours"), "t-fresh")
    kept = sorted((r.crawl_id, int(r.s) - base) for r in found.select("crawl_id", F.unix_seconds("event_at").alias("s")).collect())
    assert kept == [("a", 0), ("a", 7200), ("a", 10_900), ("b", 0)]


def test_robots_copy_valid_at_each_request(spark, tmp_path):
    """Copies a day apart both forbid; what was asked in between falls on the earlier one."""
    copies = spark.createDataFrame(
        [("d", 0, 200, "User-agent: *\nDisallow: /"), ("d", 90_000 * SECOND, 200, "User-agent: *\nDisallow: /")],
        "domain string, fetched_us long, http_status int, content string",
    )
    schema = "request_id long, domain string, url string, user_agent string, event_at timestamp"
    for n, at in enumerate([0, 7200, 88_000, 90_000, 200_000]):
        rows = spark.createDataFrame([(n, at)], "request_id long, at long")
        rows.select(
            "request_id", F.lit("d").alias("domain"), F.lit("http://d/x").alias("url"), F.lit("a").alias("user_agent"),
            F.timestamp_seconds("at").alias("event_at"),
        ).coalesce(1).write.mode("append").parquet(str(tmp_path))
    asked = spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).parquet(str(tmp_path))
    found = jobs.robots_batches(asked, lambda: copies, "t-robots")
    assert {r.request_id: r.allowed for r in found.collect()} == {0: False, 1: False, 2: True, 3: False, 4: True}


def test_polite_state_crosses_batches_and_lapses(spark, files):
    rows = stream(spark, files).select(
        F.lit("one").alias("domain"), F.col("n").alias("request_id"), "arrival_us", "crawl_delay"
    )
    found = jobs.run_to_files(polite.polite_stream(rows), "t-polite").orderBy("request_id").collect()
    arrivals = [n * 3 * SECOND + (7200 * SECOND if n >= 100 else 0) for n in range(200)]
    delays = [(5 if n % 2 == 0 else 1) * SECOND for n in range(200)]
    expected = lapsing(arrivals, delays, 3600 * SECOND)
    assert [(r.start_us, r.request_number, r.delay_us) for r in found] == expected
    assert found[100].request_number == 1


def test_polite_batches_cut_a_domain_and_keep_its_state(spark, files):
    rows = stream(spark, files).select(
        F.when(F.col("n") >= 0, "one").alias("domain"), F.col("n").alias("request_id"), "arrival_us", "crawl_delay"
    )
    found = polite.polite_batches(rows, "t-polite-batches").orderBy("request_id").collect()
    arrivals = [n * 3 * SECOND + (7200 * SECOND if n >= 100 else 0) for n in range(200)]
    delays = [(5 if n % 2 == 0 else 1) * SECOND for n in range(200)]
    assert [(r.start_us, r.request_number, r.delay_us) for r in found] == lapsing(arrivals, delays, 3600 * SECOND)


def test_polite_batch_in_chunks_equals_the_sequential_loop(spark):
    r, rows, expected = random.Random(5), [], {}
    for domain in ("a", "b", None):
        arrivals = list(itertools.accumulate(r.choice([0, 0, 1, 900, 3599, 3600, 9000]) * SECOND for _ in range(150)))
        delays = [r.choice([1, 30, 4000]) for _ in arrivals]
        both = lapsing(arrivals, [d * SECOND for d in delays], 3600 * SECOND)
        rows += [(domain, n, a, float(d)) for n, (a, d) in enumerate(zip(arrivals, delays))]
        expected |= {(domain, n): x for n, x in enumerate(both)}
    given = spark.createDataFrame(rows, "domain string, request_id long, arrival_us long, crawl_delay double")
    state, found = spark.createDataFrame([], polite.HELD), {}
    for part in (F.col("request_id") < 60, F.col("request_id") >= 60):
        out, state = polite.advance_batch(given.filter(part), state, chunks=7)
        found |= {(x.domain, x.request_id): (x.start_us, x.request_number, x.delay_us) for x in out.collect()}
    assert found == expected


def test_polite_state_is_cleared_by_time(spark, tmp_path, monkeypatch):
    """A domain not seen for its lifetime leaves the state; the others stay."""
    kept = []
    real = polite.advance_batch

    def watched(batch, state, *rest):
        kept.append(sorted(x.domain for x in state.collect()))
        return real(batch, state, *rest)

    monkeypatch.setattr(polite, "advance_batch", watched)
    for domain, at in (("a", 0), ("b", 10), ("c", 9000), ("d", 9001)):
        spark.createDataFrame([(domain, 1, at * SECOND, 1.0)], "domain string, request_id long, arrival_us long, crawl_delay double").coalesce(1).write.mode("append").parquet(str(tmp_path))
    rows = spark.readStream.schema("domain string, request_id long, arrival_us long, crawl_delay double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path))
    assert polite.polite_batches(rows, "t-polite-state").count() == 4
    assert kept == [[], ["a"], ["a", "b"], ["c"]]
