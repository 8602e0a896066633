"""Gates, requests, queue, results, search, metrics and stores on small tables."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from pagemill import schemas as S
from pagemill.functions import text as X
from pagemill.operators import gates, metrics, queue, requests, results, search
from pagemill.operators.extract import keyword_list
from pagemill.plans import pipeline
from pagemill.plans.unnest import unnest
from pagemill.sources import sinks, tables

DAY = dt.datetime(2024, 1, 31)


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_gates(spark):
    limit = "x" * 100
    rows = [
        (1, 200, "text/html; charset=utf-8", "x"), (2, 404, "text/html", "x"), (3, 200, "TEXT/HTML", "x"),
        (4, 200, "application/pdf", "x"), (5, 200, None, "x"), (6, 200, "text/html", limit),
        (7, 200, "text/html", limit + "x"), (8, 200, "text/html", "é" * 51), (9, 500, "application/pdf", limit * 2), (10, None, "text/html", "x"),
    ]
    df = spark.createDataFrame(rows, "id int, status_code int, kind string, html string").withColumn(
        "response_headers", F.map_filter(F.create_map(F.lit("CONTENT-type"), F.col("kind")), lambda _, v: v.isNotNull())
    )
    gated = gates.gate_responses(df, 100)
    assert {r.id: r.reject_reason for r in gated.collect()} == {
        1: None, 2: "status", 3: None, 4: "content_type", 5: "content_type", 6: None, 7: "size", 8: "size", 9: "status", 10: "status",
    }
    assert {r.id for r in gates.accepted(gated).collect()} == {1, 3, 6}
    assert {r.error_message for r in gated.filter("id = 7").collect()} == {"Failed to crawl URL"}


def test_full_size_limit(spark):
    size = F.repeat(F.lit("x"), S.MAX_CONTENT_BYTES)
    ok, over, free = one(
        spark,
        gates.reject_reason(F.lit(200), F.lit("text/html"), size, S.MAX_CONTENT_BYTES),
        gates.reject_reason(F.lit(200), F.lit("text/html"), F.concat(size, F.lit("x")), S.MAX_CONTENT_BYTES),
        gates.reject_reason(F.lit(200), F.lit("text/html"), F.concat(size, F.lit("x"))),
    )
    assert (ok, over, free) == (None, "size", None)


def test_failed_fetches_keep_their_names(spark):
    rows = spark.createDataFrame(
        [(1, None, "timeout", None), (2, None, "error", "refused"), (3, 200, None, None), (4, 404, None, None)],
        "id int, status_code int, failure string, failure_message string",
    ).withColumn("response_headers", F.create_map(F.lit("Content-Type"), F.lit("text/html"))).withColumn("html", F.lit("x"))
    found = {r.id: (r.status, r.error_message) for r in gates.gate_responses(rows).collect()}
    assert found == {
        1: ("timeout", "Request timeout"), 2: ("error", "refused"), 3: ("completed", None), 4: ("failed", "Failed to crawl URL"),
    }


def test_header_merge(spark):
    base = F.create_map(F.lit("User-Agent"), F.lit("a"), F.lit("X"), F.lit("1"))
    none = F.lit(None).cast("map<string,string>")
    assert one(
        spark, gates.request_headers(base, F.lit("b")), gates.request_headers(base, F.lit("")), gates.request_headers(none, F.lit("c")),
    ) == ({"X": "1", "User-Agent": "b"}, {"User-Agent": "a", "X": "1"}, {"User-Agent": "c"})


def test_keyword_list(spark):
    assert one(spark, keyword_list(F.lit(" a, ,b,")), keyword_list(F.lit(None).cast("string"))) == (["a", "b"], [])


def test_batch_sizes(spark):
    sizes = {1: 0, 2: 1, 3: 1000, 4: 1001}
    rows = spark.createDataFrame([(i, [f"http://h.example/{k}" for k in range(n)]) for i, n in sizes.items()], "batch_id int, urls array<string>")
    full = rows.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in S.CRAWL_REQUEST.fields[1:]])
    out = requests.expand_batches(full)
    assert {r.batch_id: r["count"] for r in out.groupBy("batch_id").count().collect()} == {2: 1, 3: 1000}
    assert out.select("priority", "max_retries", "crawl_delay").distinct().collect() == [(5, 3, 1.0)]


def test_request_files(spark, tmp_path):
    path = tmp_path / "requests.json"
    path.write_text('{"url": "http://a.example", "priority": 7}\n{"url": "ftp://b", "max_retries": 11, "crawl_delay": 0.05}\n')
    found = requests.validate_requests(tables.read_requests(spark, str(path)))
    assert {r.url: list(r.errors) for r in found.collect()} == {
        "http://a.example": ["priority"], "ftp://b": ["url", "max_retries", "crawl_delay"],
    }


def test_status_log(spark):
    t = DAY
    rows = [
        ("a", "pending", t, None), ("a", "processing", t + dt.timedelta(1), None), ("a", "completed", t + dt.timedelta(2), None),
        ("b", "failed", t, "first"), ("b", "retry", t + dt.timedelta(1), None), ("b", "failed", t + dt.timedelta(2), "second"),
        ("c", "completed", t, None), ("c", "processing", t, None),
    ]
    state = queue.current_status(spark.createDataFrame(rows, "crawl_id string, status string, event_at timestamp, error_message string"))
    found = {r.crawl_id: (r.status, r.error_message, r.retry_count) for r in state.collect()}
    assert found == {"a": ("completed", None, 0), "b": ("failed", "second", 1), "c": ("completed", None, 0)}


def test_retries_and_due(spark):
    rows = [("a", "failed", 2, 3), ("b", "failed", 3, 3), ("c", "pending", 0, 3)]
    df = spark.createDataFrame(rows, "crawl_id string, status string, retry_count int, max_retries int")
    assert [(r.crawl_id, r.status, r.retry_count) for r in queue.retry_candidates(df).collect()] == [("a", "retry", 3)]


def test_result_view_cases(spark):
    q = spark.createDataFrame(
        [("both", "u1", "processing", "e", 1, DAY, None), ("queued", "u2", "failed", "e", 2, DAY, DAY)],
        "crawl_id string, url string, status string, error_message string, retry_count int, created_at timestamp, completed_at timestamp",
    )
    m = spark.createDataFrame(
        [("both", "m1", "T", DAY, DAY), ("stored", "m2", "S", DAY, DAY)],
        "crawl_id string, url string, title string, created_at timestamp, updated_at timestamp",
    )
    view = results.result_view(q, m)
    found = {r.crawl_id: (r.url, r.status, r.error_message, r.retry_count, r.metadata and r.metadata.title) for r in view.collect()}
    assert found == {
        "both": ("m1", "completed", None, 0, "T"), "queued": ("u2", "failed", "e", 2, None), "stored": ("m2", "completed", None, 0, "S"),
    }
    assert results.by_id(q, m, "nowhere").count() == 0
    assert results.by_id(q, m, "both").first().url == "m1"
    assert [r.crawl_id for r in results.listing(q, m, limit=9).collect()] == ["both", "queued", "stored"]
    assert [r.crawl_id for r in results.listing(q, m, limit=9, status="failed").collect()] == ["queued"]
    assert [r.crawl_id for r in results.listing(q, m, limit=9, status="processing").collect()] == []


def test_retention(spark):
    cut = DAY - dt.timedelta(30)
    rows = [
        ("old", "completed", cut - dt.timedelta(seconds=1)), ("edge", "completed", cut), ("kept", "timeout", cut - dt.timedelta(99)),
        ("err", "error", cut - dt.timedelta(99)), ("gone", "failed", cut - dt.timedelta(99)), ("new", "failed", DAY),
    ]
    h = spark.createDataFrame(rows, "crawl_id string, status string, crawl_timestamp timestamp")
    at = F.lit(DAY)
    assert {r.crawl_id for r in results.retained_history(h, at).collect()} == {"edge", "kept", "err", "new"}
    assert results.retention_count(h, at).first()[0] == 2


def test_search(spark):
    assert one(
        spark,
        search.matches_words("Red fox", F.lit("the fox"), F.lit("is RED")),
        search.matches_words("red fox", F.lit("the foxes"), F.lit(None).cast("string")),
        search.matches_words("red fox", F.lit("a fox"), any_word=True),
        X.similarity(F.lit("word"), F.lit("two words")),
        X.similarity(F.lit("Same"), F.lit("same")),
        X.similarity(F.lit(""), F.lit("..")),
    ) == (True, False, True, 4 / 11, 1.0, 0.0)


def test_histogram_and_labels(spark):
    rows = spark.createDataFrame([("d", 0.005), ("d", 0.0051), ("d", 11.0), (None, None)], "domain string, v double")
    found = metrics.histogram(rows.filter("domain is not null"), ["domain"], F.col("v")).first()
    assert (found.le_0_005, found.le_0_01, found.le_10, found.value_count) == (1, 2, 2, 3)
    assert {r.domain for r in metrics.count_by(rows, "n", domain=F.col("domain")).collect()} == {"d", "unknown"}


def test_unnest_keeps_places(spark):
    rows = spark.createDataFrame([(1, ["a", "b"]), (2, []), (3, None)], "id int, xs array<string>")
    assert sorted(map(tuple, unnest(rows, "xs", "id").collect())) == [(1, 0, "a"), (1, 1, "b")]


def test_store(spark, tmp_path):
    store, fresh = str(tmp_path / "store"), str(tmp_path / "fresh")
    rows = [(str(i), f"http://H.example:81/{i}", f"<title>t{i}</title><p>x", 200 if i < 4 else 404, 10, DAY + dt.timedelta(i)) for i in range(5)]
    df = spark.createDataFrame(
        rows, "crawl_id string, url string, html string, status_code int, response_time_ms int, fetched_at timestamp"
    ).withColumn("response_headers", F.create_map(F.lit("content-type"), F.lit("text/html")))
    pages = pipeline.page_metadata(df)
    assert pages.columns == S.PAGE_METADATA.names
    sinks.append_metadata(pages, store)
    sinks.append_history(pipeline.history_of(df), store)
    sinks.delete_results(df.filter("crawl_id in ('1', '9')"), store)
    sinks.delete_results(df.filter("crawl_id = '1'"), store)
    assert {r.crawl_id for r in sinks.read_metadata(spark, store, deletes=False).collect()} == {"0", "1", "2", "3"}
    assert {r.crawl_id for r in sinks.read_metadata(spark, store).collect()} == {"0", "2", "3"}
    assert {r.domain for r in sinks.read_history(spark, store).collect()} == {"H.example:81"}
    sinks.compact(spark, store, fresh)
    assert {r.crawl_id for r in sinks.read_metadata(spark, fresh, deletes=False).collect()} == {"0", "2", "3"}
    pruned = sinks.read_metadata(spark, store, deletes=False).filter(F.col(sinks.PARTITION) == "2024-02-01")
    assert "PartitionFilters: [isnotnull" in pruned._jdf.queryExecution().executedPlan().toString()


def test_a_store_of_many_dates_has_few_folders(spark, tmp_path):
    store, fresh = str(tmp_path / "store"), str(tmp_path / "fresh")
    rows = spark.range(700).select(
        F.col("id").cast("string").alias("crawl_id"), F.lit("completed").alias("status"),
        F.timestamp_seconds(F.lit(1_700_000_000) + F.when(F.col("id") != 5, F.col("id")) * 86_400).alias("crawl_timestamp"),
    )
    sinks.append_history(rows, store)
    sinks.append_history(rows.limit(2).withColumn("crawl_id", F.concat(F.lit("x"), "crawl_id")), store)
    assert len(list((tmp_path / "store" / "history_spans").glob("from_date=*"))) <= 65
    held = sinks.read_history(spark, store)
    assert held.count() == 702 and held.columns[-1] == sinks.PARTITION
    assert held.filter(F.to_date("crawl_timestamp") != F.col(sinks.PARTITION)).count() == 0
    assert {r.crawl_id for r in held.filter(F.col(sinks.PARTITION).isNull()).collect()} == {"5"}
    as_of = F.timestamp_seconds(F.lit(1_700_000_000 + 300 * 86_400))
    assert sinks.purge_history(spark, store, fresh, as_of, 1).first()[0] == 298 + 2
    assert sinks.read_history(spark, fresh).count() == 402
    with pytest.raises(ValueError):
        sinks.purge_history(spark, store, fresh, as_of, 1)
