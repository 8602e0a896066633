"""Status, result, delete, retention, batch and store queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemill.catalog import stand_ins as D
from pagemill.catalog.pages import HOST_SQL, TITLE_SQL
from pagemill.catalog.requests import _EVENT_STATES
from pagemill.operators import extract as E
from pagemill.operators import queue as Q
from pagemill.operators import results as R
from pagemill.plans import pipeline
from pagemill.plans.scratch import scratch_path
from pagemill.sources import sinks
from pagemill.sources.generations import Store

AS_OF = "2024-01-31 00:00:00"
KEEP_DAYS = 10
PURGE_AFTER_US = 3 * 86_400_000_000


def status_current(spark: SparkSession, folder: str) -> DataFrame:
    state = Q.current_status(D.events(spark, folder))
    return state.select(
        "crawl_id", "status", "error_message", "retry_count",
        *[F.unix_micros(c).alias(c.replace("_at", "_us")) for c in ("updated_at", "processing_started_at", "completed_at")],
    )


def _stored(spark: SparkSession, folder: str) -> DataFrame:
    """Page metadata under every third queue id; ids past the queue exist only here."""
    stamp = F.timestamp_micros(F.lit(D.T0_US) + F.col("page_id") * 3_600_000_000)
    return E.extract(D.pages(spark, folder), "domain", "title").select(
        (F.col("page_id") * 3 + F.when(F.col("page_id") % 7 == 0, 100_000_000).otherwise(0)).cast("string").alias("crawl_id"),
        "url", "domain", "title",
        stamp.alias("created_at"),
        (stamp + F.make_dt_interval(mins=F.lit(5))).alias("updated_at"),
    )


def _view(spark: SparkSession, folder: str) -> DataFrame:
    return R.result_view(D.queue(spark, folder), _stored(spark, folder))


def _flat(results: DataFrame) -> DataFrame:
    return results.select(
        "crawl_id", "url", "status", "error_message", "retry_count",
        F.col("metadata.title").alias("title"),
        F.unix_micros("created_at").alias("created_us"),
        F.unix_micros("completed_at").alias("completed_us"),
    )


def result_view(spark: SparkSession, folder: str) -> DataFrame:
    return _flat(_view(spark, folder))


def result_by_id(spark: SparkSession, folder: str) -> DataFrame:
    return _flat(R.by_id(D.queue(spark, folder), _stored(spark, folder), "3"))


def result_list(spark: SparkSession, folder: str) -> DataFrame:
    return _flat(R.listing(D.queue(spark, folder), _stored(spark, folder), limit=20, offset=10))


def result_list_by_domain(spark: SparkSession, folder: str) -> DataFrame:
    """Stored pages of one host, newest first."""
    stored = _stored(spark, folder)
    return R.list_results(stored, limit=10, domain="m.ththth.example.net").select("crawl_id", "url", "title")


def result_list_by_status(spark: SparkSession, folder: str) -> DataFrame:
    return _flat(R.listing(D.queue(spark, folder), _stored(spark, folder), limit=50, status="failed"))


def result_delete(spark: SparkSession, folder: str) -> DataFrame:
    """Stored pages without those whose queue row failed."""
    failed = D.queue(spark, folder).filter(F.col("status") == "failed").select("crawl_id")
    return R.without_deleted(_stored(spark, folder), failed).select("crawl_id", "url")


def _history(spark: SparkSession, folder: str) -> DataFrame:
    return D.events(spark, folder).withColumnRenamed("event_at", "crawl_timestamp")


def history_retention(spark: SparkSession, folder: str) -> DataFrame:
    kept = R.retained_history(_history(spark, folder), F.to_timestamp(F.lit(AS_OF)), KEEP_DAYS)
    return kept.groupBy("status").agg(
        F.count(F.lit(1)).alias("kept"), F.unix_micros(F.min("crawl_timestamp")).alias("oldest_us")
    )


def history_deleted(spark: SparkSession, folder: str) -> DataFrame:
    return R.retention_count(_history(spark, folder), F.to_timestamp(F.lit(AS_OF)), KEEP_DAYS)


def batch_totals(spark: SparkSession, folder: str) -> DataFrame:
    members = D.queue(spark, folder).select(
        "crawl_id", (F.col("crawl_id").cast("long") / 200).cast("long").alias("batch_id")
    )
    totals = R.batch_totals(members, _view(spark, folder))
    return totals.withColumn("success_rate", D.r6("success_rate"))


def sink_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """Write metadata, status events and history, delete some results, read all back."""
    store = scratch_path(spark, "store")
    responses = D.responses(spark, folder)
    sinks.append_metadata(pipeline.page_metadata(responses), store)
    history = pipeline.history_of(responses)
    sinks.append_history(history, store)
    sinks.append_status(
        history.select("crawl_id", "status", F.col("crawl_timestamp").alias("event_at"), "error_message"), store
    )
    sinks.delete_results(responses.filter(F.col("page_id") % 4 == 0), store)
    stored = sinks.read_metadata(spark, store).select(
        "crawl_id", "title", "word_count", F.size("links").alias("n_links"), "content_hash"
    )
    log = sinks.read_history(spark, store).select("crawl_id", "domain", "status_code", "response_time_ms")
    state = sinks.read_status(spark, store).select("crawl_id", "status", "error_message")
    return state.join(log, "crawl_id").join(stored, "crawl_id", "left")


def store_serves(spark: SparkSession, folder: str) -> DataFrame:
    """Append, delete, compact, then view, list and look up on the compacted store, before and after any delete."""
    store, compacted = scratch_path(spark, "store"), scratch_path(spark, "store")
    stamp = F.timestamp_micros(F.lit(D.T0_US) + F.col("page_id") * 3_600_000_000)
    responses = D.responses(spark, folder).withColumn("fetched_at", stamp)
    sinks.append_metadata(pipeline.page_metadata(responses), store)
    queue = D.queue(spark, folder)
    before = sinks.read_metadata(spark, store).select(F.lit("stored").alias("step"), "crawl_id", F.unix_micros("created_at").alias("created_us"))
    sinks.delete_results(responses.filter(F.col("page_id") % 4 == 0), store)
    sinks.compact(spark, store, compacted)
    stored = sinks.read_metadata(spark, compacted)

    def told(step: str, results: DataFrame) -> DataFrame:
        return results.select(F.lit(step).alias("step"), "crawl_id", F.unix_micros("created_at").alias("created_us"))

    return (
        before.unionByName(told("listed", R.listing(queue, stored, limit=30)))
        .unionByName(told("domain", R.listing(queue, stored, limit=30, domain="m.ththth.example.net")))
        .unionByName(told("one", R.by_id(queue, stored, "5")))
    )


def history_purge(spark: SparkSession, folder: str) -> DataFrame:
    """Append history, with fetches that timed out, purge it, and report what is left and what went."""
    store, purged = scratch_path(spark, "store"), scratch_path(spark, "store")
    stamp = F.timestamp_micros(F.lit(D.T0_US) + F.col("page_id") * 3_600_000_000)
    responses = D.responses(spark, folder).withColumn("fetched_at", stamp).withColumn(
        "failure", F.when(F.col("page_id") % 6 == 0, "timeout").when(F.col("page_id") % 6 == 1, "error")
    ).withColumn("failure_message", F.when(F.col("failure") == "error", "refused"))
    sinks.append_history(pipeline.history_of(responses), store)
    as_of = F.timestamp_micros(F.lit(D.T0_US + PURGE_AFTER_US))
    gone = sinks.purge_history(spark, store, purged, as_of, 1)
    kept = sinks.read_history(spark, purged).groupBy("status", "error_message").agg(F.count(F.lit(1)).alias("n"))
    return kept.unionByName(
        gone.select(F.lit("deleted").alias("status"), F.lit(None).cast("string").alias("error_message"), F.col("deleted_count").alias("n"))
    )


STORED = T.StructType().add("crawl_id", "string").add("domain", "string").add("title", "string").add("status", "string").add("created_at", "timestamp")
CHANGED_AT_US = D.T0_US + 2 * 86_400_000_000


def _generations(spark: SparkSession, folder: str) -> Store:
    """A store after an append (1), status updates (2), deletes (3) and a purge (4)."""
    store = Store(spark, scratch_path(spark, "generations"), STORED)
    stamp = F.timestamp_micros(F.lit(D.T0_US) + F.col("page_id") * 3_600_000_000)
    rows = E.extract(D.pages(spark, folder), "domain", "title").select(
        "page_id", F.col("page_id").cast("string").alias("crawl_id"), "domain", "title",
        F.when(F.col("page_id") % 5 == 0, "pending").otherwise("completed").alias("status"), stamp.alias("created_at"),
    )
    store.append(rows)
    store.upsert(rows.filter((F.col("status") == "pending") & (F.col("page_id") < 40)).withColumn("status", F.lit("failed")))
    store.delete(rows.filter(F.col("page_id").between(60, 75)))
    store.purge(F.timestamp_micros(F.lit(CHANGED_AT_US)), 1)
    return store


def store_generations(spark: SparkSession, folder: str) -> DataFrame:
    """Every generation of a store that was updated, deleted from and purged, as readers of each see it."""
    store = _generations(spark, folder)
    seen = [
        store.read(store.generation(n)).select(F.lit(n).alias("generation"), "crawl_id", "title", "status")
        for n in range(1, store.current().number + 1)
    ]
    return reduce(DataFrame.unionByName, seen)


def store_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Three pages of a store, each behind the last row of the one before, one page of a host, and one row by its id."""
    store = _generations(spark, folder)
    pages, after = [], None
    for n in range(3):
        page = store.page(12, after).select(F.lit(f"page {n}").alias("part"), "crawl_id", "created_at")
        last = page.orderBy("created_at", F.desc("crawl_id")).first()
        after = (last["created_at"], last["crawl_id"]) if last else after
        pages.append(page)
    host = store.page(5, where=F.col("domain") == "m.ththth.example.net")
    pages += [d.select(F.lit(part).alias("part"), "crawl_id", "created_at") for part, d in (("host", host), ("one", store.look_up("41")))]
    found = reduce(DataFrame.unionByName, pages)
    return found.select("part", "crawl_id", F.unix_micros("created_at").alias("created_us"))


def nested_json(spark: SparkSession, folder: str) -> DataFrame:
    """Links to JSON text and back."""
    pages = E.extract(D.pages(spark, folder), "links").select("page_id", "links", sinks.encoded("links").alias("text"))
    back = sinks.decoded("text", pages.schema["links"].dataType)
    return pages.select(
        "page_id", (back == F.col("links")).alias("same"), F.size(back).alias("n_links")
    )


QUERIES = {
    f.__name__: f
    for f in (
        status_current, result_view, result_by_id, result_list, result_list_by_domain, result_list_by_status,
        result_delete, history_retention, history_deleted, batch_totals, sink_roundtrip, store_serves, store_generations, store_pages, history_purge, nested_json,
    )
}

# --- expected results ---------------------------------------------------------------------------

_META = f"""
meta AS (SELECT CAST(page_id * 3 + CASE WHEN page_id % 7 = 0 THEN 100000000 ELSE 0 END AS VARCHAR) AS crawl_id, url,
  {HOST_SQL} AS domain, {TITLE_SQL} AS title, {D.T0_US} + page_id * 3600000000 AS created_us FROM pages)"""
_VIEW = f"""{_META}, que AS ({D.QUEUE_SQL}),
v AS (SELECT coalesce(m.crawl_id, q.crawl_id) AS crawl_id, coalesce(m.url, q.url) AS url,
  CASE WHEN m.crawl_id IS NOT NULL THEN 'completed' ELSE q.status END AS status,
  CASE WHEN m.crawl_id IS NULL THEN q.error_message END AS error_message,
  CASE WHEN m.crawl_id IS NULL THEN q.retry_count ELSE 0 END AS retry_count, m.title,
  CASE WHEN m.crawl_id IS NULL THEN epoch_us(q.created_at) ELSE m.created_us END AS created_us,
  CASE WHEN m.crawl_id IS NULL THEN epoch_us(q.completed_at) ELSE m.created_us + 300000000 END AS completed_us
  FROM que q FULL JOIN meta m ON q.crawl_id = m.crawl_id)"""
_CUT = f"ts < TIMESTAMP '{AS_OF}' - INTERVAL {KEEP_DAYS} DAY AND event_type IN ('purchase', 'error')"

SQL = {
    "status_current": f"""WITH {_EVENT_STATES}
SELECT crawl_id, status, error_message, retry_count, epoch_us(updated_at) AS updated_us,
  epoch_us(processing_started_at) AS processing_started_us, epoch_us(completed_at) AS completed_us FROM st""",
    "result_view": f"WITH {_VIEW} SELECT * FROM v",
    "result_by_id": f"WITH {_VIEW} SELECT * FROM v WHERE crawl_id = '3'",
    "result_list": f"WITH {_VIEW} SELECT * FROM v ORDER BY created_us DESC, crawl_id LIMIT 20 OFFSET 10",
    "result_list_by_domain": f"""WITH {_META} SELECT crawl_id, url, title FROM meta WHERE domain = 'm.ththth.example.net'
ORDER BY created_us DESC, crawl_id LIMIT 10""",
    "result_list_by_status": f"WITH {_VIEW} SELECT * FROM v WHERE status = 'failed' ORDER BY created_us DESC, crawl_id LIMIT 50",
    "result_delete": f"""WITH {_META} SELECT crawl_id, url FROM meta WHERE crawl_id NOT IN
(SELECT CAST(o_orderkey AS VARCHAR) FROM orders WHERE o_orderstatus = 'F')""",
    "history_retention": f"""SELECT {D.STATUS_OF_EVENT} AS status, count(*) AS kept, epoch_us(min(ts)) AS oldest_us
FROM events WHERE NOT ({_CUT}) GROUP BY 1""",
    "history_deleted": f"SELECT count(*) AS deleted_count FROM events WHERE {_CUT}",
    "batch_totals": f"""WITH {_VIEW}
SELECT CAST(crawl_id AS BIGINT) // 200 AS batch_id, count(*) AS total_urls,
  count(*) FILTER (WHERE status = 'completed') AS completed_urls, count(*) FILTER (WHERE status = 'failed') AS failed_urls,
  round(count(*) FILTER (WHERE status = 'completed') / count(*), 6) AS success_rate
FROM v WHERE crawl_id IN (SELECT CAST(o_orderkey AS VARCHAR) FROM orders) GROUP BY 1""",
}


def _roundtrip_sql() -> str:
    from pagemill.catalog.pages import SQL as PAGES

    return f"""
WITH core AS ({PAGES['page_core']}), links AS ({PAGES['page_link_counts']}),
r AS (SELECT page_id, url, {D.STATUS_CODE} AS status_code, {D.CONTENT_TYPE} AS ct, {D.RESPONSE_MS} AS response_time_ms FROM pages),
g AS (SELECT *, status_code = 200 AND coalesce(lower(ct), '') LIKE 'text/html%' AS ok FROM r)
SELECT CAST(page_id AS VARCHAR) AS crawl_id, CASE WHEN ok THEN 'completed' ELSE 'failed' END AS status,
  CASE WHEN NOT ok THEN 'Failed to crawl URL' END AS error_message, {HOST_SQL} AS domain, status_code, response_time_ms,
  CASE WHEN ok AND page_id % 4 <> 0 THEN title END AS title,
  CASE WHEN ok AND page_id % 4 <> 0 THEN word_count END AS word_count,
  CASE WHEN ok AND page_id % 4 <> 0 THEN n_links END AS n_links,
  CASE WHEN ok AND page_id % 4 <> 0 THEN content_hash END AS content_hash
FROM g JOIN core USING (page_id) JOIN links USING (page_id)"""


SQL["sink_roundtrip"] = _roundtrip_sql()
_GATED = f"""
r AS (SELECT page_id, {HOST_SQL} AS domain, {D.STATUS_CODE} AS status_code, {D.CONTENT_TYPE} AS ct, {D.T0_US} + page_id * 3600000000 AS at_us FROM pages),
g AS (SELECT *, status_code = 200 AND coalesce(lower(ct), '') LIKE 'text/html%' AS ok FROM r)"""
SQL["store_serves"] = f"""WITH {_GATED},
kept AS (SELECT CAST(page_id AS VARCHAR) AS crawl_id, domain, at_us FROM g WHERE ok AND page_id % 4 <> 0),
que AS ({D.QUEUE_SQL}),
seen AS (SELECT crawl_id, at_us AS created_us FROM kept UNION ALL
  SELECT crawl_id, epoch_us(created_at) FROM que WHERE crawl_id NOT IN (SELECT crawl_id FROM kept))
SELECT 'stored' AS step, CAST(page_id AS VARCHAR) AS crawl_id, at_us AS created_us FROM g WHERE ok
UNION ALL (SELECT 'listed', crawl_id, created_us FROM seen ORDER BY created_us DESC, crawl_id LIMIT 30)
UNION ALL (SELECT 'domain', crawl_id, at_us FROM kept WHERE domain = 'm.ththth.example.net' ORDER BY at_us DESC, crawl_id LIMIT 30)
UNION ALL SELECT 'one', crawl_id, created_us FROM seen WHERE crawl_id = '5'"""
SQL["history_purge"] = f"""WITH {_GATED},
h AS (SELECT *, CASE WHEN page_id % 6 = 0 THEN 'timeout' WHEN page_id % 6 = 1 THEN 'error' WHEN ok THEN 'completed' ELSE 'failed' END AS status,
  CASE WHEN page_id % 6 = 0 THEN 'Request timeout' WHEN page_id % 6 = 1 THEN 'refused' WHEN NOT ok THEN 'Failed to crawl URL' END AS error_message,
  at_us < {D.T0_US + PURGE_AFTER_US} - 86400000000 AS old FROM g)
SELECT status, error_message, count(*) AS n FROM h WHERE NOT (old AND status IN ('completed', 'failed')) GROUP BY ALL
UNION ALL SELECT 'deleted', NULL, count(*) FROM h WHERE old AND status IN ('completed', 'failed')"""
SQL["nested_json"] = """SELECT page_id, true AS same, CAST(len(regexp_extract_all(html, '<a href="[^"]+"')) AS INT) AS n_links
FROM pages"""
_GENERATIONS = f"""
s1 AS (SELECT page_id, CAST(page_id AS VARCHAR) AS crawl_id, {HOST_SQL} AS domain, {TITLE_SQL} AS title,
  CASE WHEN page_id % 5 = 0 THEN 'pending' ELSE 'completed' END AS status, {D.T0_US} + page_id * 3600000000 AS created_us FROM pages),
s2 AS (SELECT * REPLACE (CASE WHEN page_id % 5 = 0 AND page_id < 40 THEN 'failed' ELSE status END AS status) FROM s1),
s3 AS (SELECT * FROM s2 WHERE page_id NOT BETWEEN 60 AND 75),
s4 AS (SELECT * FROM s3 WHERE NOT (status IN ('completed', 'failed') AND created_us < {CHANGED_AT_US} - 86400000000))"""
SQL["store_generations"] = f"WITH {_GENERATIONS} " + " UNION ALL ".join(
    f"SELECT {n} AS generation, crawl_id, title, status FROM s{n}" for n in range(1, 5)
)
SQL["store_pages"] = f"""WITH {_GENERATIONS},
n AS (SELECT *, row_number() OVER (ORDER BY created_us DESC, crawl_id) - 1 AS nth FROM s4)
SELECT 'page ' || (nth // 12) AS part, crawl_id, created_us FROM n WHERE nth < 36
UNION ALL (SELECT 'host', crawl_id, created_us FROM s4 WHERE domain = 'm.ththth.example.net' ORDER BY created_us DESC, crawl_id LIMIT 5)
UNION ALL SELECT 'one', crawl_id, created_us FROM s4 WHERE crawl_id = '41'"""
