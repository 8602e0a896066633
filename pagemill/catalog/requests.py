"""Request, scheduling and queue queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.catalog import stand_ins as D
from pagemill.operators import queue as Q
from pagemill.operators import requests as R
from pagemill.operators import schedule as W
from pagemill.sources.tables import read_table

DELAY_S = 60.0
AS_OF_US = D.T0_US + 30 * 86_400_000_000
BATCH = 40

REQUEST_COLUMNS = {
    "request_id": "o_orderkey",
    "url": "CASE WHEN o_orderkey % 13 = 0 THEN 'ftp://x/' WHEN o_orderkey % 17 = 0 THEN 'no url' "
    "ELSE 'https://d' || CAST(o_custkey AS STRING) || '.example/a?b=' || CAST(o_orderkey AS STRING) END",
    "priority": "CAST(CASE WHEN o_orderpriority = '1-URGENT' THEN 10 WHEN o_orderpriority = '2-HIGH' THEN 7 "
    "WHEN o_orderpriority = '3-MEDIUM' THEN NULL ELSE 1 END AS INT)",
    "max_retries": "CAST(CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderkey % 15 - 2 END AS INT)",
    "crawl_delay": "CASE o_orderkey % 6 WHEN 0 THEN CAST(0.09 AS DOUBLE) WHEN 1 THEN CAST(0.1 AS DOUBLE) "
    "WHEN 2 THEN CAST(60 AS DOUBLE) WHEN 3 THEN CAST(60.1 AS DOUBLE) WHEN 4 THEN NULL ELSE CAST(2.5 AS DOUBLE) END",
    "respect_robots_txt": "CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderkey % 2 = 0 END",
}


def request_validation(spark: SparkSession, folder: str) -> DataFrame:
    rows = read_table(spark, folder, "orders").select(
        *[F.expr(sql).alias(name) for name, sql in REQUEST_COLUMNS.items()]
    )
    return R.validate_requests(rows).select(
        "request_id", "priority", "max_retries", "crawl_delay", "respect_robots_txt",
        F.array_join("errors", "|").alias("errors"),
    )


def batch_expand(spark: SparkSession, folder: str) -> DataFrame:
    """Pages in runs of consecutive ids as batches; every fifth run is empty or holds a bad URL."""
    run = (F.col("page_id") / BATCH).cast("long")
    url = F.when(F.col("page_id") % (BATCH * 10) == 7, "ftp://bad/").otherwise(F.col("url"))
    batches = (
        read_table(spark, folder, "pages")
        .groupBy(run.alias("batch_id"))
        .agg(F.array_sort(F.collect_list(F.struct("page_id", url.alias("url")))).alias("p"))
        .select(
            "batch_id",
            F.when(F.col("batch_id") % 5 == 4, F.array().cast("array<string>"))
            .otherwise(F.transform("p", lambda x: x["url"])).alias("urls"),
            F.lit(10).alias("priority"),
            F.lit(None).cast("int").alias("max_retries"),
            F.lit(2.0).alias("crawl_delay"),
            F.lit(None).cast("boolean").alias("respect_robots_txt"),
        )
    )
    return R.expand_batches(batches).select(
        "batch_id", "position", "crawl_id", "url", "domain", "priority", "max_retries", "crawl_delay", "status"
    )


def url_to_id(spark: SparkSession, folder: str) -> DataFrame:
    """Page URLs without their query as the queue; requests ask for the URL and for its bare form."""
    pages = read_table(spark, folder, "pages")
    bare = F.regexp_replace("url", "/[0-9]+.*", "/")
    queued = pages.select(F.col("page_id").cast("string").alias("crawl_id"), bare.alias("url"))
    asked = pages.select("page_id", F.when(F.col("page_id") % 3 == 0, F.col("url")).otherwise(bare).alias("url"))
    return R.find_ids(asked, queued, "page_id").select("page_id", "url", "crawl_id")


def _arrivals(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "events").select(
        F.col("event_id").alias("request_id"),
        F.col("event_type").alias("domain"),
        F.unix_micros("ts").alias("arrival_us"),
        F.when(F.col("event_id") % 2 == 0, F.lit(DELAY_S)).otherwise(F.lit(90.0)).alias("crawl_delay"),
    )


def _settings(spark: SparkSession, folder: str) -> DataFrame:
    """Stored delays: twenty seconds per letter, for event types with an even length."""
    return (
        read_table(spark, folder, "events")
        .select(F.col("event_type").alias("domain"))
        .distinct()
        .filter(F.length("domain") % 2 == 0)
        .withColumn("crawl_delay", F.length("domain") * 20.0)
    )


def polite_schedule(spark: SparkSession, folder: str) -> DataFrame:
    return W.polite_schedule(_arrivals(spark, folder))


def polite_schedule_stored(spark: SparkSession, folder: str) -> DataFrame:
    return W.polite_schedule(_arrivals(spark, folder), _settings(spark, folder))


def effective_delays(spark: SparkSession, folder: str) -> DataFrame:
    return W.effective_delay(_arrivals(spark, folder), _settings(spark, folder))


def domain_stats(spark: SparkSession, folder: str) -> DataFrame:
    return W.domain_stats(polite_schedule(spark, folder))


def rate_waits(spark: SparkSession, folder: str) -> DataFrame:
    return W.rate_limit_waits(polite_schedule(spark, folder))


def rate_limited(spark: SparkSession, folder: str) -> DataFrame:
    """Probe one minute before the end of each domain's hour-long day of traffic."""
    return W.rate_limited(domain_stats(spark, folder), AS_OF_US - 1_000_000_000).select(
        "domain", "is_limited"
    )


def queue_next(spark: SparkSession, folder: str) -> DataFrame:
    return Q.next_due(D.queue(spark, folder), limit=100).select("crawl_id", "domain", "priority")


def queue_next_per_domain(spark: SparkSession, folder: str) -> DataFrame:
    return Q.next_due(D.queue(spark, folder), limit=1000, per_domain=3).select(
        "crawl_id", "domain", "priority", F.unix_micros("scheduled_at").alias("scheduled_us")
    )


def retry_candidates(spark: SparkSession, folder: str) -> DataFrame:
    return Q.retry_candidates(D.queue(spark, folder)).select("crawl_id", "status", "retry_count")


def queue_timings(spark: SparkSession, folder: str) -> DataFrame:
    """Schedule time of a request is that of its first event."""
    log = D.events(spark, folder)
    begun = log.groupBy("crawl_id").agg(F.min("event_at").alias("scheduled_at"))
    return Q.queue_timings(Q.current_status(log).join(begun, "crawl_id")).select(
        "crawl_id", "wait_us", "run_us"
    )


def queue_depth(spark: SparkSession, folder: str) -> DataFrame:
    return Q.queue_depth(Q.current_status(D.events(spark, folder)))


QUERIES = {
    f.__name__: f
    for f in (
        request_validation, batch_expand, url_to_id, polite_schedule, polite_schedule_stored, effective_delays,
        domain_stats, rate_waits, rate_limited, queue_next, queue_next_per_domain, retry_candidates,
        queue_timings, queue_depth,
    )
}

# --- expected results ---------------------------------------------------------------------------


def schedule_sql(stored: bool) -> str:
    chosen = "CASE WHEN length(event_type) % 2 = 0 THEN length(event_type) * 20 ELSE asked END" if stored else "asked"
    return f"""
a AS (SELECT event_id, event_type, epoch_us(ts) AS a, row_number() OVER w - 1 AS n,
  first_value(CASE WHEN event_id % 2 = 0 THEN 60 ELSE 90 END) OVER w AS asked
  FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id)),
d AS (SELECT *, CAST({chosen} AS BIGINT) * 1000000 AS d FROM a),
s AS (SELECT event_id AS request_id, event_type AS domain, a AS arrival_us, d AS delay_us, n + 1 AS request_number,
  max(a - n * d) OVER (PARTITION BY event_type ORDER BY n) + n * d AS start_us FROM d)"""


_EVENT_STATES = f"""
e AS ({D.EVENTS_SQL}),
st AS (SELECT crawl_id,
  arg_max(status, row(event_at, CASE status WHEN 'pending' THEN 0 WHEN 'retry' THEN 1 WHEN 'processing' THEN 2
    WHEN 'failed' THEN 3 ELSE 4 END)) AS status,
  max(CASE WHEN status = 'processing' THEN event_at END) AS processing_started_at,
  max(CASE WHEN status IN ('completed', 'failed') THEN event_at END) AS completed_at,
  min(event_at) AS scheduled_at, max(event_at) AS updated_at,
  arg_max(error_message, event_at) FILTER (WHERE error_message IS NOT NULL) AS error_message,
  count(*) FILTER (WHERE status = 'retry') AS retry_count FROM e GROUP BY crawl_id)"""
_REQ = D.select_sql(REQUEST_COLUMNS, "orders")
_BARE = "regexp_replace(url, '/[0-9]+.*', '/')"
_STATS = f"""WITH {schedule_sql(False)}
SELECT domain, count(*) AS request_count, max(start_us) AS last_start_us, max(delay_us) AS delay_us FROM s GROUP BY domain"""

SQL = {
    "request_validation": f"""
WITH r AS ({_REQ}), f AS (SELECT request_id, url, coalesce(priority, 5) AS priority, coalesce(max_retries, 3) AS max_retries,
  coalesce(crawl_delay, 1.0) AS crawl_delay, coalesce(respect_robots_txt, true) AS respect_robots_txt FROM r)
SELECT request_id, priority, max_retries, crawl_delay, respect_robots_txt, concat_ws('|',
  CASE WHEN url NOT LIKE 'http%' THEN 'url' END,
  CASE WHEN priority NOT IN (1, 5, 10) THEN 'priority' END,
  CASE WHEN max_retries < 0 OR max_retries > 10 THEN 'max_retries' END,
  CASE WHEN crawl_delay < 0.1 OR crawl_delay > 60 THEN 'crawl_delay' END) AS errors FROM f""",
    "batch_expand": f"""
WITH b AS (SELECT page_id // {BATCH} AS batch_id, page_id, url,
  bool_or(page_id % {BATCH * 10} = 7) OVER (PARTITION BY page_id // {BATCH}) AS bad FROM pages)
SELECT batch_id, CAST(page_id % {BATCH} AS INT) AS position,
  CAST(batch_id AS VARCHAR) || '-' || CAST(page_id % {BATCH} AS VARCHAR) AS crawl_id, url,
  regexp_extract(url, '^https?://([^/?#]*)', 1) AS domain, 10 AS priority, 3 AS max_retries,
  CAST(2 AS DOUBLE) AS crawl_delay, 'pending' AS status
FROM b WHERE NOT bad AND batch_id % 5 <> 4""",
    "url_to_id": f"""
WITH q AS (SELECT {_BARE} AS url, count(*) AS n, min(CAST(page_id AS VARCHAR)) AS crawl_id FROM pages GROUP BY 1),
a AS (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN url ELSE {_BARE} END AS url FROM pages)
SELECT a.page_id, a.url, CASE WHEN q.n = 1 THEN q.crawl_id END AS crawl_id FROM a LEFT JOIN q ON a.url = q.url""",
    "polite_schedule": f"WITH {schedule_sql(False)} SELECT *, start_us - arrival_us AS wait_us FROM s",
    "polite_schedule_stored": f"WITH {schedule_sql(True)} SELECT *, start_us - arrival_us AS wait_us FROM s",
    "effective_delays": f"WITH {schedule_sql(True)} SELECT domain, CAST(any_value(delay_us) / 1000000 AS DOUBLE) AS crawl_delay "
    "FROM s GROUP BY domain",
    "domain_stats": _STATS,
    "rate_waits": f"WITH {schedule_sql(False)} SELECT domain, count(*) FILTER (WHERE start_us > arrival_us) AS waits FROM s GROUP BY domain",
    "rate_limited": f"SELECT domain, {AS_OF_US - 1_000_000_000} - last_start_us < delay_us AS is_limited FROM ({_STATS})",
    "queue_next": f"""SELECT crawl_id, domain, priority FROM ({D.QUEUE_SQL}) WHERE status = 'pending'
ORDER BY priority DESC, scheduled_at, crawl_id LIMIT 100""",
    "queue_next_per_domain": f"""SELECT crawl_id, domain, priority, epoch_us(scheduled_at) AS scheduled_us FROM (
  SELECT *, row_number() OVER (PARTITION BY domain ORDER BY priority DESC, scheduled_at, crawl_id) AS n
  FROM ({D.QUEUE_SQL}) WHERE status = 'pending') WHERE n <= 3 ORDER BY priority DESC, scheduled_at, crawl_id LIMIT 1000""",
    "retry_candidates": f"""SELECT crawl_id, 'retry' AS status, retry_count + 1 AS retry_count FROM ({D.QUEUE_SQL})
WHERE status = 'failed' AND retry_count < max_retries""",
    "queue_timings": f"""WITH {_EVENT_STATES}
SELECT crawl_id, epoch_us(processing_started_at) - epoch_us(scheduled_at) AS wait_us,
  epoch_us(completed_at) - epoch_us(processing_started_at) AS run_us FROM st""",
    "queue_depth": f"""WITH {_EVENT_STATES}
SELECT count(*) FILTER (WHERE status = 'pending') AS queued, count(*) FILTER (WHERE status = 'processing') AS active FROM st""",
}
