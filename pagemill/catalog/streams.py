"""Streaming queries: the sample tables as file streams, run over what is available."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.catalog import stand_ins as D
from pagemill.catalog import topics as TC
from pagemill.catalog.pages import SQL as PAGES
from pagemill.catalog.requests import _EVENT_STATES
from pagemill.catalog.robots import _FRESH, _TARGET, _VERDICT
from pagemill.functions import urls as U
from pagemill.operators import rollups
from pagemill.operators.queue import STATUS_RANK
from pagemill.sources.tables import stream_table
from pagemill.streaming import copies, fresh, jobs, machine, polite

LATE = "1 minute"
EVENT_US = f"({D.T0_US} + page_id * 600000000 + 43200000000)"


def _events(spark: SparkSession, folder: str) -> DataFrame:
    return stream_table(spark, folder, "events").select(
        *[F.expr(sql).alias(name) for name, sql in D.EVENT_COLUMNS.items()]
    )


def stream_extract(spark: SparkSession, folder: str) -> DataFrame:
    fields = ("title", "description", "keywords", "language", "word_count", "content_hash", "body_text")
    rows = jobs.extract_stream(stream_table(spark, folder, "pages"), *fields, topics=TC.SAMPLE_TOPICS).select(
        "page_id", "title", "language", "word_count", "content_hash",
        F.array_join(F.col("topics.topic"), "|").alias("topics"),
    )
    return jobs.run_to_files(rows, "stream-extract")


def stream_status(spark: SparkSession, folder: str) -> DataFrame:
    states = jobs.run_updates(jobs.status_stream(_events(spark, folder)), "stream-status", "crawl_id")
    return states.select("crawl_id", "status", F.unix_micros("updated_at").alias("updated_us"))


def stream_metrics(spark: SparkSession, folder: str) -> DataFrame:
    counts = jobs.run_updates(
        jobs.metric_stream(_events(spark, folder), "status", "domain", late=LATE), "stream-metrics",
        "window_start", "status", "domain",
    )
    return counts.withColumn("window_start", F.unix_micros("window_start"))


def stream_machine(spark: SparkSession, folder: str) -> DataFrame:
    """Status changes that may follow the status held, and those that may not."""
    return jobs.run_to_files(machine.checked_status_stream(_events(spark, folder)), "stream-machine")


def stream_counters(spark: SparkSession, folder: str) -> DataFrame:
    """Counters kept by a stream, after three batches of a table and a replay of one of them are added."""
    path = jobs.keep_counters(_events(spark, folder), "stream-counters")
    table = D.events(spark, folder)
    for batch in (101, 102, 103, 102):
        rollups.keep_batch(table.filter(F.col("event_id") % 3 == batch % 3), path, batch)
    kept = rollups.kept_totals(spark, path, "domain", "status")
    return kept.select(
        "domain", "status", "fetches", "le_0_1", "le_0_5", "ms_sum", "ms_count", F.unix_micros("first_at").alias("first_us"),
        F.unix_micros("last_at").alias("last_us"),
    )


def stream_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Looked-up results: the first per user and status, and the first after each lifetime of an hour."""
    looked_up = _events(spark, folder).select(F.concat_ws("-", "crawl_id", "status").alias("crawl_id"), "event_at")
    kept = jobs.run_to_files(fresh.fresh_result_stream(looked_up), "stream-dedup")
    return kept.select("crawl_id", F.unix_micros("event_at").alias("event_us"))


def stream_robots(spark: SparkSession, folder: str) -> DataFrame:
    requests = stream_table(spark, folder, "pages").select(
        F.col("page_id").alias("request_id"),
        "url",
        U.netloc_key(F.col("url")).alias("domain"),
        F.expr(D.AGENT).alias("user_agent"),
        F.timestamp_micros(F.expr(EVENT_US)).alias("event_at"),
    )
    checked = jobs.robots_batches(requests, lambda: D.snapshots(spark, folder), "stream-robots")
    return checked.select("request_id", "domain", "allowed")


def stream_robots_fresh(spark: SparkSession, folder: str) -> DataFrame:
    """Requests and robots copies as two streams: the newest copy valid at each request."""
    pages = stream_table(spark, folder, "pages").withColumn("domain", U.netloc_key(F.col("url")))
    requests = pages.select(F.col("page_id").alias("request_id"), "domain", F.timestamp_micros(F.expr(EVENT_US)).alias("event_at"))
    held = pages.select("domain", F.timestamp_micros(F.expr(D.SNAPSHOT_US)).alias("fetched_at"))
    found = copies.run_to_end(requests, held, "stream-robots-fresh")
    return found.select("request_id", "domain", F.unix_micros("event_at").alias("arrival_us"), "snapshot_us")


def stream_polite(spark: SparkSession, folder: str) -> DataFrame:
    arrivals = stream_table(spark, folder, "events").select(
        F.col("event_type").alias("domain"),
        F.col("event_id").alias("request_id"),
        F.unix_micros("ts").alias("arrival_us"),
        F.lit(60.0).alias("crawl_delay"),
    )
    return polite.polite_batches(arrivals, "stream-polite")


QUERIES = {
    f.__name__: f
    for f in (stream_extract, stream_status, stream_machine, stream_metrics, stream_counters, stream_dedup, stream_robots, stream_robots_fresh, stream_polite)
}

# --- expected results ---------------------------------------------------------------------------

_RANK_SQL = "CASE status " + " ".join(f"WHEN '{s}' THEN {r}" for s, r in STATUS_RANK.items()) + " ELSE -1 END"
_LEGAL_SQL = ", ".join(f"'{a}>{b}'" for a, following in machine.FOLLOWS.items() for b in following)

SQL = {
    "stream_extract": f"""WITH {TC.hits_sql(TC._PAGES, 'page_id', TC.SAMPLE_TOPICS)}, core AS ({PAGES['page_core']}),
c AS (SELECT page_id, string_agg(topic, '|' ORDER BY rank) AS names FROM chosen GROUP BY page_id)
SELECT page_id, title, language, word_count, content_hash, coalesce(names, '') AS topics FROM core LEFT JOIN c USING (page_id)""",
    "stream_status": f"WITH {_EVENT_STATES} SELECT crawl_id, status, epoch_us(updated_at) AS updated_us FROM st",
    "stream_metrics": f"""SELECT epoch_us(event_at) // 15000000 * 15000000 AS window_start, status, domain, count(*) AS events
FROM ({D.EVENTS_SQL}) GROUP BY ALL""",
    "stream_machine": f"""WITH RECURSIVE e AS (
  SELECT crawl_id, status, epoch_us(event_at) AS us, row_number() OVER (
    PARTITION BY crawl_id ORDER BY event_at, {_RANK_SQL}) AS n FROM ({D.EVENTS_SQL})),
run(crawl_id, n, held, held_us, us, status, from_status, legal) AS (
  SELECT DISTINCT crawl_id, 0::BIGINT, NULL::VARCHAR, 0::BIGINT, 0::BIGINT, NULL::VARCHAR, NULL::VARCHAR, false FROM e
  UNION ALL
  SELECT crawl_id, n, CASE WHEN ok THEN status ELSE alive END, CASE WHEN ok THEN us ELSE held_us END, us, status, alive, ok FROM (
    SELECT *, coalesce(alive, '') || '>' || status IN ({_LEGAL_SQL}) AS ok FROM (
      SELECT e.crawl_id, e.n, e.us, e.status, r.held_us,
        CASE WHEN e.us < r.held_us + CASE WHEN r.held = 'completed' THEN {machine.LINGER_US} ELSE {machine.LIFETIME_US} END THEN r.held END AS alive
      FROM run r JOIN e ON e.crawl_id = r.crawl_id AND e.n = r.n + 1)))
SELECT crawl_id, us AS event_us, status, from_status, legal FROM run WHERE n > 0""",
    # The stream's batch and the three others hold every event once each.
    "stream_counters": f"""SELECT domain, status, CAST(2 * count(*) AS BIGINT) AS fetches,
  CAST(2 * count(*) FILTER (WHERE response_time_ms <= 100) AS BIGINT) AS le_0_1,
  CAST(2 * count(*) FILTER (WHERE response_time_ms <= 500) AS BIGINT) AS le_0_5, CAST(2 * sum(response_time_ms) AS BIGINT) AS ms_sum,
  CAST(2 * count(response_time_ms) AS BIGINT) AS ms_count, epoch_us(min(event_at)) AS first_us, epoch_us(max(event_at)) AS last_us
FROM ({D.EVENTS_SQL}) GROUP BY domain, status""",
    "stream_dedup": f"""WITH RECURSIVE e AS (SELECT crawl_id || '-' || status AS crawl_id, epoch_us(event_at) AS us FROM ({D.EVENTS_SQL})),
kept(crawl_id, us) AS (SELECT crawl_id, min(us) FROM e GROUP BY crawl_id
  UNION ALL SELECT k.crawl_id, min(e.us) FROM kept k JOIN e ON e.crawl_id = k.crawl_id AND e.us >= k.us + 3600000000 GROUP BY k.crawl_id, k.us)
SELECT crawl_id, us AS event_us FROM kept""",
    "stream_robots": f"""WITH {_FRESH.replace(D.REQUEST_US, EVENT_US)},
c AS (SELECT fresh.*, {_TARGET} AS target, {D.AGENT} AS agent,
  CASE WHEN snapshot_us IS NOT NULL THEN ((snapshot_us - {D.T0_US}) // 600000000) % 5 END AS k
  FROM fresh JOIN pages ON request_id = page_id)
SELECT request_id, domain, {_VERDICT} AS allowed FROM c""",
    "stream_robots_fresh": f"WITH {_FRESH.replace(D.REQUEST_US, EVENT_US)} SELECT * FROM fresh",
    # One delay for all, so a lapse restarts the numbering but moves no start.
    "stream_polite": """
WITH a AS (SELECT event_type AS domain, event_id AS request_id, epoch_us(ts) AS arrival_us,
  row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS n FROM events),
s AS (SELECT *, max(arrival_us - n * 60000000) OVER (PARTITION BY domain ORDER BY n) + n * 60000000 AS start_us FROM a),
f AS (SELECT *, CASE WHEN arrival_us >= lag(start_us) OVER (PARTITION BY domain ORDER BY n) + 3600000000 THEN 1 ELSE 0 END AS lapsed FROM s),
g AS (SELECT *, sum(lapsed) OVER (PARTITION BY domain ORDER BY n) AS life FROM f)
SELECT domain, request_id, arrival_us, row_number() OVER (PARTITION BY domain, life ORDER BY n) AS request_number,
  CAST(60000000 AS BIGINT) AS delay_us, start_us FROM g""",
}
