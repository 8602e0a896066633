"""Robots queries over snapshots derived from every page."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.catalog import stand_ins as D
from pagemill.operators import robots as R
from pagemill.plans import pipeline
from pagemill.sources.tables import read_table


def robots_rules(spark: SparkSession, folder: str) -> DataFrame:
    return R.robots_rules(D.snapshots(spark, folder), "page_id").select(
        "page_id", "line", F.col("group_id").cast("int").alias("group_id"), "kind", "value"
    )


def _newest_files(spark: SparkSession, folder: str) -> DataFrame:
    return R.robots_files(R.latest_snapshots(D.snapshots(spark, folder)), "domain")


def _checked(spark: SparkSession, folder: str) -> DataFrame:
    return R.check_requests(
        D.robots_requests(spark, folder), _newest_files(spark, folder), ["domain"], "request_id"
    )


def robots_allow(spark: SparkSession, folder: str) -> DataFrame:
    return _checked(spark, folder).select("request_id", "domain", "allowed")


def robots_delay(spark: SparkSession, folder: str) -> DataFrame:
    return _checked(spark, folder).select("request_id", "robots_delay")


def robots_sitemaps(spark: SparkSession, folder: str) -> DataFrame:
    return _checked(spark, folder).select("request_id", F.array_join("sitemaps", "|").alias("sitemaps"))


def robots_checks(spark: SparkSession, folder: str) -> DataFrame:
    return R.robots_checks(_checked(spark, folder))


def robots_fresh(spark: SparkSession, folder: str) -> DataFrame:
    return R.fresh_snapshot(D.robots_requests(spark, folder), D.snapshots(spark, folder))


def crawl_plan(spark: SparkSession, folder: str) -> DataFrame:
    """Requests to a plan: validated, checked against the fresh copy, spaced per domain."""
    pages = read_table(spark, folder, "pages")
    requests = D.robots_requests(spark, folder).drop("domain").join(
        pages.select(
            F.col("page_id").alias("request_id"),
            F.expr("CAST(CASE WHEN page_id % 9 = 0 THEN 7 ELSE 5 END AS INT)").alias("priority"),
            F.lit(3).alias("max_retries"),
            F.lit(60.0).alias("crawl_delay"),
        ),
        "request_id",
    )
    return pipeline.crawl_plan(requests, D.snapshots(spark, folder)).select(
        "request_id", "domain", "allowed", "request_number", "start_us", "wait_us", "error_message"
    )


QUERIES = {
    f.__name__: f
    for f in (
        robots_rules, robots_allow, robots_delay, robots_sitemaps, robots_checks, robots_fresh, crawl_plan,
    )
}

# --- expected results ---------------------------------------------------------------------------

_DOMAIN = "lower(regexp_extract(url, '^https?://([^/?#]*)', 1))"
_TARGET = "regexp_extract(url, '^https?://[^/?#]*(.*)$', 1)"
# Verdict of snapshot kind k (its id modulo five) on a target, by agent.
_VERDICT = """CASE k WHEN 0 THEN NOT starts_with(target, '/fr/')
  WHEN 1 THEN agent LIKE 'LensBot%' AND NOT starts_with(target, '/en/')
  WHEN 2 THEN true WHEN 3 THEN true
  WHEN 4 THEN NOT (starts_with(target, '/de/') OR (starts_with(target, '/es/') AND NOT starts_with(target, '/es/1')))
  ELSE true END"""
_REQUESTS = f"""
q AS (SELECT page_id AS request_id, page_id, {_DOMAIN} AS domain, {_TARGET} AS target, {D.AGENT} AS agent,
  page_id % 11 <> 0 AS obeys, {D.REQUEST_US} AS arrival_us FROM pages),
newest AS (SELECT {_DOMAIN} AS domain, max(page_id) AS file_id, max(page_id) % 5 AS k FROM pages GROUP BY 1),
c AS (SELECT q.*, n.file_id, n.k, NOT obeys OR {_VERDICT} AS allowed FROM q JOIN newest n USING (domain))"""
_FRESH = f"""
f AS (SELECT q.request_id, q.domain, q.arrival_us, max({D.SNAPSHOT_US.replace('page_id', 's.page_id')}) AS latest_us
  FROM (SELECT page_id AS request_id, {_DOMAIN} AS domain, {D.REQUEST_US} AS arrival_us FROM pages) q
  LEFT JOIN (SELECT page_id, {_DOMAIN} AS domain FROM pages) s
    ON q.domain = s.domain AND {D.SNAPSHOT_US.replace('page_id', 's.page_id')} <= q.arrival_us GROUP BY ALL),
fresh AS (SELECT request_id, domain, arrival_us,
  CASE WHEN arrival_us < latest_us + 86400000000 THEN latest_us END AS snapshot_us FROM f)"""

SQL = {
    "robots_rules": f"""
WITH s AS (SELECT page_id, {D.ROBOTS_TEXT} AS content FROM pages),
l AS (SELECT page_id, generate_subscripts(ls, 1) - 1 AS line, unnest(ls) AS raw
  FROM (SELECT page_id, string_split(content, chr(10)) AS ls FROM s)),
k AS (SELECT page_id, line, trim(raw, ' ' || chr(13)) AS raw,
  lower(split_part(trim(raw, ' ' || chr(13)), ':', 1)) AS kind FROM l),
v AS (SELECT page_id, line, kind, trim(regexp_replace(regexp_replace(raw, '#.*', ''), '^[^:]*:', '')) AS value,
  lag(kind) OVER (PARTITION BY page_id ORDER BY line) AS before FROM k WHERE raw NOT LIKE '#%'),
g AS (SELECT *, sum(CASE WHEN kind = 'user-agent' AND before IS DISTINCT FROM 'user-agent' THEN 1 ELSE 0 END)
  OVER (PARTITION BY page_id ORDER BY line) AS grp FROM v)
SELECT page_id, CAST(line AS INT) AS line, CASE WHEN kind <> 'sitemap' THEN CAST(grp AS INT) END AS group_id, kind, value
FROM g WHERE kind <> ''""",
    "robots_allow": f"WITH {_REQUESTS} SELECT request_id, domain, allowed FROM c",
    "robots_delay": f"""WITH {_REQUESTS}
SELECT request_id, CAST(CASE WHEN k = 0 THEN 5 WHEN k = 1 AND agent LIKE 'LensBot%' THEN 2 END AS DOUBLE) AS robots_delay FROM c""",
    "robots_sitemaps": f"""WITH {_REQUESTS}
SELECT request_id, CASE k WHEN 0 THEN 'http://maps.example/s' || CAST(file_id AS VARCHAR) || '.xml'
  WHEN 2 THEN 'http://x.example/a.xml|http://x.example/b:c.xml' ELSE '' END AS sitemaps FROM c""",
    "robots_checks": f"WITH {_REQUESTS} SELECT domain, allowed, count(*) AS checks FROM c GROUP BY domain, allowed",
    "robots_fresh": f"WITH {_FRESH} SELECT * FROM fresh",
    "crawl_plan": f"""WITH {_FRESH},
c AS (SELECT fresh.*, {_TARGET} AS target, {D.AGENT} AS agent,
  CASE WHEN snapshot_us IS NOT NULL THEN ((snapshot_us - {D.T0_US}) // 600000000) % 5 END AS k, page_id % 11 <> 0 AS obeys
  FROM fresh JOIN pages ON request_id = page_id WHERE page_id % 9 <> 0),
a AS (SELECT *, NOT obeys OR {_VERDICT} AS allowed FROM c),
n AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY arrival_us, request_id) - 1 AS n FROM a WHERE allowed),
t AS (SELECT request_id, n + 1 AS request_number,
  max(arrival_us - n * 60000000) OVER (PARTITION BY domain ORDER BY n) + n * 60000000 AS start_us FROM n)
SELECT a.request_id, domain, allowed, request_number, start_us, start_us - arrival_us AS wait_us,
  CASE WHEN NOT allowed THEN 'Blocked by robots.txt' END AS error_message
FROM a LEFT JOIN t USING (request_id)""",
}
