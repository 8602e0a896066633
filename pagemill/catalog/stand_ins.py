"""Stand-ins for tables the sample data lacks, derived from whole sample tables.

The derivations are SQL expressions that Spark and the checking engine both
read, so both sides start from the same rows; the results are then stated
independently.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.functions import urls as U
from pagemill.sources.tables import read_table

T0_US = 1_704_067_200_000_000

_ID = "CAST(page_id AS STRING)"
_Q = "chr(39)"
_NL = "chr(10)"

STATUS_CODE = "CAST(CASE WHEN page_id % 10 = 3 THEN 404 WHEN page_id % 10 = 7 THEN 500 ELSE 200 END AS INT)"
CONTENT_TYPE = (
    "CASE page_id % 8 WHEN 0 THEN 'application/pdf' WHEN 1 THEN 'TEXT/HTML' WHEN 2 THEN NULL "
    "ELSE 'text/html; charset=utf-8' END"
)
RESPONSE_MS = "CAST(100 + (page_id * 37) % 900 AS INT)"

HEAD_EXTRA = f"""
CASE page_id % 4
  WHEN 0 THEN '<meta name="description" content="About &amp; more ' || {_ID} || '">'
  WHEN 1 THEN '<meta content=' || {_Q} || 'Shared &quot;text&quot;   ' || {_ID} || {_Q} || ' property="og:description">'
  WHEN 2 THEN '<META NAME=description CONTENT=""><meta name="twitter:description" content="  tw  ' || {_ID} || ' ">'
  ELSE '' END
|| '<meta name="keywords" content="k' || CAST(page_id % 7 AS STRING) || ', alpha; beta,k' || CAST(page_id % 7 AS STRING)
|| ',,gamma "><meta property="article:tag" content="tag' || CAST(page_id % 5 AS STRING) || '">'
|| CASE page_id % 5
  WHEN 0 THEN '<meta name="author" content="Ann ' || {_ID} || '">'
  WHEN 1 THEN '<meta property="article:author" content="Bo &eacute;&#233; ' || {_ID} || '">'
  WHEN 2 THEN '<meta name="author" content=" "><meta name="twitter:creator" content="@c' || {_ID} || '">'
  ELSE '' END
|| CASE page_id % 3
  WHEN 0 THEN '<meta property="article:published_time" content="2024-01-' || lpad(CAST(1 + page_id % 28 AS STRING), 2, '0') || 'T10:00:00+02:00">'
  WHEN 1 THEN '<meta property=article:published_time content="soon"><meta name="date" content="January ' || CAST(1 + page_id % 28 AS STRING) || ', 2024">'
  ELSE '' END
|| CASE page_id % 3
  WHEN 0 THEN '<link rel="alternate canonical" href="../c/' || {_ID} || '?x=1">'
  WHEN 1 THEN '<meta property="og:url" content="http://raw.example/' || {_ID} || '">'
  ELSE '' END
|| CASE WHEN page_id % 12 = 11 THEN '<meta property="og:title" content="Shared title ' || {_ID} || '">' ELSE '' END
"""

BODY_EXTRA = f"""
'<img src="/i/' || {_ID} || '.png" alt="Pic ' || {_ID} || '" width="640" height=480><img src=' || {_Q}
|| 'data:image/png;base64,AA' || {_Q} || '><img width=49 height=500 src="/s.png">'
|| '<img src="../up.png" title=" T " width="50px"><IMG SRC="//cdn.example.com/x.jpg" alt="">'
|| repeat('<img src="r.png">', CAST(page_id % 10 * 7 AS INT))
|| '<a rel="tag" href="/t/' || CAST(page_id % 5 AS STRING) || '"> tag <b>text ' || {_ID} || '</b></a>'
|| '<a href="./a?q=1#f" title="a > b">x</a><a href="?z=2" rel="nofollow noopener">q</a><a href="mailto:a@b.c">m</a>'
|| '<a href="#top">t</a><a href="">e</a><a href="https://other.example/p"><i> in </i></a><a href="javascript:go()">j</a>'
|| CASE WHEN page_id % 5 = 3 THEN '<a rel="author" href="/u"> Jane <b>Doe</b> </a>' ELSE '' END
|| CASE WHEN page_id % 3 = 2 THEN '<time datetime="2024-02-0' || CAST(1 + page_id % 9 AS STRING) || '">x</time>' ELSE '' END
|| repeat('<a href="/n">n</a>', CAST(page_id % 4 * 40 AS INT))
"""

_UNTITLED = """
CASE WHEN page_id % 12 = 11 THEN regexp_replace(regexp_replace(html, '<title>[^<]*</title>', ''), '<h1>[^<]*</h1>', '')
     WHEN page_id % 6 = 5 THEN regexp_replace(html, '<title>[^<]*</title>', '') ELSE html END
"""

RICH_HTML = f"""
replace(replace({_UNTITLED}, '</head>', {HEAD_EXTRA} || '</head>'), '<article>', '<article>' || {BODY_EXTRA})
"""

ROBOTS_TEXT = f"""
CASE page_id % 5
  WHEN 0 THEN 'User-agent: *' || {_NL} || 'Disallow: /fr/' || {_NL} || 'Allow: /' || {_NL} || 'Crawl-delay: 5' || {_NL}
    || 'Sitemap: http://maps.example/s' || {_ID} || '.xml'
  WHEN 1 THEN '# comment' || {_NL} || 'User-Agent: LensBot' || {_NL} || 'User-agent: other' || {_NL} || 'Disallow: /en/' || {_NL}
    || 'Crawl-delay: 2' || {_NL} || {_NL} || 'User-agent: *' || {_NL} || 'Disallow: /'
  WHEN 2 THEN 'User-agent: *' || {_NL} || 'Disallow:' || {_NL} || 'Sitemap: http://x.example/a.xml' || {_NL}
    || 'Sitemap: http://x.example/b:c.xml'
  WHEN 3 THEN 'User-agent: *' || {_NL} || 'Disallow: /'
  ELSE 'User-agent: *' || chr(13) || {_NL} || 'Allow: /es/1' || chr(13) || {_NL} || 'Disallow: /es/ # no' || chr(13) || {_NL}
    || 'Disallow: /de/' END
"""
ROBOTS_STATUS = "CAST(CASE WHEN page_id % 5 = 3 THEN 404 ELSE 200 END AS INT)"
AGENT = "CASE WHEN page_id % 2 = 0 THEN 'LensBot/1.0' ELSE 'Reader/2.0' END"
SNAPSHOT_US = f"({T0_US} + page_id * 600000000)"
REQUEST_US = f"({T0_US} + page_id * 420000000)"

QUEUE_COLUMNS = {
    "crawl_id": "CAST(o_orderkey AS STRING)",
    "url": "'http://d' || CAST(o_custkey % 50 AS STRING) || '.example/' || CAST(o_orderkey AS STRING)",
    "domain": "'d' || CAST(o_custkey % 50 AS STRING) || '.example'",
    "priority": "CAST(CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 10 "
    "WHEN o_orderpriority = '3-MEDIUM' THEN 5 ELSE 1 END AS INT)",
    "status": "CASE WHEN o_orderstatus = 'O' THEN 'pending' WHEN o_orderstatus = 'F' THEN 'failed' "
    "WHEN o_orderkey % 3 = 0 THEN 'processing' ELSE 'completed' END",
    "error_message": "CASE WHEN o_orderstatus = 'F' THEN 'Failed to crawl URL' END",
    "retry_count": "CAST(o_orderkey % 5 AS INT)",
    "max_retries": "CAST(3 AS INT)",
    "scheduled_at": "o_orderdate",
    "created_at": "o_orderdate",
    "completed_at": "CASE WHEN o_orderstatus <> 'O' THEN o_orderdate + INTERVAL '1' DAY END",
}

STATUS_OF_EVENT = (
    "CASE event_type WHEN 'view' THEN 'pending' WHEN 'click' THEN 'processing' "
    "WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'retry' END"
)
EVENT_COLUMNS = {
    "event_id": "event_id",
    "crawl_id": "CAST(user_id AS STRING)",
    "domain": "'u' || CAST(user_id % 20 AS STRING) || '.example'",
    "status": STATUS_OF_EVENT,
    "event_at": "ts",
    "error_message": "CASE WHEN event_type = 'error' THEN 'e' || CAST(event_id % 7 AS STRING) END",
    "response_time_ms": "CAST(round(value * 10) AS INT)",
    "status_code": "CAST(CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS INT)",
}


def select_sql(columns: dict[str, str], table: str) -> str:
    return "SELECT " + ", ".join(f"{sql} AS {name}" for name, sql in columns.items()) + f" FROM {table}"


QUEUE_SQL = select_sql(QUEUE_COLUMNS, "orders")
EVENTS_SQL = select_sql(EVENT_COLUMNS, "events")


def pages(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "pages")


def rich_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Sample pages with metadata tags, images and links written into their HTML."""
    return pages(spark, folder).withColumn("html", F.expr(RICH_HTML))


def responses(spark: SparkSession, folder: str, rich: bool = False) -> DataFrame:
    source = rich_pages(spark, folder) if rich else pages(spark, folder)
    return source.select(
        "page_id",
        F.col("page_id").cast("string").alias("crawl_id"),
        "url",
        "html",
        F.expr(STATUS_CODE).alias("status_code"),
        F.map_filter(
            F.create_map(F.lit("Content-Type"), F.expr(CONTENT_TYPE)), lambda _, v: v.isNotNull()
        ).alias("response_headers"),
        F.expr(RESPONSE_MS).alias("response_time_ms"),
        F.timestamp_micros(F.lit(T0_US) + F.col("page_id") * 60_000_000).alias("fetched_at"),
    )


def snapshots(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "pages").select(
        "page_id",
        U.netloc_key(F.col("url")).alias("domain"),
        F.expr(SNAPSHOT_US).alias("fetched_us"),
        F.timestamp_micros(F.expr(SNAPSHOT_US)).alias("fetched_at"),
        F.expr(ROBOTS_STATUS).alias("http_status"),
        F.expr(ROBOTS_TEXT).alias("content"),
    )


def robots_requests(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "pages").select(
        F.col("page_id").alias("request_id"),
        "url",
        U.netloc_key(F.col("url")).alias("domain"),
        F.expr(AGENT).alias("user_agent"),
        F.expr("page_id % 11 <> 0").alias("respect_robots_txt"),
        F.expr(REQUEST_US).alias("arrival_us"),
    )


def queue(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "orders").select(
        *[F.expr(sql).alias(name) for name, sql in QUEUE_COLUMNS.items()]
    )


def events(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "events").select(
        *[F.expr(sql).alias(name) for name, sql in EVENT_COLUMNS.items()]
    )


def r6(value: Column) -> Column:
    return F.round(value, 6)
