"""Counter, histogram and summary queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.catalog import stand_ins as D
from pagemill.catalog import topics as TC
from pagemill.functions import urls as U
from pagemill.operators import extract as E
from pagemill.operators import metrics as M
from pagemill.plans.pipeline import with_topics


def requests_by_label(spark: SparkSession, folder: str) -> DataFrame:
    log = D.events(spark, folder)
    domain = F.when(F.col("event_id") % 10 > 0, F.col("domain"))
    method = F.when(F.col("event_id") % 2 == 0, "single").otherwise("batch")
    return M.requests_total(log.withColumn("domain", domain), method)


def pages_by_label(spark: SparkSession, folder: str) -> DataFrame:
    pages = D.responses(spark, folder).withColumn("domain", U.host(F.col("url")))
    return M.pages_crawled(pages)


def errors_by_label(spark: SparkSession, folder: str) -> DataFrame:
    failed = D.events(spark, folder).filter(F.col("error_message").isNotNull())
    return M.errors_total(failed.withColumn("error_type", F.col("error_message")))


def _rounded(histogram: DataFrame) -> DataFrame:
    return histogram.withColumn("value_sum", D.r6("value_sum"))


def hist_response(spark: SparkSession, folder: str) -> DataFrame:
    pages = D.responses(spark, folder).withColumn("domain", U.host(F.col("url")))
    return _rounded(M.response_time_histogram(pages))


def hist_duration(spark: SparkSession, folder: str) -> DataFrame:
    log = D.events(spark, folder)
    return _rounded(M.request_duration_histogram(log.withColumn("duration_s", F.col("response_time_ms") / 1000)))


def hist_size(spark: SparkSession, folder: str) -> DataFrame:
    pages = D.responses(spark, folder).select(
        U.host(F.col("url")).alias("domain"),
        M.or_unknown(F.expr(D.CONTENT_TYPE)).alias("content_type"),
        "html",
    )
    return M.content_size_histogram(pages)


def corpus_summary(spark: SparkSession, folder: str) -> DataFrame:
    fields = ("domain", "title", "description", "keywords", "word_count", "images", "links", "body_text")
    pages = E.extract(D.pages(spark, folder), *fields).withColumn("response_time_ms", F.expr(D.RESPONSE_MS))
    total = M.corpus_summary(with_topics(pages, TC.SAMPLE_TOPICS))
    return total.withColumns({
        "mean_response_ms": D.r6("mean_response_ms"),
        "topic_names": F.array_join("topic_names", "|"),
    })


QUERIES = {
    f.__name__: f
    for f in (
        requests_by_label, pages_by_label, errors_by_label, hist_response, hist_duration, hist_size, corpus_summary,
    )
}

# --- expected results ---------------------------------------------------------------------------

_HOST = "regexp_extract(url, '^https?://([^/?#]*)', 1)"
_UEVENT = f"({D.EVENTS_SQL})"


def histogram_sql(labels: str, value: str, source: str, bounds, total: str) -> str:
    buckets = ", ".join(
        f"count(*) FILTER (WHERE {value} <= {b}) AS {M.bucket_label(b)}" for b in bounds
    )
    return f"SELECT {labels}, {buckets}, {total} AS value_sum, count({value}) AS value_count FROM {source} GROUP BY ALL"


SQL = {
    "requests_by_label": f"""SELECT status, CASE WHEN event_id % 10 > 0 THEN domain ELSE 'unknown' END AS domain,
CASE WHEN event_id % 2 = 0 THEN 'single' ELSE 'batch' END AS method, count(*) AS requests FROM {_UEVENT} GROUP BY ALL""",
    "pages_by_label": f"SELECT {_HOST} AS domain, CAST({D.STATUS_CODE} AS VARCHAR) AS status_code, count(*) AS pages FROM pages GROUP BY ALL",
    "errors_by_label": f"SELECT error_message AS error_type, domain, count(*) AS errors FROM {_UEVENT} WHERE error_message IS NOT NULL GROUP BY ALL",
    "hist_response": histogram_sql(
        "domain", "v", f"(SELECT {_HOST} AS domain, {D.RESPONSE_MS} / 1000 AS v FROM pages)", M.SECONDS_BUCKETS, "round(sum(v), 6)"
    ),
    "hist_duration": histogram_sql(
        "domain, status", "v", f"(SELECT domain, status, response_time_ms / 1000 AS v FROM {_UEVENT})", M.SECONDS_BUCKETS, "round(sum(v), 6)"
    ),
    "hist_size": histogram_sql(
        "domain, content_type", "v",
        f"(SELECT {_HOST} AS domain, coalesce({D.CONTENT_TYPE}, 'unknown') AS content_type, octet_length(encode(html)) AS v FROM pages)",
        M.BYTES_BUCKETS, "CAST(sum(v) AS BIGINT)"
    ),
}


def _summary_sql() -> str:
    from pagemill.catalog.pages import SQL as PAGES

    return f"""
WITH {TC.hits_sql(TC._PAGES, 'page_id', TC.SAMPLE_TOPICS)},
core AS ({PAGES['page_core']}), links AS ({PAGES['page_link_counts']})
SELECT count(*) AS pages, count(DISTINCT core.domain) AS domains, CAST(sum(word_count) AS BIGINT) AS words,
  round(avg({D.RESPONSE_MS.replace('page_id', 'core.page_id')}), 6) AS mean_response_ms, CAST(0 AS BIGINT) AS images, CAST(sum(n_links) AS BIGINT) AS links,
  (SELECT count(*) FROM chosen) AS topics, (SELECT string_agg(DISTINCT topic, '|' ORDER BY topic) FROM chosen) AS topic_names,
  (SELECT CAST(count(DISTINCT topic) AS INT) FROM chosen) AS distinct_topics
FROM core JOIN links USING (page_id)"""


SQL["corpus_summary"] = _summary_sql()
