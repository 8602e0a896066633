"""Crawl requests: defaults, validation, batches, look-up of ids by URL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill import schemas as S
from pagemill.functions import urls as U
from pagemill.plans.skew import spread_join


def with_defaults(requests: DataFrame) -> DataFrame:
    return requests.withColumns({
        "priority": F.coalesce("priority", F.lit(S.DEFAULT_PRIORITY)),
        "max_retries": F.coalesce("max_retries", F.lit(S.DEFAULT_RETRIES)),
        "crawl_delay": F.coalesce("crawl_delay", F.lit(S.DEFAULT_CRAWL_DELAY)),
        "respect_robots_txt": F.coalesce("respect_robots_txt", F.lit(True)),
    })


def request_errors(url: Column | None = None) -> Column:
    """Names of the fields that break a rule, in a fixed order; empty for a valid request."""
    rules = [
        (F.col("priority").isin(*S.PRIORITIES), "priority"),
        (F.col("max_retries").between(*S.RETRY_RANGE), "max_retries"),
        (F.col("crawl_delay").between(*S.DELAY_RANGE), "crawl_delay"),
    ]
    if url is not None:
        rules.insert(0, (U.is_http(url), "url"))
    marks = F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for ok, name in rules])
    return F.filter(marks, lambda m: m.isNotNull())


def validate_requests(requests: DataFrame) -> DataFrame:
    """Fill defaults and add ``errors``; keep both kinds, the caller splits them."""
    return with_defaults(requests).withColumn("errors", request_errors(F.col("url")))


def expand_batches(batches: DataFrame, batch_key: str = "batch_id") -> DataFrame:
    """One request row per URL of a valid batch, the batch's settings repeated, ids derived.

    A batch is refused as a whole when its size or any of its URLs is invalid.
    """
    size = F.size("urls")
    sound = (
        size.between(*S.BATCH_RANGE)
        & F.forall("urls", U.is_http)
        & (F.size(request_errors()) == 0)
    )
    rows = with_defaults(batches).filter(sound).select(
        "*", F.posexplode("urls").alias("position", "url")
    ).drop("urls")
    return rows.withColumns({
        "crawl_id": F.concat_ws("-", F.col(batch_key).cast("string"), F.col("position").cast("string")),
        "domain": U.host(F.col("url")),
        "status": F.lit("pending"),
    })


def id_by_url(queue: DataFrame) -> DataFrame:
    """URL to its crawl id; null where the URL was queued more than once."""
    return queue.groupBy("url").agg(
        F.when(F.count(F.lit(1)) == 1, F.min("crawl_id")).alias("crawl_id")
    )


def find_ids(requests: DataFrame, queue: DataFrame, request_key: str) -> DataFrame:
    return spread_join(requests, id_by_url(queue), ["url"], request_key)
