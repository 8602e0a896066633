"""Politeness: when each request may start, given one delay per domain.

``start(n) = max(arrival(n), start(n-1) + delay)`` unrolls to
``n * delay + max over i <= n of (arrival(i) - i * delay)``, a running maximum
that splits into chunks, so a dominant domain does not end up in one task.
Times are whole microseconds, so results are exact.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.plans import ordered as O
from pagemill.schemas import DEFAULT_CRAWL_DELAY

ORDER = ["arrival_us", "request_id"]


def effective_delay(requests: DataFrame, settings: DataFrame | None = None) -> DataFrame:
    """Delay per domain: the stored one, else that of its first request, else the default."""
    first = requests.groupBy("domain").agg(
        F.min_by("crawl_delay", F.struct(*ORDER)).alias("asked")
    )
    if settings is None:
        return first.select("domain", F.coalesce("asked", F.lit(DEFAULT_CRAWL_DELAY)).alias("crawl_delay"))
    return first.join(settings.select("domain", F.col("crawl_delay").alias("stored")), "domain", "left").select(
        "domain", F.coalesce("stored", "asked", F.lit(DEFAULT_CRAWL_DELAY)).alias("crawl_delay")
    )


def polite_schedule(
    requests: DataFrame, settings: DataFrame | None = None, chunks: int | None = None
) -> DataFrame:
    """Schedule ``(request_id, domain, arrival_us, crawl_delay)`` rows.

    Adds ``request_number`` (from 1), ``delay_us``, ``start_us`` and ``wait_us``.
    No expiry of a domain's entry is modelled; the streaming job does that.
    """
    key = "domain"
    cut = O.into_chunks(requests.select("request_id", key, "arrival_us", "crawl_delay"), key, ORDER, chunks)
    sizes = cut.groupBy(key, O.CHUNK).agg(
        F.count(F.lit(1)).alias("_rows"),
        F.min_by("crawl_delay", F.struct(*ORDER)).alias("_asked"),
    )
    earlier = O.earlier_chunks(key)
    begun = O.carry(
        sizes, key,
        _offset=F.sum("_rows").over(earlier),
        _first=F.first("_asked").over(earlier),
    )
    numbered = O.attach(
        cut.withColumn("_n", F.count(F.lit(1)).over(O.within(key, ORDER)) - 1)
        .withColumn("_here", F.first("crawl_delay").over(O.within(key, ORDER))),
        begun, key,
    ).withColumn("_asked", F.when(F.col("_offset").isNotNull(), F.col("_first")).otherwise(F.col("_here")))
    if settings is not None:
        stored = settings.select(key, F.col("crawl_delay").alias("_stored"))
        touched = sizes.select(key, O.CHUNK).join(stored, key)
        # One row per chunk of a domain, so a large domain is no heavier here than its chunks.
        numbered = numbered.join(touched, [key, O.CHUNK], "left")
    else:
        numbered = numbered.withColumn("_stored", F.lit(None).cast("double"))
    delay = F.coalesce("_stored", "_asked", F.lit(DEFAULT_CRAWL_DELAY))
    timed = numbered.select(
        "request_id", key, "arrival_us", O.CHUNK,
        (F.col("_n") + F.coalesce("_offset", F.lit(0))).alias("_n"),
        F.round(delay * 1_000_000).cast("long").alias("delay_us"),
    ).withColumn("_slack", F.col("arrival_us") - F.col("_n") * F.col("delay_us"))
    tops = timed.groupBy(key, O.CHUNK).agg(F.max("_slack").alias("_top"))
    reached = O.carry(tops, key, _before=F.max("_top").over(earlier))
    local = timed.withColumn("_here", F.max("_slack").over(O.within(key, ORDER)))
    start = F.greatest("_here", "_before") + F.col("_n") * F.col("delay_us")
    return O.attach(local, reached, key).select(
        "request_id", key, "arrival_us", "delay_us",
        (F.col("_n") + 1).alias("request_number"),
        start.alias("start_us"),
        (start - F.col("arrival_us")).alias("wait_us"),
    )


def domain_stats(schedule: DataFrame) -> DataFrame:
    """Requests, last start and delay of every domain."""
    return schedule.groupBy("domain").agg(
        F.count(F.lit(1)).alias("request_count"),
        F.max("start_us").alias("last_start_us"),
        F.max("delay_us").alias("delay_us"),
    )


def rate_limit_waits(schedule: DataFrame) -> DataFrame:
    return schedule.groupBy("domain").agg(F.count_if(F.col("wait_us") > 0).alias("waits"))


def rate_limited(stats: DataFrame, as_of_us: int) -> DataFrame:
    """Whether a request at ``as_of_us`` would still have to wait."""
    return stats.withColumn(
        "is_limited", F.lit(as_of_us) - F.col("last_start_us") < F.col("delay_us")
    )
