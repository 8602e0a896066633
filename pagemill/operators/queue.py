"""Queue state: current status, timings, what to run next, what to try again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.schemas import SETTLED

# Which of two events at the same instant is the later one.
STATUS_RANK = {"pending": 0, "retry": 1, "processing": 2, "failed": 3, "completed": 4}


def status_rank(status: Column) -> Column:
    return F.coalesce(
        *[F.when(status == name, F.lit(rank)) for name, rank in STATUS_RANK.items()], F.lit(-1)
    )


def latest(value: Column) -> Column:
    """Aggregate: ``value`` of the newest status event, same instants broken by status rank."""
    return F.max_by(value, F.struct("event_at", status_rank(F.col("status")), "status"))


def current_status(events: DataFrame) -> DataFrame:
    """State per crawl id from its append-only ``(crawl_id, status, event_at, error_message)`` log.

    One map-side-combined aggregate. An error message stays until a later one replaces it.
    """
    at = F.col("event_at")
    return events.groupBy("crawl_id").agg(
        latest(F.col("status")).alias("status"),
        F.max_by("error_message", F.when(F.col("error_message").isNotNull(), at)).alias("error_message"),
        F.max(at).alias("updated_at"),
        F.max(F.when(F.col("status") == "processing", at)).alias("processing_started_at"),
        F.max(F.when(F.col("status").isin(*SETTLED), at)).alias("completed_at"),
        F.count_if(F.col("status") == "retry").alias("retry_count"),
    )


def queue_timings(queue: DataFrame) -> DataFrame:
    """Microseconds spent waiting and running."""

    def between(start: str, end: str) -> Column:
        return F.timestamp_diff("MICROSECOND", F.col(start), F.col(end))

    return queue.withColumns({
        "wait_us": between("scheduled_at", "processing_started_at"),
        "run_us": between("processing_started_at", "completed_at"),
    })


def next_due(queue: DataFrame, limit: int, per_domain: int | None = None) -> DataFrame:
    """Pending requests by priority, then schedule time; optionally at most n per domain.

    Both cuts are top-k: rows beyond them are dropped before the shuffle.
    """
    order = [F.desc("priority"), F.asc("scheduled_at"), F.asc("crawl_id")]
    due = queue.filter(F.col("status") == "pending")
    if per_domain is not None:
        place = F.row_number().over(Window.partitionBy("domain").orderBy(*order))
        due = due.withColumn("_place", place).filter(F.col("_place") <= per_domain).drop("_place")
    return due.orderBy(*order).limit(limit)


def retry_candidates(queue: DataFrame) -> DataFrame:
    """Failed requests with tries left, as the retry events to append."""
    return queue.filter(
        (F.col("status") == "failed") & (F.col("retry_count") < F.col("max_retries"))
    ).withColumns({"status": F.lit("retry"), "retry_count": F.col("retry_count") + 1})


def queue_depth(queue: DataFrame) -> DataFrame:
    return queue.agg(
        F.count_if(F.col("status") == "pending").alias("queued"),
        F.count_if(F.col("status") == "processing").alias("active"),
    )
