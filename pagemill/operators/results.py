"""Result view, listing, deletes, retention and batch totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.schemas import HISTORY_DAYS, SETTLED


def result_view(queue: DataFrame, metadata: DataFrame) -> DataFrame:
    """One result per crawl id: the stored page if there is one, else the queue row."""
    fields = [c for c in metadata.columns if c not in ("crawl_id", "url", "created_at", "updated_at")]
    pages = metadata.select(
        "crawl_id",
        F.lit(True).alias("_stored"),
        F.col("url").alias("_url"),
        F.col("created_at").alias("_created"),
        F.col("updated_at").alias("_updated"),
        F.struct("url", *fields).alias("metadata"),
    )
    rows = queue.select("crawl_id", "url", "status", "error_message", "retry_count", "created_at", "completed_at")
    stored = F.coalesce("_stored", F.lit(False))
    return rows.join(pages, "crawl_id", "full_outer").select(
        "crawl_id",
        F.when(stored, F.col("_url")).otherwise(F.col("url")).alias("url"),
        F.when(stored, "completed").otherwise(F.col("status")).alias("status"),
        "metadata",
        F.when(~stored, F.col("error_message")).alias("error_message"),
        F.when(stored, 0).otherwise(F.col("retry_count")).alias("retry_count"),
        F.when(stored, F.col("_created")).otherwise(F.col("created_at")).alias("created_at"),
        F.when(stored, F.col("_updated")).otherwise(F.col("completed_at")).alias("completed_at"),
    )


def by_id(queue: DataFrame, metadata: DataFrame, crawl_id: str) -> DataFrame:
    """The result of one id; both sides are filtered before they meet."""
    wanted = F.col("crawl_id") == crawl_id
    return result_view(queue.filter(wanted), metadata.filter(wanted))


def listing(
    queue: DataFrame,
    metadata: DataFrame,
    limit: int = 10,
    offset: int = 0,
    domain: str | None = None,
    status: str | None = None,
) -> DataFrame:
    """A page of the result view, newest first, ties by id.

    The page is chosen from ids, times and statuses alone; wide columns are read
    for its ``limit`` ids only. Filters stand at the scans. A domain lists stored pages.
    """
    if domain is not None:
        metadata = metadata.filter(F.col("domain") == domain)
    pages = metadata.select("crawl_id", "created_at")
    waiting = queue.select("crawl_id", "created_at", "status")
    if status is not None:
        waiting = waiting.filter(F.col("status") == status)
    # A stored page stands for its queue row, whatever that says.
    waiting = waiting.drop("status").join(metadata.select("crawl_id"), "crawl_id", "left_anti")
    if domain is not None:
        keys = pages if status in (None, "completed") else pages.limit(0)
    elif status in (None, "completed"):
        keys = pages.unionByName(waiting)
    else:
        keys = waiting
    top = keys.orderBy(F.desc("created_at"), "crawl_id").offset(offset).limit(limit).select("crawl_id")
    ids = F.broadcast(top)  # at most ``limit`` rows
    view = result_view(queue.join(ids, "crawl_id", "left_semi"), metadata.join(ids, "crawl_id", "left_semi"))
    return view.orderBy(F.desc("created_at"), "crawl_id")


def list_results(
    results: DataFrame,
    limit: int = 10,
    offset: int = 0,
    domain: str | None = None,
    status: str | None = None,
    domain_column: Column | None = None,
) -> DataFrame:
    """A page of rows that are already results, newest first, ties by id. ``listing`` serves queue and store."""
    if domain is not None:
        results = results.filter((F.col("domain") if domain_column is None else domain_column) == domain)
    if status is not None:
        results = results.filter(F.col("status") == status)
    return results.orderBy(F.desc("created_at"), "crawl_id").offset(offset).limit(limit)


def without_deleted(stored: DataFrame, deleted_keys: DataFrame, key: str = "crawl_id") -> DataFrame:
    return stored.join(deleted_keys.select(key), key, "left_anti")


def expired(as_of: Column, days: int = HISTORY_DAYS, at: str = "crawl_timestamp") -> Column:
    """Settled history older than ``days``; other statuses are kept for good."""
    return F.coalesce(
        (F.col(at) < as_of - F.make_dt_interval(F.lit(days)))
        & F.col("status").isin(*SETTLED),
        F.lit(False),
    )


def retained_history(history: DataFrame, as_of: Column, days: int = HISTORY_DAYS) -> DataFrame:
    return history.filter(~expired(as_of, days))


def retention_count(history: DataFrame, as_of: Column, days: int = HISTORY_DAYS) -> DataFrame:
    return history.agg(F.count_if(expired(as_of, days)).alias("deleted_count"))


def batch_totals(members: DataFrame, states: DataFrame) -> DataFrame:
    """Totals and success rate per batch from its members' current states."""
    done = F.col("status") == "completed"
    return (
        members.join(states.select("crawl_id", "status"), "crawl_id", "left")
        .groupBy("batch_id")
        .agg(
            F.count(F.lit(1)).alias("total_urls"),
            F.count_if(done).alias("completed_urls"),
            F.count_if(F.col("status") == "failed").alias("failed_urls"),
        )
        .withColumn(
            "success_rate",
            F.coalesce(F.try_divide(F.col("completed_urls"), F.col("total_urls")), F.lit(0.0)),
        )
    )
