"""Continuous versions of the operators. Each function maps a stream to a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemill import schemas as S
from pagemill.operators import extract as E
from pagemill.operators.metrics import or_unknown
from pagemill.operators.queue import latest
from pagemill.operators.rollups import keep_batch
from pagemill.operators.topics import TOPIC_KEYWORDS, Dictionary
from pagemill.operators.gates import accepted, gate_responses
from pagemill.plans.pipeline import with_topics, with_verdict
from pagemill.plans.scratch import path_exists, scratch_path


def extract_stream(pages: DataFrame, *fields: str, topics: Dictionary = TOPIC_KEYWORDS) -> DataFrame:
    """Stateless: the batch expressions, topics included, on a stream of pages or of responses.

    Responses, which have a ``status_code``, pass the gates first.
    """
    if "status_code" in pages.columns:
        pages = accepted(gate_responses(pages))
    return with_topics(E.extract(pages, *fields), topics).drop("html")


def status_stream(events: DataFrame) -> DataFrame:
    """Newest status per crawl id; run in update mode."""
    return events.groupBy("crawl_id").agg(
        latest(F.col("status")).alias("status"), F.max("event_at").alias("updated_at")
    )


def metric_stream(
    events: DataFrame, *labels: str, late: str = "1 minute", window: str = S.METRIC_WINDOW
) -> DataFrame:
    """Counts per label set and window; rows later than ``late`` are dropped."""
    return (
        events.withWatermark("event_at", late)
        .groupBy(F.window("event_at", window), *[or_unknown(F.col(c)).alias(c) for c in labels])
        .agg(F.count(F.lit(1)).alias("events"))
        .select(F.col("window.start").alias("window_start"), *labels, "events")
    )


def robots_batches(requests: DataFrame, snapshots: Callable[[], DataFrame], label: str) -> DataFrame:
    """Run a stream of ``(request_id, domain, url, user_agent, event_at)`` against the robots copy valid at each event.

    ``snapshots`` is called for every micro-batch, so copies fetched meanwhile are
    seen; each batch is the same plan as a table of requests, hot domains included.
    """

    def check(batch: DataFrame) -> DataFrame:
        timed = batch.withColumn("arrival_us", F.unix_micros("event_at"))
        if "respect_robots_txt" not in timed.columns:
            timed = timed.withColumn("respect_robots_txt", F.lit(True))
        return with_verdict(timed, snapshots()).select(*batch.columns, "allowed")

    schema = T.StructType([*requests.schema.fields, T.StructField("allowed", T.BooleanType())])
    return run_batches(requests, label, check, schema, "append").drop("batch_id")


def keep_counters(fetches: DataFrame, label: str) -> str:
    """Reduce every micro-batch of a stream of fetches to its sums; the path of the kept batches."""
    path = scratch_path(fetches.sparkSession, label)
    query = (
        fetches.writeStream.option("checkpointLocation", f"{path}/state")
        .foreachBatch(lambda batch, number: keep_batch(batch, f"{path}/sums", number))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return f"{path}/sums"


def run_to_files(stream: DataFrame, label: str) -> DataFrame:
    """Run an append-mode stream over what is available and read its output back."""
    spark = stream.sparkSession
    path = scratch_path(spark, label)
    query = (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("path", f"{path}/rows")
        .option("checkpointLocation", f"{path}/state")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")


def run_batches(
    stream: DataFrame, label: str, each: Callable[[DataFrame], DataFrame], schema: T.StructType, mode: str
) -> DataFrame:
    """Run ``each`` on every micro-batch of what is available; rows of ``schema`` with their ``batch_id``."""
    spark = stream.sparkSession
    path = scratch_path(spark, label)

    def write(batch: DataFrame, batch_id: int) -> None:
        # Overwriting by batch id makes a replayed batch harmless.
        each(batch).write.mode("overwrite").parquet(f"{path}/rows/batch_id={batch_id}")

    query = (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", f"{path}/state")
        .foreachBatch(write)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    full = T.StructType([*schema.fields, T.StructField("batch_id", T.LongType())])
    if not path_exists(spark, f"{path}/rows"):
        return spark.createDataFrame([], full)
    return spark.read.schema(full).parquet(f"{path}/rows")


def run_updates(stream: DataFrame, label: str, *key: str) -> DataFrame:
    """Run an update-mode stream; each batch is a folder, the newest batch of a key holds.

    A windowed count comes out whole this way when the input ends: every window that
    changed is written by its batch, also those that the watermark has not passed.
    """
    rows = run_batches(stream, label, lambda batch: batch, stream.schema, "update")
    values = [c for c in stream.columns if c not in key]
    return rows.groupBy(*key).agg(
        F.max_by(F.struct(*values), "batch_id").alias("_row")
    ).select(*key, "_row.*")
