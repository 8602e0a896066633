"""Append-only stores for metadata, status events and history, partitioned by date.

Nothing is updated in place: status is the newest event, and a deleted result is
a key in the ``deleted`` folder until ``compact`` writes a generation without it.

A write of few dates has a folder per date. A write of many dates has folders of
several days beside these, in which the date is a column that files are sorted by, so
the number of folders follows the rows (``spans``). Readers see both alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemill import schemas as S
from pagemill.operators.queue import current_status
from pagemill.operators.results import HISTORY_DAYS, expired, retention_count, without_deleted
from pagemill.plans.scratch import path_exists
from pagemill.sources import spans

PARTITION = "on_date"
SPAN = "from_date"
STATUS_EVENT = T.StructType([
    T.StructField("crawl_id", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("event_at", T.TimestampType()),
    T.StructField("error_message", T.StringType()),
])


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Columns of ``schema`` in its order and types; missing ones are null."""
    have = set(df.columns)
    return df.select(*[
        (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in schema.fields
    ])


def _write(dated: DataFrame, path: str, mode: str = "append") -> None:
    """Write rows that have their date. Rebalancing by folder keeps files large and splits a dominant date."""
    days = spans.days_of(dated, PARTITION)
    if days == 1:
        dated.hint("rebalance", PARTITION).write.mode(mode).partitionBy(PARTITION).parquet(path)
        return
    spanned = dated.withColumn(SPAN, spans.span_start(PARTITION, days)).hint("rebalance", SPAN)
    spanned.sortWithinPartitions(SPAN, PARTITION).write.mode(mode).partitionBy(SPAN).parquet(_spanned(path))


def _spanned(path: str) -> str:
    return f"{path}_spans"


def _write_new(dated: DataFrame, path: str) -> None:
    spark = dated.sparkSession
    if path_exists(spark, path) or path_exists(spark, _spanned(path)):
        raise ValueError(f"{path} has been written before")
    _write(dated, path, "errorifexists")


def _append(df: DataFrame, path: str, at: str) -> None:
    _write(df.withColumn(PARTITION, F.to_date(at)), path)


def append_metadata(pages: DataFrame, store: str) -> None:
    """Pages that don't say when they were stored count as stored when they were fetched."""
    rows = conform(pages, S.PAGE_METADATA)
    rows = rows.withColumn("created_at", F.coalesce("created_at", "crawl_timestamp"))
    rows = rows.withColumn("updated_at", F.coalesce("updated_at", "created_at"))
    _append(rows, f"{store}/metadata", "crawl_timestamp")


def append_status(events: DataFrame, store: str) -> None:
    _append(conform(events, STATUS_EVENT), f"{store}/status", "event_at")


def append_history(history: DataFrame, store: str) -> None:
    _append(conform(history, S.CRAWL_HISTORY), f"{store}/history", "crawl_timestamp")


def delete_results(keys: DataFrame, store: str) -> None:
    keys.select("crawl_id").distinct().write.mode("append").parquet(f"{store}/deleted")


def _dated(spark: SparkSession, schema: T.StructType, path: str) -> DataFrame:
    full = T.StructType(schema.fields + [T.StructField(PARTITION, T.DateType())])
    if not path_exists(spark, _spanned(path)):
        return spark.read.schema(full).parquet(path)
    spanned = spark.read.schema(T.StructType(full.fields + [T.StructField(SPAN, T.DateType())])).parquet(_spanned(path)).drop(SPAN)
    return spanned.unionByName(spark.read.schema(full).parquet(path)) if path_exists(spark, path) else spanned


def read_metadata(spark: SparkSession, store: str, deletes: bool = True) -> DataFrame:
    """Stored results without the deleted ones; the store's date column is there to prune by."""
    rows = _dated(spark, S.PAGE_METADATA, f"{store}/metadata")
    if not deletes or not path_exists(spark, f"{store}/deleted"):
        return rows
    keys = spark.read.schema("crawl_id string").parquet(f"{store}/deleted")
    return without_deleted(rows, keys)


def read_status(spark: SparkSession, store: str) -> DataFrame:
    return current_status(_dated(spark, STATUS_EVENT, f"{store}/status"))


def read_history(spark: SparkSession, store: str) -> DataFrame:
    return _dated(spark, S.CRAWL_HISTORY, f"{store}/history")


def compact(spark: SparkSession, store: str, into: str) -> None:
    """Write a fresh metadata generation without deleted results into a new store folder."""
    _write_new(read_metadata(spark, store), f"{into}/metadata")


def purge_history(
    spark: SparkSession, store: str, into: str, as_of: Column, days: int = HISTORY_DAYS
) -> DataFrame:
    """Write a history generation without settled rows older than ``days``; returns how many went."""
    history = read_history(spark, store)
    _write_new(history.filter(~expired(as_of, days)), f"{into}/history")
    return retention_count(history, as_of, days)


def encoded(value: str | Column) -> Column:
    """Nested column to JSON text, for export only."""
    return F.to_json(value)


def decoded(value: str | Column, kind: T.DataType) -> Column:
    return F.from_json(value, kind)
