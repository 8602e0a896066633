"""Shared pieces of the training-data operators: texts, words, sizes and ordered chunks."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagemill.plans.scratch import durable

#: A word is a run of characters other than the space and U+0009 to U+000D.
BLANKS = "[ \\t-\\r]+"
CHUNK_ROWS = 500_000


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """The text, with null read as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def words_of(text: Column) -> Column:
    """The words of a text, in order."""
    return F.array_remove(F.split(text, BLANKS), "")


def word_count(text: Column) -> Column:
    return F.size(words_of(text)).cast("long")


def fresh(label: str) -> str:
    """A column name that no caller's column can clash with."""
    return f"_{label}_{uuid.uuid4().hex[:8]}"


def chunk_count(rows: int, spark: SparkSession, per_chunk: int = CHUNK_ROWS) -> int:
    """Chunks for an ordered cut: by rows, and at least the session's shuffle partitions."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // per_chunk))


def ordered_chunks(rows: DataFrame, order: list[Column], chunks: int, chunk: str) -> DataFrame:
    """Cut rows into ordered chunks, written once: the cut comes from sampled bounds and is read more than once."""
    return durable(rows.repartitionByRange(chunks, *order).withColumn(chunk, F.spark_partition_id()))


def earlier(part: str | None, chunk: str) -> Window:
    """Window over the totals of the chunks before the current one."""
    window = Window.partitionBy(part) if part else Window.partitionBy()
    return window.orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
