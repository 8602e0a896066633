"""Readers: stored tables, JSON requests, file streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemill import schemas as S


def pin_utc(spark: SparkSession) -> None:
    """Timestamps without a zone are UTC throughout."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")


def with_zoned_times(df: DataFrame) -> DataFrame:
    """Zone-less timestamp columns as instants; ``unix_micros`` and watermarks need those."""
    zoneless = [f.name for f in df.schema.fields if isinstance(f.dataType, T.TimestampNTZType)]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in zoneless}) if zoneless else df


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    pin_utc(spark)
    return with_zoned_times(spark.read.parquet(f"{folder}/{name}.parquet"))


def stream_table(
    spark: SparkSession, folder: str, name: str, files_per_trigger: int | None = None
) -> DataFrame:
    """The same table, a file or a folder of files, as a stream; the schema comes from the stored footer, not from a scan."""
    pin_utc(spark)
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    # As a pattern, since a plain path of a stream has to be a folder.
    return with_zoned_times(reader.parquet(f"{folder}/{name}.parque[t]"))


def read_requests(spark: SparkSession, path: str) -> DataFrame:
    """Single crawl requests, one JSON object per line, explicit schema."""
    return spark.read.schema(S.CRAWL_REQUEST).json(path)


def read_batches(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(S.BATCH_REQUEST).json(path)


def read_robots(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(S.ROBOTS_SNAPSHOT).parquet(path)


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(S.RESPONSE).parquet(path)
