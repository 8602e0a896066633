"""Counters, histograms and the corpus summary as grouped aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.plans.scratch import durable

# Upper bounds of the time buckets in seconds.
SECONDS_BUCKETS = (0.005, 0.01, 0.025, 0.05, 0.075, 0.1, 0.25, 0.5, 0.75, 1.0, 2.5, 5.0, 7.5, 10.0)
# Byte buckets are our own choice; the time bounds mean nothing for sizes.
BYTES_BUCKETS = (1024, 4096, 16384, 65536, 262144, 1048576, 4194304, 10485760)


def or_unknown(label: Column) -> Column:
    return F.coalesce(F.nullif(label, F.lit("")), F.lit("unknown"))


def count_by(rows: DataFrame, name: str, **labels: Column) -> DataFrame:
    """A labelled counter; missing labels count as ``unknown``."""
    return rows.groupBy(*[or_unknown(c.cast("string")).alias(n) for n, c in labels.items()]).agg(
        F.count(F.lit(1)).alias(name)
    )


def requests_total(rows: DataFrame, method: Column) -> DataFrame:
    return count_by(rows, "requests", status=F.col("status"), domain=F.col("domain"), method=method)


def pages_crawled(rows: DataFrame) -> DataFrame:
    return count_by(rows, "pages", domain=F.col("domain"), status_code=F.col("status_code"))


def errors_total(rows: DataFrame) -> DataFrame:
    return count_by(rows, "errors", error_type=F.col("error_type"), domain=F.col("domain"))


def bucket_label(bound: float) -> str:
    return f"le_{bound:g}".replace(".", "_") if bound < 1024 else f"le_{int(bound)}"


def histogram(
    rows: DataFrame, labels: Sequence[str], value: Column, bounds: Sequence[float] = SECONDS_BUCKETS
) -> DataFrame:
    """Cumulative buckets, sum and count per label set, in one aggregate."""
    measured = rows.withColumn("_value", value)
    return measured.groupBy(*labels).agg(
        *[F.count_if(F.col("_value") <= b).alias(bucket_label(b)) for b in bounds],
        F.sum("_value").alias("value_sum"),
        F.count("_value").alias("value_count"),
    )


def response_time_histogram(rows: DataFrame) -> DataFrame:
    return histogram(rows, ["domain"], F.col("response_time_ms") / 1000)


def request_duration_histogram(rows: DataFrame) -> DataFrame:
    return histogram(rows, ["domain", "status"], F.col("duration_s"))


def content_size_histogram(rows: DataFrame) -> DataFrame:
    return histogram(rows, ["domain", "content_type"], F.octet_length("html"), BYTES_BUCKETS)


def corpus_summary(metadata: DataFrame, approximate: bool = False) -> DataFrame:
    """Totals over all pages and the sorted topic names; ``approximate`` sketches the domain count.

    Pages are reduced to narrow rows, written once: totals and topic names are two
    aggregates over them, and the names collected are distinct ones.
    """
    domains = F.approx_count_distinct("domain") if approximate else F.count_distinct("domain")
    narrow = durable(metadata.select(
        "domain", "word_count", "response_time_ms",
        F.size("images").alias("images"), F.size("links").alias("links"), F.col("topics.topic").alias("names"),
    ))
    totals = narrow.agg(
        F.count(F.lit(1)).alias("pages"),
        domains.alias("domains"),
        F.sum("word_count").alias("words"),
        F.avg("response_time_ms").alias("mean_response_ms"),
        F.sum("images").alias("images"),
        F.sum("links").alias("links"),
        F.sum(F.size("names")).alias("topics"),
    ).withColumn("_one", F.lit(1))
    names = narrow.select(F.explode("names").alias("name")).distinct().agg(
        F.array_sort(F.collect_list("name")).alias("topic_names")
    ).withColumn("_one", F.lit(1))
    # One row meets one row.
    return totals.join(names, "_one").drop("_one").withColumn("distinct_topics", F.size("topic_names"))
