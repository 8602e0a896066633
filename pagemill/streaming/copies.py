"""Two streams, requests and fetched robots copies: each request meets the newest copy that is valid at its time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemill.operators.robots import ROBOTS_TTL_SECONDS
from pagemill.plans.scratch import scratch_path

LATE = "1 hour"
SLICES = 8


def newest_copy_stream(
    requests: DataFrame, copies: DataFrame, *carried: str, late: str = LATE, ttl_seconds: int = ROBOTS_TTL_SECONDS, slices: int = SLICES
) -> DataFrame:
    """``request_id, domain, event_at, snapshot_us`` and the ``carried`` columns of that copy; run in append mode.

    ``requests`` has ``request_id, domain, event_at``, ``copies`` has ``domain,
    fetched_at``. A copy is valid from its fetch until ``ttl_seconds`` later, so the
    join has bounds on both sides: a request leaves the state once the watermark has
    passed it, a copy once no later request can need it. Files may come in any order
    within ``late``; rows beyond it are dropped.

    A domain's requests are dealt to ``slices`` tasks and each gets the domain's
    copies, of which there are few beside requests. A request without a valid copy,
    or without a domain, comes out with nulls. Rows that repeat an id, a domain and a
    time are one request; of copies of one fetch any one is carried.
    """
    asked = requests.select(
        "request_id", "domain", "event_at", F.pmod(F.xxhash64("request_id"), F.lit(slices)).cast("int").alias("slice")
    ).withWatermark("event_at", late)
    held = copies.select(
        F.col("domain").alias("_domain"), "fetched_at", F.struct(*carried).alias("_carried") if carried else F.lit(True).alias("_carried")
    ).withWatermark("fetched_at", late)
    held = held.withColumn("_slice", F.explode(F.array(*[F.lit(i) for i in range(slices)])))
    valid = (F.col("fetched_at") <= F.col("event_at")) & (F.col("event_at") < F.col("fetched_at") + F.expr(f"INTERVAL {ttl_seconds} SECONDS"))
    met = asked.join(held, (F.col("domain") == F.col("_domain")) & (F.col("slice") == F.col("_slice")) & valid, "leftOuter")
    at = F.unix_micros("fetched_at")
    newest = met.groupBy("request_id", "domain", "event_at").agg(F.max(at).alias("snapshot_us"), F.max_by("_carried", at).alias("_carried"))
    return newest.select("request_id", "domain", "event_at", "snapshot_us", *[F.col(f"_carried.{c}").alias(c) for c in carried])


class Ending:
    """An input that can be told to end: rows still waiting for the watermark come out then.

    A mark, one row far in the future, goes through the same watermark as the rows.
    Its texts are empty and not null, as the join leaves null keys out before the
    watermark sees them. It lies in a folder of its own that stays empty until
    ``end``; the mark itself never comes out, as the watermark stays behind it.
    """

    def __init__(self, stream: DataFrame, time: str):
        self.spark, self.time = stream.sparkSession, time
        self.schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in stream.schema])
        self.folder = scratch_path(self.spark, "ending")
        self.spark.createDataFrame([], self.schema).write.parquet(self.folder)
        self.rows = stream.unionByName(self.spark.readStream.schema(self.schema).parquet(self.folder))

    def end(self) -> None:
        late = F.timestamp_seconds(F.lit(253_000_000_000))
        value = {f.name: F.lit("" if isinstance(f.dataType, T.StringType) else None) for f in self.schema} | {self.time: late}
        mark = self.spark.range(1).select(*[value[f.name].cast(f.dataType).alias(f.name) for f in self.schema])
        mark.write.mode("append").parquet(self.folder)


def run_to_end(requests: DataFrame, copies: DataFrame, label: str, *carried: str, late: str = LATE) -> DataFrame:
    """Run the join over what is available, end both inputs, run on from the kept state, and read all rows back."""
    spark = requests.sparkSession
    path = scratch_path(spark, label)
    asked, held = Ending(requests, "event_at"), Ending(copies, "fetched_at")
    rows = newest_copy_stream(asked.rows, held.rows, *carried, late=late)
    for closing in (False, True):
        if closing:
            asked.end()
            held.end()
        query = (
            rows.writeStream.format("parquet").outputMode("append")
            .option("path", f"{path}/rows").option("checkpointLocation", f"{path}/state")
            .trigger(availableNow=True).start()
        )
        query.awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{path}/rows")
