"""Politeness as state of a stream: one small row per domain, advanced by each micro-batch.

The state of a domain lapses an hour after its last start; the next request then
brings its own delay and counts from one.

``polite_batches`` takes backlogs and hot domains. A batch is cut into ordered
chunks as the batch schedule cuts a table, so a domain's rows need not meet in one
task. A lapse needs an hour between two arrivals; what lies between two such gaps is
a stretch. Each stretch is summed up, for each delay its domain may have, by its
size and its largest slack, and only these rows of a domain meet in one task: at
most one per hour of arrivals and delay. State that a watermark of arrivals has
passed is cleared with the batch after.

``polite_stream`` keeps its state in the stream itself. There a domain's rows of one
micro-batch meet in one task; bound them by the stream's admission settings
(``maxFilesPerTrigger`` / ``maxBytesPerTrigger``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from pagemill.operators.schedule import ORDER
from pagemill.plans import ordered as O
from pagemill.plans.scratch import durable, path_exists, scratch_path
from pagemill.schemas import DEFAULT_CRAWL_DELAY, LIMITER_TTL_SECONDS
from pagemill.session import STATE_STORE, STATE_STORE_CLASS

OUTPUT = "domain string, request_id long, arrival_us long, request_number long, delay_us long, start_us long"
STATE = "last_us long, requests long, delay_us long"
HELD = f"domain string, {STATE}"
TTL_US = LIMITER_TTL_SECONDS * 1_000_000
LATE_US = 60_000_000


def advance(
    arrivals: np.ndarray, delays_us: np.ndarray, state: tuple[int, int, int] | None, ttl_us: int = TTL_US
) -> tuple[np.ndarray, np.ndarray, np.ndarray, tuple[int, int, int]]:
    """Starts, numbers and delays of sorted arrivals, and the state after them.

    A lapse needs a gap of ``ttl_us`` between two arrivals, so the arrays are cut
    there and each cut is tested against the actual last start.
    """
    n = len(arrivals)
    starts = np.empty(n, dtype=np.int64)
    numbers = np.empty(n, dtype=np.int64)
    used = np.empty(n, dtype=np.int64)
    cuts = np.flatnonzero(np.diff(arrivals) >= ttl_us) + 1
    for lo, hi in zip(np.r_[0, cuts], np.r_[cuts, n]):
        if state is None or arrivals[lo] >= state[0] + ttl_us:
            delay, before, floor = int(delays_us[lo]), 0, arrivals[lo]
        else:
            delay, before, floor = state[2], state[1], state[0] + state[2]
        steps = np.arange(hi - lo, dtype=np.int64) * delay
        slack = np.maximum(np.maximum.accumulate(arrivals[lo:hi] - steps), floor)
        starts[lo:hi] = slack + steps
        numbers[lo:hi] = before + 1 + np.arange(hi - lo)
        used[lo:hi] = delay
        state = (int(starts[hi - 1]), int(numbers[hi - 1]), delay)
    return starts, numbers, used, state


class PoliteState(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self._state = handle.getValueState("limiter", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows), ignore_index=True).sort_values(["arrival_us", "request_id"])
        held = self._state.get() if self._state.exists() else None
        asked = batch["crawl_delay"].fillna(DEFAULT_CRAWL_DELAY).to_numpy()
        starts, numbers, used, state = advance(
            batch["arrival_us"].to_numpy(),
            np.round(asked * 1_000_000).astype(np.int64),
            tuple(held) if held is not None else None,
        )
        self._state.update(state)
        yield pd.DataFrame({
            "domain": key[0],
            "request_id": batch["request_id"].to_numpy(),
            "arrival_us": batch["arrival_us"].to_numpy(),
            "request_number": numbers,
            "delay_us": used,
            "start_us": starts,
        })

    def close(self) -> None:
        pass


def keep_state_on_disk(spark: SparkSession) -> None:
    """Keyed state of this kind needs the disk-backed store; ``session.build_session`` sets it for new sessions."""
    if not spark.conf.get(STATE_STORE, "").endswith("RocksDBStateStoreProvider"):
        spark.conf.set(STATE_STORE, STATE_STORE_CLASS)


def polite_stream(requests: DataFrame) -> DataFrame:
    """Schedule a stream of ``(domain, request_id, arrival_us, crawl_delay)``."""
    keep_state_on_disk(requests.sparkSession)
    narrow = requests.select("domain", "request_id", "arrival_us", "crawl_delay")
    return narrow.groupBy("domain").transformWithStateInPandas(
        PoliteState(), outputStructType=OUTPUT, outputMode="Append", timeMode="None"
    )


def _same(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on keys that may be null."""
    named = right.withColumnsRenamed({k: f"_of_{k}" for k in keys})
    same = F.lit(True)
    for k in keys:
        same = same & left[k].eqNullSafe(named[f"_of_{k}"])
    return left.join(named, same, how).drop(*[f"_of_{k}" for k in keys])


def _lives(group: pd.DataFrame) -> pd.DataFrame:
    """Stretches of one domain in order: which delay each has, what came before and when its last request starts."""
    first = group.iloc[0]
    state = None if pd.isna(first["last_us"]) else (int(first["last_us"]), int(first["requests"]), int(first["held_us"]))
    out = []
    for stretch, tried in group.sort_values("stretch").groupby("stretch"):
        arrival, asked = int(tried["head_us"].iloc[0]), int(tried["asked_us"].iloc[0])
        if state is None or arrival >= state[0] + TTL_US:
            delay, before, floor = asked, 0, arrival
        else:
            delay, before, floor = state[2], state[1], state[0] + state[2]
        row = tried[tried["try_us"] == delay].iloc[0]
        size = int(row["size"])
        state = (max(int(row["top"]), floor) + (size - 1) * delay, before + size, delay)
        out.append((first["domain"], int(stretch), delay, before, floor, *state[:2]))
    return pd.DataFrame(out, columns=["domain", "stretch", "delay_us", "before", "floor_us", "last_us", "requests"])


def advance_batch(batch: DataFrame, state: DataFrame, chunks: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The schedule of a batch, as ``OUTPUT``, and the state of its domains after it."""
    key, earlier, within = "domain", O.earlier_chunks("domain"), O.within("domain", ORDER)
    asked = F.coalesce(F.nanvl(F.col("crawl_delay").cast("double"), F.lit(None).cast("double")), F.lit(DEFAULT_CRAWL_DELAY))
    cut = O.into_chunks(
        batch.select(key, "request_id", "arrival_us", F.bround(asked * 1_000_000).cast("long").alias("asked_us")), key, ORDER, chunks
    )

    def until_here(value: Column) -> Column:
        return value.over(within)

    sizes = cut.groupBy(key, O.CHUNK).agg(F.count(F.lit(1)).alias("_rows"), F.max("arrival_us").alias("_last"))
    begun = O.carry(sizes, key, _offset=F.sum("_rows").over(earlier), _prior=F.max("_last").over(earlier))
    previous = F.lag("arrival_us").over(Window.partitionBy(key, O.CHUNK).orderBy(*ORDER))
    numbered = O.attach(cut.withColumn("_here", until_here(F.count(F.lit(1))) - 1).withColumn("_prev", previous), begun, key).select(
        key, "request_id", "arrival_us", "asked_us", O.CHUNK,
        (F.col("_here") + F.coalesce("_offset", F.lit(0))).alias("_n"),
        F.coalesce(F.col("arrival_us") - F.coalesce("_prev", "_prior") >= TTL_US, F.lit(False)).cast("long").alias("_gap"),
    ).withColumn("_head", F.when(F.col("_gap") == 1, F.col("_n")))
    gaps = numbered.groupBy(key, O.CHUNK).agg(F.sum("_gap").alias("_gaps"), F.max("_head").alias("_from"))
    passed = O.carry(gaps, key, _gaps_before=F.sum("_gaps").over(earlier), _head_before=F.max("_from").over(earlier))
    local = numbered.withColumn("_gaps", until_here(F.sum("_gap"))).withColumn("_from", until_here(F.max("_head")))
    placed = durable(O.attach(local, passed, key).select(
        key, "request_id", "arrival_us", "asked_us", O.CHUNK,
        (F.col("_gaps") + F.coalesce("_gaps_before", F.lit(0))).alias("stretch"),
        (F.col("_n") - F.coalesce("_from", "_head_before", F.lit(0))).alias("_k"),
    ))

    heads = placed.filter("_k = 0").select(key, "stretch", F.col("arrival_us").alias("head_us"), "asked_us")
    held = state.select(key, "last_us", "requests", F.col("delay_us").alias("held_us"))
    offered = heads.select(key, F.col("asked_us").alias("try_us")).unionByName(held.select(key, F.col("held_us").alias("try_us"))).distinct()
    # Rows per chunk of a domain, so a large domain is no heavier in these joins than its chunks.
    offered = _same(placed.select(key, O.CHUNK).distinct(), offered, [key])
    tried = _same(placed, offered, [key, O.CHUNK]).groupBy(key, "stretch", "try_us").agg(
        F.count(F.lit(1)).alias("size"), F.max(F.col("arrival_us") - F.col("_k") * F.col("try_us")).alias("top")
    )
    summary = _same(_same(tried, heads, [key, "stretch"]), held, [key], "left")
    lives = durable(summary.groupBy(key).applyInPandas(
        _lives, "domain string, stretch long, delay_us long, before long, floor_us long, last_us long, requests long"
    ))
    after = lives.groupBy(key).agg(F.max_by(F.struct("last_us", "requests", "delay_us"), "stretch").alias("_s")).select(key, "_s.*")

    met = _same(placed.select(key, O.CHUNK, "stretch").distinct(), lives.drop("last_us", "requests"), [key, "stretch"])
    timed = _same(placed, met, [key, O.CHUNK, "stretch"]).select(
        F.struct(key, "stretch").alias("life"), "request_id", "arrival_us", O.CHUNK, "_k", "delay_us", "before", "floor_us",
        (F.col("arrival_us") - F.col("_k") * F.col("delay_us")).alias("_slack"),
    )
    tops = timed.groupBy("life", O.CHUNK).agg(F.max("_slack").alias("_top"))
    reached = O.carry(tops, "life", _before=F.max("_top").over(O.earlier_chunks("life")))
    running = timed.withColumn("_here", F.max("_slack").over(O.within("life", ORDER)))
    rows = O.attach(running, reached, "life").select(
        "life.domain", "request_id", "arrival_us",
        (F.col("before") + 1 + F.col("_k")).alias("request_number"), "delay_us",
        (F.greatest("_here", "_before", "floor_us") + F.col("_k") * F.col("delay_us")).alias("start_us"),
    )
    return rows, after


def polite_batches(requests: DataFrame, label: str, late_us: int = LATE_US) -> DataFrame:
    """Schedule what is available of a stream of ``(domain, request_id, arrival_us, crawl_delay)``.

    After each batch the state is that of domains whose lifetime the latest arrival
    less ``late_us`` has not passed; an arrival still later than that finds none.
    """
    spark = requests.sparkSession
    path = scratch_path(spark, label)

    def write(batch: DataFrame, batch_id: int) -> None:
        # A batch writes its own folders and reads those of the batch before, so a replay is harmless.
        # Two folders of state are enough.
        before = f"{path}/domains/{(batch_id - 1) % 2}"
        state = spark.read.schema(f"{HELD}, mark_us long").parquet(before) if path_exists(spark, before) and batch_id else spark.createDataFrame([], f"{HELD}, mark_us long")
        rows, after = advance_batch(batch, state)
        rows.write.mode("overwrite").parquet(f"{path}/rows/batch_id={batch_id}")
        seen = [batch.agg(F.max("arrival_us")).first()[0], state.agg(F.max("mark_us")).first()[0]]
        mark = max((m for m in seen if m is not None), default=None)
        still = _same(state.drop("mark_us"), after.select("domain"), ["domain"], "left_anti").unionByName(after)
        if mark is not None:
            still = still.filter(F.col("last_us") + TTL_US > mark - late_us)
        still.withColumn("mark_us", F.lit(mark).cast("long")).write.mode("overwrite").parquet(f"{path}/domains/{batch_id % 2}")

    query = (
        requests.select("domain", "request_id", "arrival_us", "crawl_delay")
        .writeStream.option("checkpointLocation", f"{path}/state").foreachBatch(write).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    if not path_exists(spark, f"{path}/rows"):
        return spark.createDataFrame([], OUTPUT)
    return spark.read.schema(f"{OUTPUT}, batch_id long").parquet(f"{path}/rows").drop("batch_id")
