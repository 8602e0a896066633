"""Result freshness as keyed state: the time of the result kept last, per crawl id.

Ids are dealt into a fixed number of buckets and a bucket's ids share one state, so a
batch costs a few state calls per bucket in place of a few per id. A timer clears a
bucket's ids once their lifetime is behind the watermark, so state holds only the ids
seen within a lifetime.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from pagemill.schemas import RESULT_TTL_SECONDS
from pagemill.streaming.polite import keep_state_on_disk

#: A stream goes on with the number of buckets it began with.
BUCKETS = 2048


class FreshState(StatefulProcessor):
    def __init__(self, ttl_us: int):
        self._ttl_us = ttl_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._held = handle.getValueState("kept", "ids array<string>, at_us array<long>")

    def _kept(self) -> dict[str | None, int]:
        return dict(zip(*self._held.get(), strict=True)) if self._held.exists() else {}

    def _keep(self, kept: dict[str | None, int], passed_us: int) -> None:
        """Hold the ids whose lifetime ends after ``passed_us``."""
        live = {k: at for k, at in kept.items() if at + self._ttl_us > passed_us}
        if live:
            self._held.update((list(live), list(live.values())))
        else:
            self._held.clear()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        kept, ids, ats = self._kept(), [], []
        # Only ids and times are held; a bucket's rows of one batch are bounded by the stream's admission settings.
        for part in rows:
            ids += part["crawl_id"].tolist()
            ats += part["event_us"].tolist()
        out_ids, out_ats = [], []
        for i in np.argsort(np.array(ats, np.int64), kind="stable").tolist():
            name, at = ids[i], ats[i]
            last = kept.get(name)
            if last is None or at >= last + self._ttl_us:
                out_ids.append(name)
                out_ats.append(at)
                kept[name] = at
        if out_ids:
            self._keep(kept, timerValues.getCurrentWatermarkInMs() * 1000)
            self._handle.registerTimer((max(out_ats) + self._ttl_us) // 1000 + 1)
            yield pd.DataFrame({"crawl_id": pd.Series(out_ids, dtype=object), "event_us": np.array(out_ats, np.int64)})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # Later results have moved their lifetimes on; their own timers will come.
        if self._held.exists():
            self._keep(self._kept(), expiredTimerInfo.getExpiryTimeInMs() * 1000)
        return iter(())

    def close(self) -> None:
        pass


def fresh_result_stream(
    results: DataFrame, ttl_seconds: int = RESULT_TTL_SECONDS, late: str = "1 minute", buckets: int = BUCKETS
) -> DataFrame:
    """First result per crawl id of each lifetime, as ``crawl_id, event_at``; repeats inside a lifetime are dropped.

    A result older than the one kept counts as a repeat.
    """
    keep_state_on_disk(results.sparkSession)
    rows = results.withWatermark("event_at", late).select(
        F.pmod(F.xxhash64("crawl_id"), F.lit(buckets)).cast("int").alias("bucket"), "crawl_id", "event_at",
        F.unix_micros("event_at").alias("event_us"),
    )
    kept = rows.groupBy("bucket").transformWithStateInPandas(
        FreshState(ttl_seconds * 1_000_000), outputStructType="crawl_id string, event_us long",
        outputMode="Append", timeMode="EventTime",
    )
    return kept.select("crawl_id", F.timestamp_micros("event_us").alias("event_at"))
