"""The life of a crawl as a stream: legal status changes are taken, others are told apart.

State per crawl id is the status taken last and its time. A finished crawl is
forgotten ``LINGER_US`` after its end, any other ``LIFETIME_US`` after its last
change; from then on the id starts anew. This is decided by the events' own times,
so it does not depend on how they are cut into batches; a timer clears the state
once the watermark has passed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from pagemill.operators.queue import STATUS_RANK
from pagemill.streaming.polite import keep_state_on_disk

# What may follow a status; an id that is not known starts as pending.
FOLLOWS = {
    "": ("pending",),
    "pending": ("processing",),
    "processing": ("completed", "failed"),
    "failed": ("retry",),
    "retry": ("processing",),
    "completed": (),
}
LINGER_US = 3_600_000_000
LIFETIME_US = 86_400_000_000


def ends_at(status: str, at: int) -> int:
    """When a crawl with this status and time is forgotten."""
    return at + (LIFETIME_US if FOLLOWS[status] else LINGER_US)


class Machine(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._held = handle.getValueState("held", "status string, at_us long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        status, at = self._held.get() if self._held.exists() else ("", 0)
        # Times and statuses only; a key's rows of one batch are bounded by the stream's admission settings.
        events = sorted(
            (int(t), STATUS_RANK.get(s, -1), s)
            for part in rows for t, s in zip(part["event_us"], part["status"].fillna(""), strict=True)
        )
        out, changed = [], False
        for time, _, wanted in events:
            if status and time >= ends_at(status, at):
                status = ""
            before = status
            legal = wanted in FOLLOWS[status] and (not status or time >= at)
            if legal:
                status, at, changed = wanted, time, True
            out.append((time, wanted, before or None, legal))
        if changed:
            self._held.update((status, at))
            self._handle.registerTimer(ends_at(status, at) // 1000 + 1)
        elif not status and self._held.exists():
            self._held.clear()
        times, statuses, befores, legals = zip(*out, strict=True) if out else ((), (), (), ())
        yield pd.DataFrame({
            "crawl_id": [key[0]] * len(out), "event_us": np.array(times, np.int64), "status": statuses,
            "from_status": pd.Series(befores, dtype=object), "legal": np.array(legals, bool),
        })

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # A later change has moved the end on; its own timer will come.
        if self._held.exists() and ends_at(*self._held.get()) <= expiredTimerInfo.getExpiryTimeInMs() * 1000:
            self._held.clear()
        return iter(())

    def close(self) -> None:
        pass


def checked_status_stream(events: DataFrame, late: str = "1 minute") -> DataFrame:
    """``crawl_id, event_us, status, from_status, legal`` of every event; only legal ones change the status.

    An event older than the status held is not legal. Events of a batch are taken in
    order of time, then of status.
    """
    keep_state_on_disk(events.sparkSession)
    rows = events.withWatermark("event_at", late).select(
        "crawl_id", "event_at", "status", F.unix_micros("event_at").alias("event_us")
    )
    return rows.groupBy("crawl_id").transformWithStateInPandas(
        Machine(), outputStructType="crawl_id string, event_us long, status string, from_status string, legal boolean",
        outputMode="Append", timeMode="EventTime",
    )
