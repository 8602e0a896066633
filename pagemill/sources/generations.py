"""Stores whose changes rewrite only the dates they touch, under a manifest per generation.

A table's rows lie in folders by date; a write of many dates has folders of several
days (``spans``), so their number follows the rows. A generation is a small table that
names the folders it is made of, with their rows; the newest one is the table. A change
writes new folders for those it touches, then a manifest that names these and the
untouched ones, which is put in place by one rename. A reader that holds a generation
goes on reading the same files. One writer at a time: a manifest that another writer
has put in place first is not replaced.

Rows are sorted by their key in files with bloom filters on it, so a look-up skips
row groups by their range and files by their filter. A listing reads dates newest
first, as far as it needs them; the manifest tells how many rows each has.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemill.operators.results import HISTORY_DAYS, expired
from pagemill.sources import spans

_ENTRY = "on_date date, folder string, rows long, days int"
_DATE = "on_date"
_PLACE = rf"(data/[0-9a-f]+/{_DATE}=[^/]+)/[^/]+$"


@dataclass(frozen=True)
class Entry:
    """The rows that one write put down for ``days`` dates from ``on_date`` on."""

    on_date: date
    folder: str
    rows: int
    days: int = 1

    @property
    def last(self) -> date:
        return self.on_date + timedelta(days=self.days - 1)

    @property
    def path(self) -> str:
        return f"{self.folder}/{_DATE}={self.on_date}"


@dataclass(frozen=True)
class Generation:
    number: int
    entries: tuple[Entry, ...]

    @property
    def dates(self) -> list[date]:
        """First dates of spans that don't meet, newest first."""
        return [held[0].on_date for held in self.spans]

    @property
    def spans(self) -> list[list[Entry]]:
        """Entries whose dates meet, together; the newest first."""
        found: list[list[Entry]] = []
        end = None
        for e in sorted(self.entries, key=lambda e: (e.on_date, -e.days)):
            if end is None or e.on_date > end:
                found.append([])
            found[-1].append(e)
            end = e.last if end is None else max(end, e.last)
        return found[::-1]


class Store:
    """One table at ``root``: rows of ``schema`` with a unique ``key``, dated by the timestamp ``at``, which is never null."""

    def __init__(self, spark: SparkSession, root: str, schema: T.StructType, key: str = "crawl_id", at: str = "created_at"):
        self.spark, self.root, self.schema, self.key, self.at = spark, root.rstrip("/"), schema, key, at

    # --- generations ----------------------------------------------------------------------------

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _files(self):
        return self._path("").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def current(self) -> Generation:
        files, place = self._files(), self._path("generations")
        names = [s.getPath().getName() for s in files.listStatus(place)] if files.exists(place) else []
        number = max((int(n) for n in names if n.isdigit()), default=0)
        return self.generation(number)

    def generation(self, number: int) -> Generation:
        if not number:
            return Generation(0, ())
        # One row per date and write.
        rows = self.spark.read.schema(_ENTRY).parquet(f"{self.root}/generations/{number:09d}").collect()
        return Generation(number, tuple(Entry(r["on_date"], r["folder"], r["rows"], r["days"] or 1) for r in rows))

    def _commit(self, base: Generation, entries: list[Entry]) -> Generation:
        number = base.number + 1
        draft, final = f"generations/.draft-{uuid.uuid4().hex}", f"generations/{number:09d}"
        rows = [(e.on_date, e.folder, e.rows, e.days) for e in entries]
        self.spark.createDataFrame(rows, _ENTRY).coalesce(1).write.parquet(f"{self.root}/{draft}")
        files = self._files()
        if files.exists(self._path(final)) or not files.rename(self._path(draft), self._path(final)):
            raise RuntimeError(f"another writer has made generation {number} of {self.root}")
        return Generation(number, tuple(entries))

    # --- rows -----------------------------------------------------------------------------------

    def read(self, generation: Generation | None = None, dates: list[date] | None = None) -> DataFrame:
        """The rows of a generation, the newest one unless given, of some of its dates if given."""
        entries = (generation or self.current()).entries
        if dates is None:
            return self._rows(entries)
        wanted = [e for e in entries if any(e.on_date <= d <= e.last for d in dates)]
        rows = self._rows(wanted)
        return rows if all(e.days == 1 for e in wanted) else rows.filter(F.to_date(self.at).isin(list(dates)))

    def _rows(self, entries: Iterable[Entry]) -> DataFrame:
        paths = [f"{self.root}/{e.path}" for e in entries]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths)

    def _write(self, rows: DataFrame, days: int | None = None) -> list[Entry]:
        folder = f"data/{uuid.uuid4().hex}"
        days = days or spans.days_of(rows, self.at)
        dated = rows.select(*self.schema.names).withColumn(_DATE, spans.span_start(self.at, days))
        (
            dated.hint("rebalance", _DATE).sortWithinPartitions(_DATE, self.key)
            .write.partitionBy(_DATE).option(f"parquet.bloom.filter.enabled#{self.key}", "true")
            .option("parquet.page.row.count.limit", "2000")  # a look-up reads the pages that may hold its key
            .parquet(f"{self.root}/{folder}")
        )
        written = self.spark.read.schema(f"{_DATE} date").option("basePath", f"{self.root}/{folder}").parquet(f"{self.root}/{folder}")
        counts = written.groupBy(_DATE).agg(F.count(F.lit(1)).alias("n")).collect()
        return [Entry(r[_DATE], folder, r["n"], days) for r in counts if r[_DATE] is not None]

    def _touched(self, base: Generation, choose: Callable[[DataFrame], DataFrame]) -> list[Entry]:
        """The entries that hold rows which ``choose`` keeps."""
        if not base.entries:
            return []
        placed = self._rows(base.entries).select("*", F.regexp_extract("_metadata.file_path", _PLACE, 1).alias("_place"))
        found = {r[0] for r in choose(placed).select("_place").distinct().collect()}
        return [e for e in base.entries if e.path in found]

    def _replace(self, base: Generation, old: list[Entry], kept: Callable[[DataFrame], DataFrame], added: list[Entry] | None = None) -> Generation:
        """With the rows of ``old`` that ``kept`` keeps in place of these."""
        rewritten = []
        if old:
            days = spans.span_days(sum(e.rows for e in old), min(e.on_date for e in old), max(e.last for e in old))
            rewritten = self._write(kept(self._rows(old)), days)
        gone = set(old)
        return self._commit(base, [*(e for e in base.entries if e not in gone), *rewritten, *(added or [])])

    # --- changes --------------------------------------------------------------------------------

    def append(self, rows: DataFrame) -> Generation:
        return self._commit(base := self.current(), [*base.entries, *self._write(rows)])

    def delete(self, keys: DataFrame) -> Generation:
        """Without the rows whose key is in ``keys``."""
        base, keys = self.current(), keys.select(self.key).distinct()
        old = self._touched(base, lambda rows: rows.join(keys, self.key, "left_semi"))
        return self._replace(base, old, lambda rows: rows.join(keys, self.key, "left_anti"))

    def upsert(self, rows: DataFrame) -> Generation:
        """With ``rows``, whose keys are unique, in place of stored rows of the same keys."""
        base, keys = self.current(), rows.select(self.key)
        old = self._touched(base, lambda held: held.join(keys, self.key, "left_semi"))
        return self._replace(base, old, lambda held: held.join(keys, self.key, "left_anti"), self._write(rows))

    def purge(self, as_of: Column, days: int = HISTORY_DAYS) -> Generation:
        """Without settled rows older than ``days``; folders with nothing to purge stay as they are."""
        base, gone = self.current(), expired(as_of, days, self.at)
        old = self._touched(base, lambda rows: rows.filter(gone))
        return self._replace(base, old, lambda rows: rows.filter(~gone))

    # --- reads that leave most files out --------------------------------------------------------

    def look_up(self, key: str, generation: Generation | None = None) -> DataFrame:
        return self.read(generation).filter(F.col(self.key) == key)

    def page(
        self, limit: int = 10, after: tuple[datetime, str] | None = None, where: Column | None = None,
        generation: Generation | None = None,
    ) -> DataFrame:
        """The next ``limit`` rows newest first, ties by key, behind the row that ``after`` names.

        Dates are added, newest first and twice as many each time, until they hold a page.
        """
        generation = generation or self.current()
        parts = [p for p in generation.spans if after is None or p[0].on_date <= after[0].date()]
        behind = F.lit(True)
        if after is not None:
            stamp = F.lit(after[0])
            behind = (F.col(self.at) < stamp) | ((F.col(self.at) == stamp) & (F.col(self.key) > after[1]))

        def found(count: int) -> DataFrame:
            return self._rows(e for p in parts[:count] for e in p).filter(behind if where is None else behind & where)

        known = where is None  # then all rows but those of the first part, if it is cut, are sure to count
        taken = 1
        while taken < len(parts):
            sure = parts[(1 if after is not None else 0) : taken]
            if known and sum(e.rows for p in sure for e in p) >= limit:
                break
            if (not known or after is not None) and found(taken).limit(limit).count() >= limit:
                break
            taken = taken + 1 if known and after is None else 2 * taken
        return found(taken).orderBy(F.desc(self.at), self.key).limit(limit)
