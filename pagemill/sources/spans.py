"""Folders by date whose number follows the rows rather than the calendar.

A write of few dates has a folder per date. One of many dates puts 2, 4, 8, ... days
in a row into a folder, so that a folder holds about ``SPAN_ROWS`` rows, or the write
has no more than ``FOLDERS`` of them. Spans of days begin at multiples of their length
since 1970, so any two of them are apart or one lies in the other.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FOLDERS = 64
SPAN_ROWS = 250_000


def span_days(rows: int, first: date | None, last: date | None) -> int:
    """Days per folder, a power of two, for so many rows between two dates."""
    days = 1
    most = max(FOLDERS, -(-rows // SPAN_ROWS))
    while first is not None and ((last - first).days + 1) / days > most:
        days *= 2
    return days


def days_of(rows: DataFrame, on_date: str | Column) -> int:
    """Days per folder for these rows; reads their date only."""
    at = rows.select(F.to_date(on_date).alias("at")).agg(F.count("at"), F.min("at"), F.max("at")).first()
    return span_days(*at)


def span_start(on_date: str | Column, days: int) -> Column:
    """The first day of the span that a date lies in."""
    day = F.unix_date(F.to_date(on_date))
    return F.date_from_unix_date((day - F.pmod(day, F.lit(days))).cast("int"))
