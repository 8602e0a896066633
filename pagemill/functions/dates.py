"""Dates in free form as column expressions: parts are recognised by their look, in whatever order they stand.

A date is made of a clock with an optional zone, weekday names, one month name,
numbers and filler words; any other word means that the text is no date. Of three
numbers the first is the year if it has four digits or passes 31, else the last is;
of the other two the month comes first unless it passes 12. Beside a month name
the day comes first unless the first number is a year. Years of two digits run from
1969 to 2068. A missing day or month is the first one; a missing year gives no
date, and neither does a date that no calendar holds. Times without a zone are UTC.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagemill.functions.text import let

# Names and offsets in hours.
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
ZONES = {"est": -5, "edt": -4, "cst": -6, "cdt": -5, "mst": -7, "mdt": -6, "pst": -8, "pdt": -7}
FILLERS = ("at", "on", "and", "of", "the", "t", "st", "nd", "rd", "th")

_MONTH = (
    r"(?<![a-z])(jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sept?(?:ember)?"
    r"|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)(?![a-z])"
)
_WEEKDAY = r"(?<![a-z])(?:mon|tues?|wed(?:nes)?|thu(?:rs?)?|fri|sat(?:ur)?|sun)(?:day)?(?![a-z])"
_FILLER = rf"(?<![a-z])(?:{'|'.join(FILLERS)})(?![a-z])"
#: Hour, minute, second, fraction, half of the day (twice), zone name, sign, hours and minutes of the offset.
_CLOCK = (
    r"(?<![0-9])([0-9]{1,2})(?::([0-9]{2})(?::([0-9]{2})(?:[.,]([0-9]+))?)?(?:\s*([ap])\.?m(?![a-z])\.?)?|\s*([ap])\.?m(?![a-z])\.?)"
    rf"(?:\s*(z|utc|gmt|{'|'.join(ZONES)})(?![a-z]))?(?:\s*([+-])([0-9]{{1,2}})(?::?([0-9]{{2}}))?(?![0-9]))?"
)
_STRANGE = r"[^0-9\s.,;/'’-]"


def _int(text: Column) -> Column:
    return text.try_cast("int")


def _year(text: Column) -> Column:
    short = F.when(_int(text) < 69, _int(text) + 2000).otherwise(_int(text) + 1900)
    return F.when(F.length(text) <= 2, short).when(F.length(text) == 4, _int(text))


def _is_year(text: Column) -> Column:
    return (F.length(text) == 4) | (_int(text) > 31)


def _day(year: Column, month: Column, day: Column) -> Column:
    return F.struct(_year(year).alias("y"), month.cast("int").alias("m"), day.cast("int").alias("d"))


def _calendar(numbers: Column, month: Column) -> Column:
    """``struct<y, m, d>`` from the numbers as texts and the month name's place, which is null without a name."""
    a, b, c = (F.get(numbers, F.lit(i)) for i in range(3))
    n, first = F.size(numbers), F.lit(1)
    named = F.when((n == 2) & _is_year(a), _day(a, month, _int(b))).when(n == 2, _day(b, month, _int(a))).when(
        (n == 1) & (F.length(a) == 4), _day(a, month, first)
    )
    turned = _int(b) > 12
    year_first = _day(a, F.when(turned, _int(c)).otherwise(_int(b)), F.when(turned, _int(b)).otherwise(_int(c)))
    turned = _int(a) > 12
    year_last = _day(c, F.when(turned, _int(b)).otherwise(_int(a)), F.when(turned, _int(a)).otherwise(_int(b)))
    joined = _day(F.substring(a, 1, 4), _int(F.substring(a, 5, 2)), _int(F.substring(a, 7, 2)))
    bare = (
        F.when((n == 3) & _is_year(a), year_first).when(n == 3, year_last)
        .when((n == 2) & (F.length(a) == 4), _day(a, _int(b), first))
        .when((n == 2) & (F.length(b) == 4), _day(b, _int(a), first))
        .when((n == 1) & (F.length(a) == 8), joined)
        .when((n == 1) & (F.length(a) == 4), _day(a, first, first))
    )
    return F.when(month.isNotNull(), named).otherwise(bare)


def _clock(text: Column) -> Column:
    """``struct<h, mi, s, off>`` of the only clock; midnight without one, nulls where it is none of any day."""

    def group(i: int) -> Column:
        return F.regexp_extract(text, _CLOCK, i)

    half = F.concat(group(5), group(6))
    hour = _int(group(1))
    told = F.when(half == "", hour).when(hour.between(1, 12), hour % 12 + F.when(half == "p", 12).otherwise(0))
    second = F.concat(F.lpad(group(3), 2, "0"), F.lit("."), F.rpad(F.substring(group(4), 1, 6), 6, "0")).try_cast("decimal(8,6)")
    zone = F.lit(0)
    for name, hours in ZONES.items():
        zone = F.when(group(7) == name, hours).otherwise(zone)
    shift = F.coalesce(_int(group(9)), F.lit(0)) * 60 + F.coalesce(_int(group(10)), F.lit(0))
    off = zone * 60 + F.when(group(8) == "-", -shift).otherwise(shift)
    none = group(0) == ""
    return F.struct(
        F.when(none, 0).otherwise(told).alias("h"),
        F.when(none | (group(2) == ""), 0).otherwise(_int(group(2))).alias("mi"),
        F.when(none, F.lit(0).cast("decimal(8,6)")).otherwise(second).alias("s"),
        off.alias("off"),
    )


def lenient_date(text: Column) -> Column:
    """The timestamp that a text in free form names; null where it names none."""

    def of_parts(p: Column) -> Column:
        day, clock = p["day"], p["clock"]
        at = F.try_make_timestamp(day["y"], day["m"], day["d"], clock["h"], clock["mi"], clock["s"], F.lit("UTC"))
        return F.timestamp_micros(F.unix_micros(at) - clock["off"].cast("long") * 60_000_000)

    def of_rest(r: Column) -> Column:
        rest, lowered = r["rest"], r["text"]
        name = F.substring(F.regexp_extract(rest, _MONTH, 1), 1, 3)
        month = F.when(name != "", F.array_position(F.array(*[F.lit(m) for m in MONTHS]), name))
        numbers = F.regexp_extract_all(rest, F.lit("[0-9]+"), F.lit(0))
        left = F.regexp_replace(F.regexp_replace(rest, _MONTH, " "), _FILLER, " ")
        plain = ~left.rlike(_STRANGE) & (F.regexp_count(rest, F.lit(_MONTH)) <= 1) & (F.regexp_count(lowered, F.lit(_CLOCK)) <= 1)
        parts = F.struct(_calendar(numbers, month).alias("day"), _clock(lowered).alias("clock"))
        return F.when(plain, let(parts, of_parts))

    def of_text(t: Column) -> Column:
        rest = F.regexp_replace(F.regexp_replace(t, _CLOCK, " "), _WEEKDAY, " ")
        return let(F.struct(t.alias("text"), rest.alias("rest")), of_rest)

    return let(F.regexp_replace(F.lower(text), r"\([^()]*\)", " "), of_text)
