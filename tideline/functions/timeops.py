"""Integer arithmetic on milliseconds since the epoch, in UTC. Divisions floor, also below zero."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SECOND_MS = 1_000
HOUR_MS = 3_600_000
DAY_MS = 86_400_000


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def floor_to(x: Column | str, width: int) -> Column:
    """The greatest multiple of ``width`` that is not above ``x``; null stays null."""
    x = _c(x).cast("long")
    return x - F.pmod(x, F.lit(width).cast("long"))


def floor_div(x: Column | str, width: int) -> Column:
    return F.call_function("div", floor_to(x, width), F.lit(width).cast("long"))


def utc_day(x: Column | str) -> Column:
    return floor_div(x, DAY_MS)


def day_start(day: Column | str) -> Column:
    return _c(day).cast("long") * F.lit(DAY_MS).cast("long")


def hour_floor(x: Column | str) -> Column:
    return floor_to(x, HOUR_MS)


def second_of(x: Column | str) -> Column:
    return floor_div(x, SECOND_MS)


def iso_text(x: Column | str) -> Column:
    """``2013-01-01T00:00:00.123Z``, whatever the session's zone."""
    day = utc_day(x)
    rest = _c(x).cast("long") - day_start(day)
    two = lambda c, n=2: F.lpad(c.cast("string"), n, "0")
    at = lambda unit, limit: F.pmod(floor_div(rest, unit), F.lit(limit))
    clock = F.concat(two(floor_div(rest, HOUR_MS)), F.lit(":"), two(at(60_000, 60)), F.lit(":"), two(at(1_000, 60)), F.lit("."), two(F.pmod(rest, F.lit(1_000)), 3))
    return F.concat(F.date_from_unix_date(day.cast("int")).cast("string"), F.lit("T"), clock, F.lit("Z"))


def parse_utc_date(text: Column | str) -> Column:
    """Milliseconds of a strict ``YYYY-MM-DD``; anything else is null."""
    text = _c(text)
    strict = text.rlike(r"^\d{4}-\d{2}-\d{2}$")
    date = F.when(strict, F.try_to_date(text, "yyyy-MM-dd"))
    return F.unix_date(date).cast("long") * F.lit(DAY_MS)


def naive_ms(ts: Column | str) -> Column:
    """Milliseconds of a zone-less timestamp, whatever the session's zone; microseconds are cut off."""
    epoch = F.to_timestamp_ntz(F.lit("1970-01-01 00:00:00"))
    return F.timestamp_diff("MILLISECOND", epoch, _c(ts).cast("timestamp_ntz"))


def overlap_ms(start: Column, end: Column, low: Column, high: Column) -> Column:
    """Length of [start, end) inside [low, high), 0 where they are apart."""
    return F.greatest(F.lit(0).cast("long"), F.least(end, high) - F.greatest(start, low))
