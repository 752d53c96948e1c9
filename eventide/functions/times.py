"""Timestamp parsing, formatting and bucketing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space as a Python string sees it, as a pattern (Java and RE2) and as characters.
WS = r"[\t-\r\x{1c}-\x{20}\x{85}\p{Z}]"
WS_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

_ISO = (
    r"^\d{4}-\d{2}-\d{2}([T ]\d{2}(:\d{2}(:\d{2}([.]\d{1,9})?)?)?"
    r"(Z|[+-]\d{2}(:?\d{2}(:?\d{2})?)?)?)?$"
)


def strip(c: Column) -> Column:
    """Trim all Unicode white space, not only blanks."""
    return F.btrim(c, F.lit(WS_CHARS))


def parse_ts(c: Column) -> Column:
    """ISO text with ``Z``, an offset or none (then UTC) to TIMESTAMP; NULL if unusable."""
    s = F.btrim(c)
    return F.when(s.rlike(_ISO), s.try_cast("timestamp"))


def iso_z(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def iso_local(ts: Column, tz: str = "UTC") -> Column:
    """Local wall clock with a numeric offset, whole seconds."""
    if tz == "UTC":
        return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'+0000'")
    wall = F.from_utc_timestamp(ts, tz)
    minutes = ((F.unix_seconds(wall) - F.unix_seconds(ts)) / 60).cast("int")
    sign = F.when(minutes < 0, "-").otherwise("+")
    mag = F.abs(minutes)
    offset = F.format_string("%s%02d%02d", sign, F.floor(mag / 60).cast("int"), (mag % 60).cast("int"))
    return F.concat(F.date_format(wall, "yyyy-MM-dd'T'HH:mm:ss"), offset)  # NULL stays NULL


def iso_utc_micros(ts: Column, suffix: str = "+00:00") -> Column:
    """UTC text with microseconds when there are any."""
    whole = F.unix_micros(ts) % 1_000_000 == 0
    return F.concat(
        F.when(whole, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"))
        .otherwise(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")),
        F.lit(suffix),
    )


def hour_start(ts: Column) -> Column:
    return F.date_trunc("hour", ts)


def hour_end(hour: Column) -> Column:
    return hour + F.expr("INTERVAL '59:59' MINUTE TO SECOND")


def quarter_start(ts: Column) -> Column:
    return F.timestamp_seconds(F.floor(F.unix_seconds(ts) / 900) * 900)


def local_hour_start(ts: Column, tz: str) -> Column:
    """Hour truncation on the local wall clock, as an instant (matters for :30 zones)."""
    if tz == "UTC":
        return hour_start(ts)
    return F.to_utc_timestamp(F.date_trunc("hour", F.from_utc_timestamp(ts, tz)), tz)


def day_bounds(day: Column, tz: str = "UTC") -> tuple[Column, Column]:
    """First and last second of the day holding ``day``, as UTC instants."""
    if tz == "UTC":
        start = F.date_trunc("day", day)
        return start, start + F.expr("INTERVAL '23:59:59' HOUR TO SECOND")
    wall = F.date_trunc("day", F.from_utc_timestamp(day, tz))
    end = wall + F.expr("INTERVAL '23:59:59' HOUR TO SECOND")
    return F.to_utc_timestamp(wall, tz), F.to_utc_timestamp(end, tz)


def seconds(ts: Column) -> Column:
    """Epoch seconds as DOUBLE, microsecond exact."""
    return F.unix_micros(ts) / F.lit(1e6)


def add_seconds(ts: Column, s: float) -> Column:
    return F.timestamp_micros(F.unix_micros(ts) + F.lit(int(round(s * 1_000_000))))


def in_window(ts: Column, start: Column, end: Column) -> Column:
    """Inclusive at both ends."""
    return ts.between(start, end)
