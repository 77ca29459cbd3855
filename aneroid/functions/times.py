"""Calendar buckets and labels for zone-less timestamps.

``date_trunc`` takes TIMESTAMP, so on TIMESTAMP_NTZ it converts through the session zone: slower, and
wrong around a daylight-saving gap. Everything here goes through ``to_date`` and ``hour`` instead, which
read NTZ directly.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

# grain -> (name of the bucket column in results, length of one bucket)
GRAINS = {
    "date": ("date", "interval '1' day"),
    "hour": ("hour_start", "interval '1' hour"),
    "day": ("day", "interval '1' day"),
    "week": ("week_start", "interval '7' day"),
    "month": ("month_start", "interval '1' month"),
    "year": ("year_start", "interval '1' year"),
    "hour_of_day": ("hour_start", None),
}

def check_grain(grain: str) -> None:
    if grain not in GRAINS:
        raise ValueError(f"unknown grain {grain!r}; expected one of {', '.join(GRAINS)}")


def bucket_keys(ts: Column, grain: str, day: Column | None = None) -> list[Column]:
    """Small fixed-width columns that identify the bucket: what to group or partition by.

    The bucket value itself is built from them by ``bucket_value`` once per group, not once per row.
    ``day`` is the calendar date of ``ts`` if it is already stored.
    """
    check_grain(grain)
    day = F.to_date(ts) if day is None else day
    if grain == "hour":
        return [day, F.hour(ts)]
    if grain == "hour_of_day":
        return [F.hour(ts)]
    if grain in ("date", "day"):
        return [day]
    return [F.trunc(day, grain)]


def bucket_value(keys: list[Column], grain: str) -> Column:
    """The bucket as DATE (``date``), BIGINT (``hour_of_day``) or TIMESTAMP_NTZ (the rest)."""
    check_grain(grain)
    if grain == "date":
        return keys[0]
    if grain == "hour_of_day":
        return keys[0].cast("bigint")
    start = keys[0].cast("timestamp_ntz")
    return start + F.make_dt_interval(hours=keys[1]) if grain == "hour" else start


def bucket(ts: Column | str, grain: str) -> Column:
    """Start of the calendar bucket ``ts`` falls into. Weeks start on Monday."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    return bucket_value(bucket_keys(ts, grain), grain)


def hour_label(hour: Column) -> Column:
    """Two-digit label of an integer hour; NULL stays NULL."""
    return F.lpad(hour.cast("string"), 2, "0")


def date_label(day: Column) -> Column:
    """``YYYY-MM-DD`` of a DATE or TIMESTAMP_NTZ."""
    return F.to_date(day).cast("string")


def parse_date(value: dt.date | str) -> dt.date:
    """A date argument, ``YYYY-MM-DD``; anything else is a ValueError."""
    if isinstance(value, dt.datetime):
        raise ValueError(f"expected a date, got the instant {value!r}")
    if isinstance(value, dt.date):
        return value
    return dt.datetime.strptime(value, "%Y-%m-%d").date()


def instant(value: dt.datetime | dt.date | str) -> Column:
    """A zone-less timestamp literal."""
    return F.lit(str(value)).cast("timestamp_ntz")
