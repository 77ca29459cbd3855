"""Averages, extremes, counts and distinct dates.

Every aggregate is a partial and final hash aggregate over fixed-width keys: a task ships one row per
bucket it has seen, however many readings a hot bucket holds.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aneroid.functions.rounding import rounded_avg
from aneroid.functions.times import GRAINS, bucket_keys, bucket_value, date_label, hour_label
from aneroid.operators.filters import (
    between_dates,
    between_instants,
    day_of,
    drop_sentinel as without_sentinel,
    on_date,
    rows_of_day,
)


def _avg(metric: str, digits: int | None) -> Column:
    return F.avg(metric) if digits is None else rounded_avg(F.col(metric), digits)


def _key_names(keys: list[Column]) -> list[str]:
    return [f"key{i}" for i in range(len(keys))]


def average_by(
    df: DataFrame,
    grain: str,
    metrics: list[str],
    start: dt.date | dt.datetime | str | None = None,
    end: dt.date | dt.datetime | str | None = None,
    drop_sentinel: bool = True,
    digits: int | None = None,
) -> DataFrame:
    """Average of each metric per bucket, as ``avg_<metric>``, in bucket order.

    ``grain`` is ``all`` (one row) or a calendar grain. Dates bound the range by whole days, datetimes
    by instants; both ends are included. Readings without a timestamp form a NULL bucket.
    """
    if (start is None) != (end is None):
        raise ValueError("give both start and end, or neither")
    rows = without_sentinel(df) if drop_sentinel else df
    if start is not None:
        instants = isinstance(start, dt.datetime) or isinstance(end, dt.datetime)
        rows = (between_instants if instants else between_dates)(rows, start, end)
    averages = [_avg(m, digits).alias(f"avg_{m}") for m in metrics]
    if grain == "all":
        return rows.agg(*averages)
    keys = bucket_keys(F.col("timestamp"), grain, day_of(df))
    names = _key_names(keys)
    label = GRAINS[grain][0]
    grouped = rows.groupBy(*[k.alias(n) for k, n in zip(keys, names)]).agg(*averages)
    value = bucket_value([F.col(n) for n in names], grain).alias(label)
    return grouped.select(value, *[f"avg_{m}" for m in metrics]).orderBy(F.col(label).asc_nulls_last())


def hourly_average(
    df: DataFrame, date: dt.date | str | None = None, digits: int | None = None, days: DataFrame | None = None
) -> DataFrame:
    """Mean temperature and humidity per hour of one date, by default the newest with a known place."""
    return (
        rows_of_day(df, date, known_places=True, days=days)
        .groupBy(F.hour("timestamp").alias("h"))
        .agg(_avg("temp", digits).alias("temperature"), _avg("humidity", digits).alias("humidity"))
        .orderBy("h")
        .select(hour_label(F.col("h")).alias("hour"), "temperature", "humidity")
    )


def extreme(
    df: DataFrame, metric: str, how: str, date: dt.date | str | None = None, drop_sentinel: bool = False
) -> DataFrame:
    """One row with the largest (``max``) or smallest (``min``) value, as ``<how>_<metric>``."""
    if how not in ("max", "min"):
        raise ValueError(f"how must be 'max' or 'min', not {how!r}")
    rows = without_sentinel(df) if drop_sentinel else df
    rows = rows if date is None else on_date(rows, date)
    return rows.agg((F.max if how == "max" else F.min)(metric).alias(f"{how}_{metric}"))


def distinct_dates(df: DataFrame, n: int | None = 50, drop_sentinel: bool = False) -> DataFrame:
    """The newest ``n`` dates with readings as ``YYYY-MM-DD`` labels, newest first; ``None`` for all."""
    rows = without_sentinel(df) if drop_sentinel else df
    days = rows.select(day_of(df).alias("day")).distinct().orderBy(F.col("day").desc_nulls_last())
    days = days if n is None else days.limit(n)
    return days.select(date_label(F.col("day")).alias("date"))


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("total"))
