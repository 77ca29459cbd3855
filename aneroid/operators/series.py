"""First reading per calendar bucket, and the plain readings of one day.

``row_number() = 1`` is planned with a group limit before the shuffle, so each task ships at most one
row per bucket and no reducer sees the readings of a hot bucket.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aneroid.functions.times import GRAINS, bucket_keys, bucket_value, date_label, hour_label
from aneroid.operators.filters import day_of, drop_sentinel, on_date, rows_of_day
from aneroid.schema import DAY


def _first_rows(df: DataFrame, keys: dict[str, Column], columns: list[Column | str], ts_col: str) -> DataFrame:
    """``keys`` and ``columns`` of the row with the lowest (timestamp, id) of every key combination."""
    earliest = Window.partitionBy(*keys).orderBy(F.col("at").asc_nulls_last(), F.col("tie").asc_nulls_last())
    ranked = df.select(
        *[key.alias(name) for name, key in keys.items()], *columns, F.col(ts_col).alias("at"), F.col("id").alias("tie")
    ).withColumn("rn", F.row_number().over(earliest))
    return ranked.where(F.col("rn") == 1).drop("rn", "at", "tie")


def _in_first_buckets(df: DataFrame, grain: str, ts_col: str, descending: bool, n: int) -> DataFrame:
    """Only the readings that can be in the first ``n`` buckets of the order.

    Finding those buckets reads one column of the whole table (with stored dates no data column, though
    every file is opened and gives a row per reading); the rows to be ranked then come from those buckets
    alone. Readings without a
    timestamp sort last, so they stay only while there are fewer than ``n`` dated buckets.
    """
    stored_day = ts_col == "timestamp" and DAY in df.columns
    if stored_day and grain == "hour":
        # n hours lie within n days, and finding the days needs no data column
        df = _in_first_buckets(df, "day", ts_col, descending, n)
    ts = F.col(ts_col)
    if grain == "hour":
        key, start = F.window(ts, "1 hour").start, F.col("b")
    else:
        (key,) = bucket_keys(ts, grain, day_of(df, ts_col))
        start = F.col("b").cast("timestamp_ntz")
    order = F.col("b").desc_nulls_last() if descending else F.col("b").asc_nulls_last()
    wanted = df.select(key.alias("b")).distinct().orderBy(order).limit(n)
    found = wanted.agg(F.count("b")).scalar()
    if descending:
        edge = wanted.agg(F.min(start)).scalar()
        inside = ts >= edge
        inside_day = F.col(DAY) >= F.to_date(edge) if stored_day else None
    else:
        edge = wanted.agg(F.max(start) + F.expr(GRAINS[grain][1])).scalar()
        inside = ts < edge
        inside_day = F.col(DAY) <= F.to_date(edge) if stored_day else None
    if stored_day:
        return df.where((inside_day & inside) | (F.col(DAY).isNull() & (found < n)))
    return df.where(inside | (ts.isNull() & (found < n)))


def first_per_bucket(
    df: DataFrame,
    grain: str,
    values: list[str],
    ts_col: str = "timestamp",
    descending: bool = False,
    n: int | None = None,
) -> DataFrame:
    """Bucket start (named after the grain) and ``values`` of the earliest reading in each bucket.

    Buckets come oldest first, or newest first with ``descending``; ``n`` keeps the first ``n`` of them.
    Readings without a timestamp form a NULL bucket, last either way.
    """
    if grain == "hour_of_day":
        raise ValueError("hour_of_day is not a span of time")
    rows = df if n is None else _in_first_buckets(df, grain, ts_col, descending, n)
    keys = {f"key{i}": key for i, key in enumerate(bucket_keys(F.col(ts_col), grain, day_of(df, ts_col)))}
    firsts = _first_rows(rows, keys, values, ts_col)
    result = firsts.select(bucket_value([F.col(k) for k in keys], grain).alias(grain), *values)
    order = F.col(grain).desc_nulls_last() if descending else F.col(grain).asc_nulls_last()
    result = result.orderBy(order)
    return result if n is None else result.limit(n)


def first_per_hour(
    df: DataFrame,
    values: list[str],
    date: dt.date | str | None = None,
    known_places: bool = False,
    with_date: str | None = None,
    days: DataFrame | None = None,
) -> DataFrame:
    """Earliest reading of every hour of one date (default: the newest), by two-digit hour label.

    ``with_date`` adds the date in front: ``'label'`` as text, ``'date'`` as DATE. ``known_places``
    leaves out unknown postal codes, before the newest date is taken.
    """
    if with_date not in (None, "label", "date"):
        raise ValueError(f"with_date must be None, 'label' or 'date', not {with_date!r}")
    rows = rows_of_day(df, date, known_places, days)
    firsts = _first_rows(rows, {"h": F.hour("timestamp")}, [day_of(df).alias("date"), *values], "timestamp")
    firsts = firsts.orderBy("h")
    label = hour_label(F.col("h")).alias("hour")
    if with_date is None:
        return firsts.select(label, *values)
    shown = F.col("date") if with_date == "date" else date_label(F.col("date")).alias("date")
    return firsts.select(shown, label, *values)


def day_rows(df: DataFrame, date: dt.date | str | None = None, days: DataFrame | None = None) -> DataFrame:
    """Every reading of one date (default: the newest): date and hour labels, temperature, in hour order."""
    rows = rows_of_day(df, date, known_places=False, days=days)
    return (
        rows.select(day_of(df).alias("day"), F.hour("timestamp").alias("h"), "temp", "timestamp", "id")
        .orderBy("h", "timestamp", "id")
        .select(date_label(F.col("day")).alias("date"), hour_label(F.col("h")).alias("hour"), "temp")
    )


def hour_rows(df: DataFrame, date: dt.date | str, n: int = 50) -> DataFrame:
    """The first ``n`` readings of a date with a known place: integer hour and temperature."""
    return (
        drop_sentinel(on_date(df, date))
        .select(F.hour("timestamp").cast("bigint").alias("hour_start"), "temp", "timestamp", "id")
        .orderBy("hour_start", "timestamp", F.col("id").asc_nulls_last())
        .limit(n)
        .select("hour_start", "temp")
    )


def dated_rows(df: DataFrame, date: dt.date | str, n: int = 10) -> DataFrame:
    """The first ``n`` readings of a date with the date as a column of its own."""
    return (
        on_date(df, date)
        .orderBy("timestamp", F.col("id").asc_nulls_last())
        .limit(n)
        .select("temp", "timestamp", day_of(df).alias("formatted_timestamp"))
    )
