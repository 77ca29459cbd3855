"""Row filters. All are plain predicates, so they reach the scan; date filters prune files when the
readings are stored by ``reading_date``.

A range on a TIMESTAMP_NTZ column is listed under PushedFilters but skips no Parquet row group (Spark
only translates UTC-adjusted timestamps), while one on a DATE column does. That is why the stored layout
carries the date.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aneroid.functions.times import instant, parse_date
from aneroid.operators.day_summary import newest_day
from aneroid.schema import DAY, SENTINEL_POSTAL_CODE

ONE_DAY = dt.timedelta(days=1)


def drop_sentinel(df: DataFrame) -> DataFrame:
    """Rows with a known postal code. A NULL code is not known."""
    return df.where(F.col("postal_code") != SENTINEL_POSTAL_CODE)


def day_of(df: DataFrame, ts_col: str = "timestamp") -> Column:
    """Calendar date of a reading: the stored column if there is one."""
    return F.col(DAY) if ts_col == "timestamp" and DAY in df.columns else F.to_date(ts_col)


def latest_date(df: DataFrame) -> Column:
    """The newest date in ``df`` as a scalar subquery: evaluated inside the job that uses it.

    DATE when the readings are stored by date, else its midnight, which compares with the timestamps
    without a conversion per row.
    """
    newest = F.max(DAY) if DAY in df.columns else F.max("timestamp").cast("date").cast("timestamp_ntz")
    return df.agg(newest).scalar()


def chosen_day(
    df: DataFrame, date: dt.date | str | None, days: DataFrame | None = None, known_places: bool = False
) -> Column:
    """The date asked for, or the newest one in ``df``, in the form ``on_day`` takes.

    With ``days``, the summary of readings stored by date, the newest one is taken from there.
    """
    if date is None and days is not None:
        return newest_day(days, known_places)
    if date is None:
        return latest_date(drop_sentinel(df) if known_places else df)
    day = F.lit(parse_date(date))
    return day if DAY in df.columns else day.cast("timestamp_ntz")


def on_day(df: DataFrame, day: Column) -> DataFrame:
    """Rows of one calendar date, given as ``chosen_day`` returns it. A reading without a time is in none."""
    ts = F.col("timestamp")
    if DAY in df.columns:
        return df.where((F.col(DAY) == day) & ts.isNotNull())
    return df.where((ts >= day) & (ts < day + F.expr("interval '1' day")))


def on_date(df: DataFrame, date: dt.date | str) -> DataFrame:
    day = parse_date(date)
    return between_dates(df, day, day)


def rows_of_day(
    df: DataFrame, date: dt.date | str | None, known_places: bool, days: DataFrame | None = None
) -> DataFrame:
    """Rows of a date, by default the newest (found in ``days``, if given).

    ``known_places`` leaves out unknown postal codes: they do not count for the newest date either. The
    date is tested first, being the cheaper and narrower of the two.
    """
    rows = on_day(df, chosen_day(df, date, days, known_places))
    return drop_sentinel(rows) if known_places else rows


def on_latest_date(df: DataFrame, drop_sentinel_first: bool) -> DataFrame:
    """Rows of the newest date; with ``drop_sentinel_first`` unknown places neither count nor stay."""
    return rows_of_day(df, None, drop_sentinel_first)


def between_dates(df: DataFrame, first: dt.date | str, last: dt.date | str) -> DataFrame:
    """Whole days ``first`` to ``last``, both included."""
    first, last = parse_date(first), parse_date(last)
    if DAY in df.columns:
        return df.where(F.col(DAY).between(F.lit(first), F.lit(last)) & F.col("timestamp").isNotNull())
    ts = F.col("timestamp")
    return df.where((ts >= instant(first)) & (ts < instant(last + ONE_DAY)))


def between_instants(df: DataFrame, first: dt.datetime | str, last: dt.datetime | str) -> DataFrame:
    """Instants ``first`` to ``last``, both included."""
    start, end = instant(first), instant(last)
    rows = df.where(F.col("timestamp").between(start, end))
    return rows.where(F.col(DAY).between(F.to_date(start), F.to_date(end))) if DAY in df.columns else rows


def at_point(df: DataFrame, lat: float | str, lon: float | str) -> DataFrame:
    return df.where((F.col("lat") == float(lat)) & (F.col("lon") == float(lon)))


def in_box(
    df: DataFrame, min_lat: float | str, max_lat: float | str, min_lon: float | str, max_lon: float | str
) -> DataFrame:
    """Bounding box, edges included. Bounds may arrive as text."""
    return df.where(
        F.col("lat").between(float(min_lat), float(max_lat)) & F.col("lon").between(float(min_lon), float(max_lon))
    )


def in_country(df: DataFrame, country: str, state: str | None = None) -> DataFrame:
    rows = df.where(F.col("country") == country)
    return rows if state is None else rows.where(F.col("state") == state)


def with_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows in which every key column has a value."""
    return df.dropna(subset=keys)
