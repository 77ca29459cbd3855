"""One function per data question of the service, composed from the operators.

Each takes the normalized readings and returns a DataFrame shaped like the answer: plain records, or one
row with an envelope around at most 24 hourly records or one page.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aneroid.functions.times import date_label
from aneroid.operators.aggregates import hourly_average
from aneroid.operators.filters import at_point, chosen_day, drop_sentinel, in_box, in_country
from aneroid.operators.location_index import lookup_location
from aneroid.operators.paging import page_envelope, sample
from aneroid.operators.series import first_per_bucket, first_per_hour
from aneroid.operators.sinks import with_envelope
from aneroid.schema import LISTING_COLUMNS, PLACE_COLUMNS

Date = dt.date | str | None


# dashboard


def sensor_data_temp_timestamp(df: DataFrame) -> DataFrame:
    """First temperature of each of the newest 50 hours."""
    return first_per_bucket(df, "hour", ["temp"], descending=True, n=50).select("temp", "hour")


def temperature_vs_hourly_data_experimental(df: DataFrame) -> DataFrame:
    """First temperature of each of the newest 100 hours."""
    return first_per_bucket(df, "hour", ["temp"], descending=True, n=100).select("temp", "hour")


def comparative_temp_humidity(df: DataFrame) -> DataFrame:
    """First temperature and humidity of each of the oldest 50 days."""
    return first_per_bucket(df, "day", ["temp", "humidity"], n=50)


def comparative_temp_pressure(df: DataFrame) -> DataFrame:
    """First temperature and pressure of each of the oldest 50 days."""
    return first_per_bucket(df, "day", ["temp", "pressure"], n=50)


def temperature_vs_daily_data(df: DataFrame, among: int | None = None) -> DataFrame:
    """First temperature of each of the oldest 50 days of processing.

    Over the whole table, or over the ``among`` readings processed first.
    """
    rows = df if among is None else df.orderBy(F.col("processed_at").asc_nulls_last(), "id").limit(among)
    return first_per_bucket(rows, "day", ["temp"], ts_col="processed_at", n=50)


def temperature_vs_hourly_data_debug(df: DataFrame) -> DataFrame:
    """Newest date with known places, and the first reading per hour of the newest date of all."""
    date = date_label(chosen_day(drop_sentinel(df), None))
    return with_envelope(first_per_hour(df, ["temp"], with_date="label"), "temp_hourly", date=date)


def temperature_vs_hourly_data(df: DataFrame, date: Date = None) -> DataFrame:
    """First temperature per hour of a date, unknown places included."""
    return with_envelope(
        first_per_hour(df, ["temp"], date), "temp_hourly", date=date_label(chosen_day(df, date))
    )


def temperature_vs_hourly_single_date(df: DataFrame, date: Date = None) -> DataFrame:
    """First reading per hour of a date, known places only."""
    meta = F.struct(date_label(chosen_day(drop_sentinel(df), date)).alias("date"))
    rows = first_per_hour(df, ["temp"], date, known_places=True, with_date="date")
    return with_envelope(rows, "records", meta=meta)


def temperature_humidity_hourly_data(df: DataFrame, date: Date = None) -> DataFrame:
    """Mean temperature and humidity per hour of a date, two decimals, known places only."""
    meta = F.struct(date_label(chosen_day(drop_sentinel(df), date)).alias("date"))
    return with_envelope(hourly_average(df, date, digits=2), "records", meta=meta)


# client


def current_sensor_data(df: DataFrame) -> DataFrame:
    return sample(df, LISTING_COLUMNS, 50)


def sensor_data_page(df: DataFrame, offset: int = 0, limit: int = 50) -> DataFrame:
    return page_envelope(df, offset, limit)


def sensor_data(df: DataFrame, n: int = 5) -> DataFrame:
    return sample(df, PLACE_COLUMNS, n)


def sensor_data_by_lat_lon(df: DataFrame, lat: float | str, lon: float | str) -> DataFrame:
    return sample(at_point(df, lat, lon), PLACE_COLUMNS, 5)


def sensor_data_by_lat_lon_indexed(
    spark: SparkSession, index: str, lat: float | str, lon: float | str
) -> DataFrame:
    return lookup_location(spark, index, lat, lon, n=5).select(*PLACE_COLUMNS)


def sensor_data_by_lat_lon_range(
    df: DataFrame, min_lat: float | str, max_lat: float | str, min_lon: float | str, max_lon: float | str
) -> DataFrame:
    return sample(in_box(df, min_lat, max_lat, min_lon, max_lon), PLACE_COLUMNS, 10)


def sensor_data_by_country(df: DataFrame, country: str, state: str | None = None) -> DataFrame:
    return sample(in_country(df, country, state), PLACE_COLUMNS, 5)
