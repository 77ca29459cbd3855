"""The registered queries: every operator over the whole of the given tables."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aneroid.operators import aggregates, filters, paging, series, sinks
from aneroid.operators import day_summary, hour_partials
from aneroid.operators.adhoc import run_sql
from aneroid.operators.box_index import build_box_index, lookup_box
from aneroid.operators.location_index import (
    build_location_index, compact_location_index, lookup_location, read_location_index,
)
from aneroid.plans import endpoints
from aneroid.plans.readings import hard_readings, readings, readings_stream
from aneroid.scratch import scratch_path
from aneroid.schema import LISTING_COLUMNS, LOCATION_COLUMNS, PLACE_COLUMNS
from aneroid.sources.normalize import normalize
from aneroid.streaming.location_upkeep import maintain_location_index

DATE = "2024-01-15"
RANGE = ("2024-01-10", "2024-01-15")
INSTANTS = (dt.datetime(2024, 1, 10, 6), dt.datetime(2024, 1, 15, 18))
POINT = (-58.0, -170.0)
BOX = (-10.0, 10.0, -50.0, 50.0)

ADHOC = """
    WITH daily AS (
        SELECT CAST(timestamp AS DATE) AS day, state, AVG(temp) AS avg_temp, COUNT(*) AS n
        FROM sensor_data
        WHERE country = :country
        GROUP BY day, state
    ),
    latest AS (SELECT MAX(day) AS day FROM daily)
    SELECT state, avg_temp, n FROM daily WHERE day = (SELECT day FROM latest) ORDER BY state;
"""

LABELLED = """
    WITH days AS (
        SELECT strftime(timestamp, '%Y-%m-%d') AS day, max(humidity) AS wettest
        FROM sensor_data WHERE postal_code <> '00000' GROUP BY day
    ),
    wet AS (SELECT day FROM days WHERE wettest = (SELECT max(wettest) FROM days))
    SELECT strftime(timestamp, '%d.%m.%y %H:00 (%j, 100 %%)') AS label, strftime(timestamp, '%H:%M:%S.%f') AS moment,
           country, temp
    FROM sensor_data WHERE strftime(timestamp, '%Y-%m-%d') IN (SELECT day FROM wet) ORDER BY label, moment;
"""


def _parsed(df: DataFrame) -> DataFrame:
    """Both time columns written as text and parsed back strictly."""
    texts = {c: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS") for c in ("timestamp", "processed_at")}
    return normalize(df.withColumns(texts)).select("id", "timestamp", "processed_at")


def _index(spark: SparkSession, df: DataFrame) -> str:
    path = scratch_path(spark, "location-index")
    build_location_index(df, path)
    return path


def _box_index(spark: SparkSession, df: DataFrame) -> str:
    path = scratch_path(spark, "box-index")
    build_box_index(df, path)
    return path


def _streamed_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "location-index")
    checkpoint = scratch_path(spark, "location-upkeep")
    maintain_location_index(readings_stream(spark, sf_dir), path, checkpoint).awaitTermination()
    return read_location_index(spark, path).select(*LOCATION_COLUMNS)


def _compacted_index(spark: SparkSession, sf_dir: str) -> str:
    """Built from a half of the readings, streamed in many batches from the rest, compacted on the way."""
    path, feed = scratch_path(spark, "location-index"), scratch_path(spark, "location-feed")
    checkpoint, rows = scratch_path(spark, "location-upkeep"), readings(spark, sf_dir)
    build_location_index(rows.where("id % 2 = 0"), path)
    for part in range(2):
        rows.where(f"id % 4 = {2 * part + 1}").repartition(4).write.mode("append").parquet(feed)
        stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(feed)
        maintain_location_index(stream, path, checkpoint).awaitTermination()
        if part == 0:
            compact_location_index(spark, path)
    return path


def _stored(spark: SparkSession, df: DataFrame) -> DataFrame:
    path = scratch_path(spark, "readings")
    sinks.write_readings(df, path)
    return spark.read.parquet(path)


def _beside(spark: SparkSession, sf_dir: str, hard: bool, write: Callable, extend: Callable) -> tuple[str, str]:
    """Stored readings and a summary beside them, both made in two steps."""
    rows, summary = (hard_readings if hard else readings)(spark, sf_dir), scratch_path(spark, "summary")
    path = scratch_path(spark, "readings")
    late = F.coalesce(F.dayofmonth("timestamp") > 20, F.lit(True))
    sinks.write_readings(rows.where(~late), path)
    write(spark, path, summary)
    sinks.append_readings(rows.where(late), path)
    extend(spark, path, summary)
    return path, summary


def _summarized(use: Callable[[DataFrame, DataFrame], DataFrame], hard: bool = False) -> Callable[[SparkSession, str], DataFrame]:
    """A query over stored readings and the summary of their days."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        made = _beside(spark, sf_dir, hard, day_summary.write_day_summary, day_summary.extend_day_summary)
        return use(spark.read.parquet(made[0]), day_summary.read_day_summary(spark, *made))

    return query


def _folded(use: Callable[[DataFrame, DataFrame], DataFrame], hard: bool = False) -> Callable[[SparkSession, str], DataFrame]:
    """A query over the hour partials of stored readings; the readings are at hand for the edges of a range."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        made = _beside(spark, sf_dir, hard, hour_partials.write_hour_partials, hour_partials.extend_hour_partials)
        return use(hour_partials.read_hour_partials(spark, *made), spark.read.parquet(made[0]))

    return query


# Queries over the readings alone.
OVER_READINGS: dict[str, Callable[[DataFrame], DataFrame]] = {
    # hourly averages
    "hourly_avg_latest": aggregates.hourly_average,
    "hourly_avg_on_date": lambda df: aggregates.hourly_average(df, DATE),
    "hourly_avg_latest_rounded": lambda df: aggregates.hourly_average(df, digits=2),
    # first reading per bucket
    "first_temp_per_hour_top50": endpoints.sensor_data_temp_timestamp,
    "first_temp_per_hour_top100": endpoints.temperature_vs_hourly_data_experimental,
    "first_temp_humidity_per_day": endpoints.comparative_temp_humidity,
    "first_temp_pressure_per_day": endpoints.comparative_temp_pressure,
    "first_temp_per_day_processed_at": endpoints.temperature_vs_daily_data,
    "first_per_hour_latest": lambda df: series.first_per_hour(df, ["temp"], with_date="label"),
    "first_per_hour_on_date": lambda df: series.first_per_hour(df, ["temp"], DATE),
    "first_per_hour_latest_filtered": lambda df: series.first_per_hour(
        df, ["temp"], known_places=True, with_date="date"
    ),
    "first_per_hour_all": lambda df: series.first_per_bucket(df, "hour", ["temp", "humidity", "pressure"]),
    # readings of a day
    "latest_day_rows": series.day_rows,
    "hour_rows_on_date": lambda df: series.hour_rows(df, DATE),
    "dated_rows_on_date": lambda df: series.dated_rows(df, DATE),
    # calendar averages and extremes
    "avg_all": lambda df: aggregates.average_by(df, "all", ["temp"], drop_sentinel=False),
    "avg_on_date": lambda df: aggregates.average_by(df, "all", ["temp"], DATE, DATE, drop_sentinel=False),
    "min_on_date": lambda df: aggregates.extreme(df, "temp", "min", DATE),
    "max_on_date": lambda df: aggregates.extreme(df, "temp", "max", DATE),
    "avg_by_date_on_date": lambda df: aggregates.average_by(df, "date", ["temp"], DATE, DATE),
    "avg_by_date_range": lambda df: aggregates.average_by(df, "date", ["temp"], *RANGE),
    "avg_by_instant_range": lambda df: aggregates.average_by(df, "date", ["temp"], *INSTANTS, drop_sentinel=False),
    "avg_by_hour_of_day": lambda df: aggregates.average_by(
        df, "hour_of_day", ["temp"], DATE, DATE, drop_sentinel=False
    ),
    "avg_by_hour_range": lambda df: aggregates.average_by(df, "hour", ["temp"], *RANGE),
    "avg_by_day": lambda df: aggregates.average_by(df, "day", ["temp", "humidity"]),
    "avg_by_week": lambda df: aggregates.average_by(df, "week", ["temp"]),
    "avg_by_month": lambda df: aggregates.average_by(df, "month", ["temp"]),
    "avg_by_year": lambda df: aggregates.average_by(df, "year", ["temp"]),
    "distinct_dates_top50": aggregates.distinct_dates,
    "distinct_dates_known_places": lambda df: aggregates.distinct_dates(df, None, drop_sentinel=True),
    "row_count": aggregates.row_count,
    # samples, pages and lookups
    "known_places": filters.drop_sentinel,
    "sample_recent": lambda df: paging.sample(df, LISTING_COLUMNS, 50),
    "sample_drawn": lambda df: paging.draw(df, LISTING_COLUMNS, 500, seed=7),
    "page": paging.page,
    "page_offset": lambda df: paging.page(df, 120, 40),
    "page_deep": lambda df: paging.page(df, 700, 200, top_k=100),
    "page_after": lambda df: paging.page_after(
        df, {"timestamp": dt.datetime(2024, 1, 20, 12), "id": 0}, served=0, limit=100, beyond=True
    ),
    "page_envelope": lambda df: paging.page_envelope(df, 10, 25).withColumn(
        "sensor_data", F.to_json("sensor_data", sinks.JSON_OPTIONS)
    ),
    "point_lookup": lambda df: filters.at_point(df, *POINT).select(*PLACE_COLUMNS),
    "bounding_box": lambda df: filters.in_box(df, *BOX).select(*PLACE_COLUMNS),
    "bounding_box_top10": lambda df: endpoints.sensor_data_by_lat_lon_range(df, *map(str, BOX)),
    "by_country": lambda df: filters.in_country(df, "US").select(*PLACE_COLUMNS),
    "by_country_state": lambda df: filters.in_country(df, "US", "error").select(*PLACE_COLUMNS),
    # parsing, SQL and JSON
    "strict_timestamps": _parsed,
    "adhoc_sql": lambda df: run_sql(df.sparkSession, df, ADHOC, {"country": "CA"}),
    "adhoc_sql_labels": lambda df: run_sql(df.sparkSession, df, LABELLED),
    "json_records": lambda df: sinks.json_records(df.select("id", "device_id", "temp", "humidity", "timestamp")),
    "hourly_avg_envelope": lambda df: endpoints.temperature_humidity_hourly_data(df).select(
        F.col("meta.date").alias("date"), F.to_json("records", sinks.JSON_OPTIONS).alias("records")
    ),
    "first_per_hour_envelope": lambda df: endpoints.temperature_vs_hourly_data(df).select(
        "date", F.to_json("temp_hourly", sinks.JSON_OPTIONS).alias("temp_hourly")
    ),
    "first_per_hour_debug_envelope": lambda df: endpoints.temperature_vs_hourly_data_debug(df).select(
        "date", F.to_json("temp_hourly", sinks.JSON_OPTIONS).alias("temp_hourly")
    ),
    "single_date_envelope": lambda df: endpoints.temperature_vs_hourly_single_date(df).select(
        F.col("meta.date").alias("date"), F.to_json("records", sinks.JSON_OPTIONS).alias("records")
    ),
}

# Queries that take the newest date, counts and dates from the summary of the stored days.
SUMMARIZED: dict[str, Callable[[DataFrame, DataFrame], DataFrame]] = {
    "hourly_avg_latest": lambda df, days: aggregates.hourly_average(df, days=days),
    "first_per_hour_latest": lambda df, days: series.first_per_hour(df, ["temp"], with_date="label", days=days),
    "latest_day_rows": lambda df, days: series.day_rows(df, days=days),
    "distinct_dates_top50": lambda df, days: day_summary.dates(days),
    "distinct_dates_known_places": lambda df, days: day_summary.dates(days, None, known_places=True),
    "row_count": lambda df, days: day_summary.counted_rows(days),
    "page": lambda df, days: paging.page(df, days=days),
}

# Queries that fold the stored partial aggregates of hours.
FOLDED: dict[str, Callable[[DataFrame, DataFrame], DataFrame]] = {
    "hourly_avg_latest": lambda parts, df: hour_partials.hourly_average(parts),
    "hourly_avg_latest_rounded": lambda parts, df: hour_partials.hourly_average(parts, digits=2),
    "avg_all": lambda parts, df: hour_partials.average_by(parts, "all", ["temp"], drop_sentinel=False),
    "avg_by_instant_range": lambda parts, df: hour_partials.average_by(
        parts, "date", ["temp"], *INSTANTS, drop_sentinel=False, readings=df
    ),
    "avg_by_hour_range": lambda parts, df: hour_partials.average_by(parts, "hour", ["temp"], *RANGE),
    "avg_by_day": lambda parts, df: hour_partials.average_by(parts, "day", ["temp", "humidity"]),
    "avg_by_week": lambda parts, df: hour_partials.average_by(parts, "week", ["temp"]),
    "max_on_date": lambda parts, df: hour_partials.extreme(parts, "temp", "max", DATE),
    "first_temp_per_hour_top50": lambda parts, df: hour_partials.first_per_bucket(parts, "hour", ["temp"], True, 50),
    "first_temp_humidity_per_day": lambda parts, df: hour_partials.first_per_bucket(
        parts, "day", ["temp", "humidity"], n=50
    ),
    "first_per_hour_latest_filtered": lambda parts, df: hour_partials.first_per_hour(
        parts, ["temp"], known_places=True, with_date="date"
    ),
}

# Queries that write something first: the location table in its forms, and the readings by date.
STORED: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "location_index": lambda spark, sf_dir: read_location_index(
        spark, _index(spark, readings(spark, sf_dir))
    ).select(*LOCATION_COLUMNS),
    "location_index_streamed": _streamed_index,
    "location_index_compacted": lambda spark, sf_dir: read_location_index(
        spark, _compacted_index(spark, sf_dir)
    ).select(*LOCATION_COLUMNS),
    "point_lookup_compacted": lambda spark, sf_dir: lookup_location(spark, _compacted_index(spark, sf_dir), *POINT),
    "point_lookup_indexed": lambda spark, sf_dir: lookup_location(
        spark, _index(spark, readings(spark, sf_dir)), *POINT
    ),
    "bounding_box_indexed": lambda spark, sf_dir: lookup_box(
        spark, _box_index(spark, readings(spark, sf_dir)), *BOX
    ).select(*PLACE_COLUMNS),
    "bounding_box_indexed_top10": lambda spark, sf_dir: endpoints.sensor_data_by_lat_lon_range(
        lookup_box(spark, _box_index(spark, readings(spark, sf_dir)), *BOX), *map(str, BOX)
    ),
    "stored_hourly_avg_latest": lambda spark, sf_dir: aggregates.hourly_average(
        _stored(spark, readings(spark, sf_dir))
    ),
    "stored_first_temp_per_hour_top50": lambda spark, sf_dir: endpoints.sensor_data_temp_timestamp(
        _stored(spark, readings(spark, sf_dir))
    ),
    "stored_page": lambda spark, sf_dir: paging.page(_stored(spark, readings(spark, sf_dir))),
}


def _over_readings(query: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: query(readings(spark, sf_dir))


def _over_hard_readings(query: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: query(hard_readings(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    **{name: _over_readings(query) for name, query in OVER_READINGS.items()},
    **{f"hard_{name}": _over_hard_readings(query) for name, query in OVER_READINGS.items()},
    **STORED,
    **{f"summary_{name}": _summarized(use) for name, use in SUMMARIZED.items()},
    **{f"hard_summary_{name}": _summarized(use, hard=True) for name, use in SUMMARIZED.items()},
    **{f"partials_{name}": _folded(use) for name, use in FOLDED.items()},
    **{f"hard_partials_{name}": _folded(use, hard=True) for name, use in FOLDED.items()},
}
