"""A small aggregate beside the stored readings: what each file holds of each day.

One row per file and day: readings, those with a known place, first and last instant. The newest date, counts, dates
and the days of a page then come from this table, whose size goes with files and days, and not from the readings.

It is kept per file (see ``file_summary``), and refused when it is not of the files that are there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from aneroid.functions.times import date_label
from aneroid.operators import file_summary
from aneroid.schema import DAY, SENTINEL_POSTAL_CODE


def _per_file(readings: DataFrame, file: list[Column]) -> DataFrame:
    return readings.groupBy(*file, F.col(DAY).alias("day")).agg(
        F.count("*").alias("rows"),
        F.count_if(F.col("postal_code") != SENTINEL_POSTAL_CODE).alias("known"),
        F.min("timestamp").alias("first"),
        F.max("timestamp").alias("last"),
    )


def write_day_summary(spark: SparkSession, readings: str, path: str) -> None:
    """Summarize the readings that ``write_readings`` stored at ``readings`` into a new ``path``."""
    file_summary.write(spark, readings, path, _per_file)


def extend_day_summary(spark: SparkSession, readings: str, path: str) -> None:
    """Add the files that were written since, reading those alone."""
    file_summary.extend(spark, readings, path, _per_file)


def read_day_summary(spark: SparkSession, readings: str, path: str) -> DataFrame:
    """One row per day (NULL for readings without a time): ``day, rows, known, first, last``.

    Evaluating it fails when the summary doesn't fit the files in ``readings``.
    """
    return (
        file_summary.read(spark, readings, path, "day summary").groupBy("day")
        .agg(F.sum("rows").alias("rows"), F.sum("known").alias("known"), F.min("first").alias("first"), F.max("last").alias("last"))
    )


def newest_day(days: DataFrame, known_places: bool = False) -> Column:
    """The newest date with readings, or with readings of a known place, as a scalar subquery over the summary."""
    counted = days.where(F.col("known") > 0) if known_places else days
    return counted.agg(F.max("day")).scalar()


def counted_rows(days: DataFrame) -> DataFrame:
    return days.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("total"))


def dates(days: DataFrame, n: int | None = 50, known_places: bool = False) -> DataFrame:
    """The newest ``n`` dates as labels, newest first."""
    found = (days.where(F.col("known") > 0) if known_places else days).orderBy(F.col("day").desc_nulls_last())
    return (found if n is None else found.limit(n)).select(date_label(F.col("day")).alias("date"))
