"""Results as JSON records and envelopes, and the stored form of the readings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aneroid.schema import DAY

# Missing values are written as null, and instants with all six digits of their fraction.
JSON_OPTIONS = {"ignoreNullFields": "false", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def json_records(df: DataFrame) -> DataFrame:
    """Every row as one JSON object, in column ``record``."""
    return df.select(F.to_json(F.struct("*"), JSON_OPTIONS).alias("record"))


def write_records(df: DataFrame, path: str) -> None:
    """Every row as one line of JSON."""
    df.write.mode("errorifexists").options(**JSON_OPTIONS).json(path)


def with_envelope(rows: DataFrame, name: str, **fields: Column) -> DataFrame:
    """One row: the records as a sorted array, and further fields such as the date they belong to.

    For series of one day: at most one record per hour. The records must lead with their sort column.
    """
    records = F.sort_array(F.collect_list(F.struct("*"))).alias(name)
    return rows.agg(records).select(*[v.alias(k) for k, v in fields.items()], name)


def preview(df: DataFrame, n: int = 5) -> None:
    df.show(n, truncate=False)


def write_readings(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Store normalized readings by calendar date, the layout in which date filters skip files.

    The rebalance hint sizes the output: a day with a third of all readings is split over many tasks
    and files, small days share one task. Readings without a timestamp go to the null partition.
    """
    _write_by_day(df, path, fmt, "errorifexists")


def append_readings(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Add readings to those stored at ``path``, in files of their own."""
    _write_by_day(df, path, fmt, "append")


def _write_by_day(df: DataFrame, path: str, fmt: str, mode: str) -> None:
    dated = df.withColumn(DAY, F.to_date("timestamp"))
    dated.hint("rebalance", F.col(DAY)).write.mode(mode).partitionBy(DAY).format(fmt).save(path)
