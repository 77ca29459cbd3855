"""Bring any source to the declared types of the sensor relation. Meant to run once, at ingest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aneroid.schema import DAY, SENSOR_SCHEMA, TIME_COLUMNS

# Fixed value: date, time and an optional fraction of a second. Digits past the sixth are cut.
TIMESTAMP_TEXT = r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}:\d{1,2}(\.\d{1,9})?$"


def parse_timestamp(raw: Column, mode: str = "strict") -> Column:
    """Text ``YYYY-MM-DD HH:MM:SS[.ffffff]`` to TIMESTAMP_NTZ.

    ``strict`` fails the query on the first malformed value whatever the session's ANSI setting;
    ``permissive`` turns it into NULL.
    """
    parsed = F.when(raw.rlike(TIMESTAMP_TEXT), raw.try_cast("timestamp_ntz"))
    if mode == "permissive":
        return parsed
    failure = F.raise_error(F.concat(F.lit("malformed timestamp: "), raw)).cast("timestamp_ntz")
    return F.coalesce(parsed, F.when(raw.isNotNull(), failure))


def in_zone(instant: Column, zone: str) -> Column:
    """A TIMESTAMP as the TIMESTAMP_NTZ that clocks in ``zone`` show then, whatever the session's zone."""
    exact = F.unix_micros(instant).cast("decimal(20,0)") / F.lit(1_000_000).cast("decimal(7,0)")
    utc = F.lit("1970-01-01").cast("timestamp_ntz") + F.make_dt_interval(
        F.lit(0), F.lit(0), F.lit(0), exact.cast("decimal(18,6)")
    )
    return utc if zone == "UTC" else F.convert_timezone(F.lit("UTC"), F.lit(zone), utc)


def _checked(name: str, to: T.DataType) -> Column:
    """A cast that fails on a value it can't convert, whatever the session's ANSI setting."""
    value = F.col(name).try_cast(to)
    text = F.concat(F.lit(f"malformed {name}: "), F.col(name).cast("string"))
    return F.coalesce(value, F.when(F.col(name).isNotNull(), F.raise_error(text)).cast(to))


def normalize(df: DataFrame, mode: str = "strict", zone: str = "UTC") -> DataFrame:
    """The declared columns with the declared types.

    Columns the source lacks come back as NULL, undeclared ones are dropped, and ``id`` keeps its own
    type when that is a string. ``strict`` fails on any value that its type can't hold, ``permissive`` makes
    it NULL. A zoned TIMESTAMP becomes what clocks in ``zone`` show. A stored ``reading_date`` is derived
    anew from the timestamp, so that both always agree.
    """
    if mode not in ("strict", "permissive"):
        raise ValueError(f"mode must be 'strict' or 'permissive', not {mode!r}")
    source = {f.name: f.dataType for f in df.schema.fields}

    if [(f.name, f.dataType) for f in SENSOR_SCHEMA.fields] == list(source.items()):
        return df

    def column(field: T.StructField) -> Column:
        name, have = field.name, source.get(field.name)
        if have is None:
            value = F.lit(None).cast(field.dataType)
        elif have == field.dataType or (name == "id" and isinstance(have, T.StringType)):
            return F.col(name)
        elif name in TIME_COLUMNS and isinstance(have, T.StringType):
            value = parse_timestamp(F.col(name), mode)
        elif name in TIME_COLUMNS and isinstance(have, T.TimestampType):
            value = in_zone(F.col(name), zone)
        elif mode == "permissive":
            value = F.col(name).try_cast(field.dataType)
        else:
            value = _checked(name, field.dataType)
        return value.alias(name)

    rows = df.select(*[column(f) for f in SENSOR_SCHEMA.fields])
    return rows.withColumn(DAY, F.to_date("timestamp")) if isinstance(source.get(DAY), T.DateType) else rows
