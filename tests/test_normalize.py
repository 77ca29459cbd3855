from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from aneroid.schema import SENSOR_SCHEMA
from aneroid.sources.normalize import normalize

GOOD = ["2025-02-21 01:10:00.874345", "2025-02-21 01:10:00.87", "2025-02-21 01:10:00", None]
BAD = ["bad", "2025-02-21", "2025-02-21T01:10:00", "2025-02-30 01:10:00", "2025-02-21 01:10:00Z", ""]


def frame(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, timestamp string")


def test_timestamps_with_and_without_fraction(spark):
    rows = normalize(frame(spark, GOOD)).orderBy("id").collect()
    at = dt.datetime(2025, 2, 21, 1, 10)
    assert [r.timestamp for r in rows] == [
        at.replace(microsecond=874345), at.replace(microsecond=870000), at, None,
    ]


@pytest.mark.parametrize("text", BAD)
@pytest.mark.parametrize("ansi", ["true", "false"])
def test_strict_fails_and_permissive_gives_null(spark, text, ansi):
    spark.conf.set("spark.sql.ansi.enabled", ansi)
    try:
        df = frame(spark, [GOOD[0], text])
        with pytest.raises(Exception, match="malformed timestamp"):
            normalize(df).select("timestamp").collect()
        rows = normalize(df, mode="permissive").orderBy("id").collect()
        assert rows[0].timestamp is not None and rows[1].timestamp is None
    finally:
        spark.conf.unset("spark.sql.ansi.enabled")


def test_declared_schema_whatever_the_source(spark):
    df = spark.createDataFrame([("a-1", "21.5", 97062, 9)], "id string, temp string, postal_code int, extra int")
    out = normalize(df)
    assert out.columns == [f.name for f in SENSOR_SCHEMA.fields]
    assert dict(out.dtypes)["id"] == "string" and dict(out.dtypes)["timestamp"] == "timestamp_ntz"
    row = out.first()
    assert (row.id, row.temp, row.postal_code, row.humidity) == ("a-1", 21.5, "97062", None)


def test_permissive_values(spark):
    df = spark.createDataFrame([("x",)], "temp string")
    assert normalize(df, mode="permissive").first().temp is None
    with pytest.raises(ValueError):
        normalize(df, mode="lenient")


def test_parsing_ignores_the_session_zone(spark):
    """02:30 does not exist in this zone on that day."""
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        row = normalize(frame(spark, ["2025-03-09 02:30:00"])).select(F.col("timestamp")).first()
        assert row.timestamp == dt.datetime(2025, 3, 9, 2, 30)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


@pytest.mark.parametrize("ansi", ["true", "false"])
def test_strict_means_every_value(spark, ansi):
    spark.conf.set("spark.sql.ansi.enabled", ansi)
    try:
        for column, value in (("temp", "abc"), ("sats", "1.5x"), ("lat", "north")):
            df = spark.createDataFrame([(1, value)], f"id long, {column} string")
            with pytest.raises(Exception, match="malformed"):
                normalize(df).collect()
        df = spark.createDataFrame([(1, "2.5", None)], "id long, temp string, lat string")
        row = normalize(df).first()
        assert (row.temp, row.lat) == (2.5, None)
    finally:
        spark.conf.unset("spark.sql.ansi.enabled")


@pytest.mark.parametrize("session", ["UTC", "America/New_York", "Asia/Kolkata"])
def test_zoned_timestamps_do_not_follow_the_session(spark, session):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", session)
    try:
        df = spark.sql("SELECT 1L AS id, timestamp '2024-01-15 00:30:00.000001Z' AS timestamp, date '2020-01-01' AS reading_date")
        row = normalize(df).first()
        assert row.timestamp == dt.datetime(2024, 1, 15, 0, 30, 0, 1) and row.reading_date == dt.date(2024, 1, 15)
        assert normalize(df, zone="Asia/Tokyo").first().timestamp == dt.datetime(2024, 1, 15, 9, 30, 0, 1)
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
