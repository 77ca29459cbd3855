"""The summary of stored days: what it holds, when it is refused, and that its uses open no reading."""

from __future__ import annotations

import re

import pytest
from plans import plan_text
from pyspark.sql import functions as F

from aneroid.operators import aggregates, day_summary, paging, series
from aneroid.operators.sinks import append_readings, write_readings


@pytest.fixture()
def place(make, spark, tmp_path):
    rows = make(
        {"timestamp": "2025-02-20 01:00:00"},
        {"timestamp": "2025-02-20 03:00:00", "postal_code": "00000"},
        {"timestamp": "2025-02-21 01:00:00", "postal_code": "00000"},
        {"timestamp": None, "postal_code": None},
    )
    readings, summary = str(tmp_path / "r"), str(tmp_path / "s")
    write_readings(rows, readings)
    day_summary.write_day_summary(spark, readings, summary)
    return readings, summary


def days_of(spark, place):
    return {str(r.day): (r.rows, r.known) for r in day_summary.read_day_summary(spark, *place).collect()}


def test_days(spark, place):
    assert days_of(spark, place) == {"2025-02-20": (2, 1), "2025-02-21": (1, 0), "None": (1, 0)}
    days = day_summary.read_day_summary(spark, *place)
    newest = spark.range(1).select(day_summary.newest_day(days).cast("string"), day_summary.newest_day(days, True).cast("string"))
    assert tuple(newest.first()) == ("2025-02-21", "2025-02-20")
    first = days.where("day = DATE '2025-02-20'").select(F.col("first").cast("string"), F.col("last").cast("string")).first()
    assert tuple(first) == ("2025-02-20 01:00:00", "2025-02-20 03:00:00")


def test_new_files_are_refused_until_they_are_added(spark, make, place):
    append_readings(make({"timestamp": "2025-02-20 05:00:00"}, {"timestamp": "2025-02-22 05:00:00"}), place[0])
    with pytest.raises(Exception, match="day summary is not of these files"):
        days_of(spark, place)
    for _ in range(2):  # adding what is there already changes nothing
        day_summary.extend_day_summary(spark, *place)
        assert days_of(spark, place) == {
            "2025-02-20": (3, 2), "2025-02-21": (1, 0), "2025-02-22": (1, 1), "None": (1, 0)
        }


def test_removed_files_are_refused(spark, place, tmp_path):
    next((tmp_path / "r" / "reading_date=2025-02-21").glob("*.parquet")).unlink()
    with pytest.raises(Exception, match="day summary is not of these files"):
        days_of(spark, place)


def test_no_readings(spark, make, tmp_path):
    place = str(tmp_path / "r"), str(tmp_path / "s")
    write_readings(make({"timestamp": "2025-02-20 01:00:00"}), place[0])
    day_summary.write_day_summary(spark, *place)
    days = day_summary.read_day_summary(spark, *place).where("rows > 5")
    assert day_summary.counted_rows(days).first().total == 0 and day_summary.dates(days).count() == 0


def scanned(text):
    """Which folder each file scan of the plan, subqueries included, reads, with its columns."""
    return re.findall(r"FileScan (\w+) .*?Location: \w+\(\d+ paths?\)\[([^\],]*).*?ReadSchema: struct<([^>]*)>", text)


@pytest.mark.parametrize("use", ["hours", "known hours", "day", "page", "dates", "count"])
def test_subqueries_open_no_reading(spark, place, use):
    df, days = spark.read.parquet(place[0]), day_summary.read_day_summary(spark, *place)
    query = {
        "hours": lambda: series.first_per_hour(df, ["temp"], days=days),
        "known hours": lambda: aggregates.hourly_average(df, days=days),
        "day": lambda: series.day_rows(df, days=days),
        "page": lambda: paging.page(df, days=days),
        "dates": lambda: day_summary.dates(days),
        "count": lambda: day_summary.counted_rows(days),
    }[use]()
    found = scanned(plan_text(query))
    of_readings = [x for x in found if x[0] == "parquet" and x[1].endswith("/r")]
    assert len(of_readings) == (0 if use in ("dates", "count") else 1)
    listings = [x for x in found if x[0] == "binaryFile"]
    assert listings and all("content" not in x[2] for x in listings)
