"""Folded partials against the readings they were made from, and that the readings stay closed."""

from __future__ import annotations

import datetime as dt

import pytest
from plans import files_read
from test_day_summary import scanned

from aneroid.operators import aggregates, series
from aneroid.operators import hour_partials as hours
from aneroid.operators.sinks import append_readings, write_readings

NAN = float("nan")


@pytest.fixture(scope="module")
def place(make, spark, tmp_path_factory):
    """Hours whose readings lie in several files: ties, missing ids, values, times and places, and a NaN."""
    early = make(
        {"id": 7, "timestamp": "2025-02-20 01:10:00", "temp": 0.125, "humidity": None},
        {"id": 3, "timestamp": "2025-02-20 01:10:00", "temp": 0.13, "postal_code": "00000"},
        {"id": None, "timestamp": "2025-02-20 01:10:00", "temp": 9.0},
        {"id": 4, "timestamp": "2025-02-20 23:59:59.999999", "temp": None},
        {"id": 5, "timestamp": None, "temp": 4.0, "postal_code": None},
    )
    late = make(
        {"id": 2, "timestamp": "2025-02-20 01:10:00", "temp": 1e30, "humidity": 5.0},
        {"id": 9, "timestamp": "2025-02-20 01:05:00", "temp": 2.0},
        {"id": 1, "timestamp": "2025-02-21 05:00:00", "temp": NAN, "pressure": 7.0},
        {"id": 6, "timestamp": "2025-02-24 05:00:00", "temp": -1.0, "postal_code": "00000"},
    )
    base = tmp_path_factory.mktemp("hours")
    readings, partials = str(base / "r"), str(base / "p")
    write_readings(early, readings)
    hours.write_hour_partials(spark, readings, partials)
    append_readings(late, readings)
    for _ in range(2):  # adding what is there already changes nothing
        hours.extend_hour_partials(spark, readings, partials)
    return readings, partials


@pytest.fixture(scope="module")
def both(spark, place):
    return hours.read_hour_partials(spark, *place), spark.read.parquet(place[0])


def same(got, want):
    assert got.dtypes == want.dtypes
    assert repr(got.collect()) == repr(want.collect())


@pytest.mark.parametrize("grain", ["all", "date", "hour", "day", "week", "month", "year", "hour_of_day"])
@pytest.mark.parametrize("known", [True, False])
@pytest.mark.parametrize("digits", [None, 2])
def test_averages(both, grain, known, digits):
    parts, df = both
    metrics = ["temp", "humidity", "pressure"]
    same(
        hours.average_by(parts, grain, metrics, drop_sentinel=known, digits=digits),
        aggregates.average_by(df, grain, metrics, drop_sentinel=known, digits=digits),
    )


@pytest.mark.parametrize(
    "start,end",
    [
        (dt.datetime(2025, 2, 20, 1, 7), dt.datetime(2025, 2, 21, 5)),
        (dt.datetime(2025, 2, 20, 1, 5), dt.datetime(2025, 2, 20, 1, 9)),
        (dt.datetime(2025, 2, 20), dt.datetime(2025, 2, 20, 23, 59, 59, 999999)),
        (dt.datetime(2025, 2, 21, 6), dt.datetime(2025, 2, 20)),
        (dt.date(2025, 2, 20), dt.datetime(2025, 2, 21, 4, 59)),
        (dt.date(2025, 2, 20), "2025-02-21"),
    ],
)
def test_ranges(both, start, end):
    parts, df = both
    want = aggregates.average_by(df, "hour", ["temp", "humidity"], start, end, drop_sentinel=False)
    same(hours.average_by(parts, "hour", ["temp", "humidity"], start, end, drop_sentinel=False, readings=df), want)


def test_a_range_of_instants_needs_readings(both):
    with pytest.raises(ValueError, match="first and last hour"):
        hours.average_by(both[0], "all", ["temp"], dt.datetime(2025, 2, 20), dt.datetime(2025, 2, 21))


@pytest.mark.parametrize("grain", ["hour", "day", "week", "month", "year"])
@pytest.mark.parametrize("descending,n", [(False, None), (True, None), (True, 2), (False, 1)])
def test_first_readings(both, grain, descending, n):
    parts, df = both
    same(
        hours.first_per_bucket(parts, grain, ["temp", "humidity"], descending, n),
        series.first_per_bucket(df, grain, ["temp", "humidity"], descending=descending, n=n),
    )


@pytest.mark.parametrize("date", [None, "2025-02-20", "2030-01-01"])
@pytest.mark.parametrize("known", [True, False])
def test_one_day(both, date, known):
    parts, df = both
    for shown in (None, "label", "date"):
        same(hours.first_per_hour(parts, ["temp"], date, known, shown), series.first_per_hour(df, ["temp"], date, known, shown))
    same(hours.hourly_average(parts, date, 2), aggregates.hourly_average(df, date, 2))
    for how in ("min", "max"):
        same(hours.extreme(parts, "temp", how, date, known), aggregates.extreme(df, "temp", how, date, known))


def test_only_the_edges_of_a_range_open_readings(both):
    parts, df = both

    for query in (hours.average_by(parts, "week", ["temp"]), hours.first_per_hour(parts, ["temp"], known_places=True)):
        assert list(files_read(query)) == ["p"]
    span = dt.datetime(2025, 2, 20, 1, 7), dt.datetime(2025, 2, 24, 5)
    query = hours.average_by(parts, "day", ["temp"], *span, drop_sentinel=False, readings=df)
    of_days = [sum(f"={day}/" in f for f in df.inputFiles()) for day in ("2025-02-20", "2025-02-24")]
    assert sorted(files_read(query)["r"]) == sorted(of_days)


def test_averages_read_only_their_metric(both):
    query = hours.average_by(both[0], "week", ["temp"])
    query.collect()
    text = query._jdf.queryExecution().executedPlan().toString()
    columns = [x[2] for x in scanned(text) if x[1].endswith("/p") and "temp" in x[2]]
    assert columns and all("temp:struct<n:bigint,total:double" in c for c in columns)
    assert not any(name in c for c in columns for name in ("humidity", "exact", "first"))


def test_partials_of_other_files_are_refused(spark, make, tmp_path):
    place = str(tmp_path / "r"), str(tmp_path / "p")
    write_readings(make({"timestamp": "2025-02-20 01:00:00"}), place[0])
    hours.write_hour_partials(spark, *place)
    append_readings(make({"timestamp": "2025-02-20 05:00:00"}), place[0])
    with pytest.raises(Exception, match="hour partials is not of these files"):
        hours.read_hour_partials(spark, *place).collect()
