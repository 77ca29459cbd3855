from __future__ import annotations

import datetime as dt

import pytest

from aneroid.operators.series import dated_rows, day_rows, first_per_bucket, first_per_hour, hour_rows


def tuples(df):
    return [tuple(r) for r in df.collect()]


@pytest.mark.parametrize("partitions", [1, 2, 7])
def test_ties_go_to_the_lowest_id(make, partitions):
    df = make(
        {"id": 2, "timestamp": "2025-02-21 01:10:00", "temp": 2.0},
        {"id": 1, "timestamp": "2025-02-21 01:10:00", "temp": 1.0},
        {"id": 3, "timestamp": "2025-02-21 01:50:00", "temp": 3.0},
    ).repartition(partitions)
    assert tuples(first_per_bucket(df, "hour", ["temp"])) == [(dt.datetime(2025, 2, 21, 1), 1.0)]


@pytest.mark.parametrize("grain", ["hour", "day", "week", "month", "year"])
@pytest.mark.parametrize("descending", [False, True])
def test_limit_is_a_prefix_of_the_whole_series(base, stored, grain, descending):
    whole = tuples(first_per_bucket(base, grain, ["temp"], descending=descending))
    for n in (2, len(whole) + 5):
        assert tuples(first_per_bucket(base, grain, ["temp"], descending=descending, n=n)) == whole[:n]
    assert tuples(first_per_bucket(stored, grain, ["temp"], descending=descending)) == whole
    assert tuples(first_per_bucket(stored, grain, ["temp"], descending=descending, n=3)) == whole[:3]


@pytest.mark.parametrize("descending", [False, True])
@pytest.mark.parametrize("n, undated", [(1, False), (2, False), (3, True), (9, True), (None, True)])
def test_undated_readings_are_the_last_bucket(make, spark, tmp_path, descending, n, undated):
    from aneroid.operators.sinks import write_readings

    df = make(
        {"timestamp": "2025-02-21 01:00:00", "temp": 1.0}, {"timestamp": "2025-02-21 05:00:00", "temp": 2.0},
        {"id": 9, "temp": 9.0}, {"id": 8, "temp": 8.0},
    )
    write_readings(df, str(tmp_path / "r"))
    for rows in (df, spark.read.parquet(str(tmp_path / "r"))):
        got = tuples(first_per_bucket(rows, "hour", ["temp"], descending=descending, n=n))
        dated = [(dt.datetime(2025, 2, 21, 1), 1.0), (dt.datetime(2025, 2, 21, 5), 2.0)]
        want = (dated[::-1] if descending else dated) + [(None, 8.0)]
        assert got == (want if n is None else want[:n])
        assert ((None, 8.0) in got) == undated


def test_empty(make):
    assert tuples(first_per_bucket(make(), "hour", ["temp"], n=50)) == []
    assert tuples(first_per_hour(make(), ["temp"])) == []
    assert tuples(day_rows(make())) == []


def test_bad_arguments(make):
    with pytest.raises(ValueError):
        first_per_bucket(make(), "hour_of_day", ["temp"])
    with pytest.raises(ValueError):
        first_per_hour(make(), ["temp"], with_date="iso")


def test_hours_of_a_date(make):
    df = make(
        {"timestamp": "2025-02-21 01:30:00", "temp": 1.0},
        {"timestamp": "2025-02-21 01:10:00", "temp": 2.0, "postal_code": "00000"},
        {"timestamp": "2025-02-22 03:00:00", "temp": 3.0, "postal_code": "00000"},
        {"timestamp": "2025-02-22 03:10:00", "temp": 4.0, "postal_code": "00000"},
    )
    assert tuples(first_per_hour(df, ["temp"])) == [("03", 3.0)]
    assert tuples(first_per_hour(df, ["temp"], "2025-02-21")) == [("01", 2.0)]
    assert tuples(first_per_hour(df, ["temp"], known_places=True, with_date="date")) == [
        (dt.date(2025, 2, 21), "01", 1.0)
    ]
    assert tuples(first_per_hour(df, ["temp"], with_date="label")) == [("2025-02-22", "03", 3.0)]
    assert tuples(day_rows(df)) == [("2025-02-22", "03", 3.0), ("2025-02-22", "03", 4.0)]
    assert tuples(day_rows(df, "2025-02-21")) == [("2025-02-21", "01", 2.0), ("2025-02-21", "01", 1.0)]
    assert tuples(hour_rows(df, "2025-02-21")) == [(1, 1.0)]
    assert tuples(dated_rows(df, "2025-02-21", 1)) == [
        (2.0, dt.datetime(2025, 2, 21, 1, 10), dt.date(2025, 2, 21))
    ]
