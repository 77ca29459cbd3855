from __future__ import annotations

import pytest

from aneroid.operators.location_index import build_location_index
from aneroid.plans import endpoints as E
from aneroid.schema import LISTING_COLUMNS, PLACE_COLUMNS


@pytest.fixture(params=["base", "stored"])
def df(request):
    return request.getfixturevalue(request.param)


def test_series(df):
    hours = E.sensor_data_temp_timestamp(df).collect()
    assert len(hours) == 50 and hours[0].hour > hours[-1].hour
    assert E.temperature_vs_hourly_data_experimental(df).collect()[:50] == hours
    assert E.comparative_temp_humidity(df).columns == ["day", "temp", "humidity"]
    assert E.comparative_temp_pressure(df).count() == 30
    daily = E.temperature_vs_daily_data(df).collect()
    assert len(daily) == 30
    among = E.temperature_vs_daily_data(df, 500).collect()
    assert 1 < len(among) < 30 and among == daily[: len(among)]


def test_dated_envelopes(df):
    debug = E.temperature_vs_hourly_data_debug(df).first()
    assert debug.date == "2024-01-30" and debug.temp_hourly[0].asDict().keys() == {"date", "hour", "temp"}
    one = E.temperature_vs_hourly_data(df, "2024-01-15").first()
    assert one.date == "2024-01-15" and [r.hour for r in one.temp_hourly] == sorted(r.hour for r in one.temp_hourly)
    single = E.temperature_vs_hourly_single_date(df).first()
    assert single.meta.date == "2024-01-30" and len(single.records) == 22
    means = E.temperature_humidity_hourly_data(df).first()
    assert means.meta.date == "2024-01-30" and len(means.records) == 22
    assert all(round(r.temperature, 2) == r.temperature for r in means.records)


def test_no_data_for_the_date(df):
    none = E.temperature_humidity_hourly_data(df, "1999-01-01").first()
    assert none.meta.date == "1999-01-01" and none.records == []


def test_no_data_at_all(make):
    none = E.temperature_vs_hourly_data(make()).first()
    assert none.date is None and none.temp_hourly == []


def test_listings(df):
    assert E.current_sensor_data(df).columns == LISTING_COLUMNS and E.current_sensor_data(df).count() == 50
    assert E.sensor_data_page(df, 20, 30).first().total == 1000
    assert E.sensor_data(df).columns == PLACE_COLUMNS and E.sensor_data(df).count() == 5
    assert E.sensor_data_by_lat_lon(df, "-58", "-170").count() == 5
    assert E.sensor_data_by_lat_lon_range(df, "-10", "10", "-50", "50").count() == 10
    assert E.sensor_data_by_country(df, "US").count() == 5
    assert {r.state for r in E.sensor_data_by_country(df, "US", "error").collect()} == {"error"}


def test_indexed_lookup(spark, base, tmp_path):
    build_location_index(base, str(tmp_path / "index"), partitions=2)
    rows = E.sensor_data_by_lat_lon_indexed(spark, str(tmp_path / "index"), -58, -170)
    assert rows.columns == PLACE_COLUMNS and rows.count() == 5
