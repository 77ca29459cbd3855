from __future__ import annotations

import datetime as dt

import pytest

from aneroid.operators import filters
from aneroid.schema import LOCATION_KEY


def ids(df):
    return sorted(r.id for r in df.collect())


def test_sentinel_forms(make):
    codes = ["00000", "0", "000000", "SW1A", "97062", None]
    df = make(*[{"postal_code": c} for c in codes])
    assert [r.postal_code for r in filters.drop_sentinel(df).orderBy("id").collect()] == codes[1:5]


def test_day_edges(make):
    df = make({"timestamp": "2025-02-21 23:59:59.999999"}, {"timestamp": "2025-02-22 00:00:00"}, {})
    assert ids(filters.on_date(df, "2025-02-21")) == [1]
    assert ids(filters.on_date(df, dt.date(2025, 2, 22))) == [2]
    assert ids(filters.between_dates(df, "2025-02-21", "2025-02-22")) == [1, 2]
    assert ids(filters.on_latest_date(df, False)) == [2]


def test_instants_include_both_ends(make):
    df = make(*[{"timestamp": f"2025-02-21 0{h}:00:00"} for h in range(4)])
    assert ids(filters.between_instants(df, "2025-02-21 01:00:00", "2025-02-21 02:00:00")) == [2, 3]


@pytest.mark.parametrize("bad", ["2025-13-01", "21.02.2025", "", dt.datetime(2025, 1, 1)])
def test_date_argument(make, bad):
    with pytest.raises(ValueError):
        filters.on_date(make(), bad)


def test_latest_date_may_be_all_sentinel(make):
    df = make(
        {"timestamp": "2025-02-21 10:00:00"},
        {"timestamp": "2025-02-22 10:00:00", "postal_code": "00000"},
    )
    assert ids(filters.on_latest_date(df, drop_sentinel_first=False)) == [2]
    assert ids(filters.on_latest_date(df, drop_sentinel_first=True)) == [1]


def test_nothing_there(make):
    assert ids(filters.on_latest_date(make(), True)) == []
    assert ids(filters.on_latest_date(make({}), False)) == []


def test_places(make):
    df = make(
        {"lat": 1.0, "lon": 2.0}, {"lat": 1.0, "lon": 3.0, "country": "CA"}, {"lat": None, "lon": 2.0},
        {"lat": -1.0, "lon": -2.0, "state": "Idaho"},
    )
    assert ids(filters.at_point(df, "1", 2)) == [1]
    assert ids(filters.in_box(df, "-1", "1", "-2", "2")) == [1, 4]
    assert ids(filters.in_country(df, "US")) == [1, 3, 4]
    assert ids(filters.in_country(df, "US", "Idaho")) == [4]
    assert ids(filters.with_keys(df, LOCATION_KEY)) == []
    assert ids(filters.with_keys(df, ["lat", "lon"])) == [1, 2, 4]
