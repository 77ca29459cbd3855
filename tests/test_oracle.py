"""Every registered query against its SQL twin, at two scales, in one session."""

from __future__ import annotations

import pytest
from compare import connect, difference

import __spark_entry__ as entry_points
from aneroid.plans import queries as plans

# the readings' queries; others have tests of their own
QUERIES = {name: entry_points.queries()[name] for name in plans.QUERIES}
SQL = {name: entry_points.oracle_sql()[name] for name in plans.QUERIES}


@pytest.fixture(scope="module", params=["sf0.001", "sf0.01"])
def scale(request):
    sf_dir = f"/root/testdata/{request.param}"
    return sf_dir, connect(sf_dir)


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(plans.QUERIES) == set(SQL)


def test_entry(spark):
    rows = entry_points.entry(spark).collect()
    assert len(rows) == 22 and rows[0].asDict().keys() == {"hour", "temperature", "humidity"}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, scale, name):
    sf_dir, con = scale
    assert difference(spark, con, QUERIES[name], SQL[name], sf_dir) is None


@pytest.mark.parametrize("zone", ["America/New_York", "Asia/Kolkata"])
@pytest.mark.parametrize(
    "name", ["first_temp_per_hour_top50", "hourly_avg_latest", "avg_by_week", "page_deep", "strict_timestamps"]
)
def test_results_do_not_depend_on_the_session_zone(spark, sf_dir, name, zone):
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        assert difference(spark, connect(sf_dir), QUERIES[name], SQL[name], sf_dir) is None
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
