"""A bucket, a station or a key with a third of all rows must not cross the network whole."""

from __future__ import annotations

import pytest
from plans import shuffled_rows
from pyspark.sql import functions as F

from aneroid.operators import aggregates as A
from aneroid.operators.location_index import location_rows
from aneroid.operators.series import first_per_bucket
from aneroid.schema import LOCATION_KEY

TASKS = 6


@pytest.fixture(scope="module")
def skewed(base, tmp_path_factory, spark):
    """30,000 readings in six files: one hour holds a third of them, and so does one location key."""
    many = base.crossJoin(spark.range(30).withColumnRenamed("id", "copy"))
    hot = F.col("copy") % 3 == 0
    key = {c: F.first(c).over(_everything()) for c in LOCATION_KEY}
    rows = many.withColumns({c: F.when(hot, value).otherwise(F.col(c)) for c, value in key.items()})
    path = str(tmp_path_factory.mktemp("skew") / "r")
    rows.drop("copy").repartition(TASKS, F.rand(1)).write.parquet(path)
    spark.conf.set("spark.sql.files.openCostInBytes", str(128 * 1024 * 1024))  # a task per file
    yield spark.read.parquet(path)
    spark.conf.unset("spark.sql.files.openCostInBytes")


def _everything():
    from pyspark.sql import Window

    return Window.partitionBy(F.lit(1)).orderBy("timestamp", "copy").rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing
    )


def test_the_fixture_is_skewed(skewed):
    assert skewed.count() == 30_000
    assert skewed.groupBy(*LOCATION_KEY).count().agg(F.max("count")).first()[0] >= 10_000


def test_series_ship_one_row_per_task_and_bucket(skewed):
    buckets = skewed.select(F.to_date("timestamp")).distinct().count()
    assert max(shuffled_rows(first_per_bucket(skewed, "day", ["temp"]))) <= TASKS * buckets


@pytest.mark.parametrize("grain", ["hour_of_day", "day", "week"])
def test_averages_ship_one_row_per_task_and_bucket(skewed, grain):
    query = A.average_by(skewed, grain, ["temp"])
    assert max(shuffled_rows(query)) <= TASKS * query.count()


def test_copies_of_a_key_are_reduced_before_the_shuffle(skewed):
    keys = skewed.select(*LOCATION_KEY).distinct().count()
    unreduced = skewed.count()
    (shuffled,) = shuffled_rows(location_rows(skewed))
    assert keys <= shuffled <= TASKS * keys < unreduced
    assert location_rows(skewed).count() == keys
