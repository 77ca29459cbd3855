"""A copy of the readings clustered by location, for lookups at a point.

Layout under the index path, in Parquet::

    load=base/            the full build, one row per key, range-partitioned and sorted by the key
    load=<batch name>/    one directory per streamed batch, in the same order
    load=folded-<id>/     what a compaction made of several loads

and beside it, under the path with ``-loads``, the list of the loads that count. A load is read only once it is on the
list, so half-written ones don't show, and a lookup opens the loads of one moment.

A lookup reads only the row groups around its point and keeps the latest row per key over all loads.
Compactions keep their number small; rebuilding from ``read_location_index`` into a new path makes a new base.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from aneroid.operators.filters import at_point, with_keys
from aneroid.schema import LOCATION_COLUMNS, LOCATION_KEY

BASE = "base"
ENTRY = "load string, live boolean"


def clustering_order() -> list[Column]:
    return [F.col(c).desc() if c == "timestamp" else F.col(c).asc() for c in LOCATION_KEY]


def location_rows(df: DataFrame) -> DataFrame:
    """One row per location key: the one processed last. Rows that lack a key column are left out.

    ``processed_at`` stays in the rows, so that later loads can be told from earlier ones. Copies of a
    key meet in the shuffle only after each task has reduced its own to one. The ranking compares the
    most selective key columns first: coordinates would tie on almost every comparison of the sort.
    """
    latest = Window.partitionBy(*reversed(LOCATION_KEY)).orderBy(
        *[F.col(c).desc_nulls_last() for c in ("processed_at", "temp", "humidity")]
    )
    return (
        with_keys(df, LOCATION_KEY)
        .select(*LOCATION_COLUMNS, "processed_at")
        .withColumn("rn", F.row_number().over(latest))
        .where(F.col("rn") == 1)
        .drop("rn")
    )


def build_location_index(df: DataFrame, path: str, partitions: int | None = None) -> None:
    """Write the full index to a new ``path``; an existing one is never overwritten.

    The range partitioning runs over the whole key, not just the coordinates, so a station with a third
    of all readings is spread over many files. ``partitions`` sets their number (default: the session's
    shuffle partitions); aim at files of about 1 GB.
    """
    _write_sorted(location_rows(df), f"{path}/load={BASE}", partitions)
    publish(df.sparkSession, path, BASE)


def _write_sorted(rows: DataFrame, path: str, partitions: int | None) -> None:
    order = clustering_order()
    ranged = rows.repartitionByRange(*order) if partitions is None else rows.repartitionByRange(partitions, *order)
    ranged.sortWithinPartitions(*order).write.mode("errorifexists").parquet(path)


def _list_of(path: str) -> str:
    return f"{path.rstrip('/')}-loads"


def published(spark: SparkSession, path: str) -> DataFrame:
    """Every load that was ever published, with whether it still counts: ``load, live``."""
    entries = spark.read.schema(ENTRY).parquet(_list_of(path))
    return entries.groupBy("load").agg(F.min("live").alias("live"))


def publish(spark: SparkSession, path: str, load: str, instead_of: list[str] = ()) -> None:
    """Make a finished load count, and those it replaces not, in one step.

    The list only grows. An entry is one file, which appears when it is moved into place: readers see all of it or
    nothing. A load that was replaced stays so, whatever is published later.
    """
    entry = [(load, True), *[(name, False) for name in instead_of]]
    spark.createDataFrame(entry, ENTRY).coalesce(1).write.mode("append").parquet(_list_of(path))


def live_loads(spark: SparkSession, path: str) -> list[str]:
    """The loads to read now: those since the last compaction, and what it left."""
    return sorted(r.load for r in published(spark, path).where("live").collect())


def _read(spark: SparkSession, path: str, loads: list[str]) -> DataFrame:
    return spark.read.parquet(*[f"{path}/load={name}" for name in loads])


def read_location_index(spark: SparkSession, path: str) -> DataFrame:
    """The whole index with every key resolved to its latest row, plus ``processed_at``."""
    loads = live_loads(spark, path)
    stored = _read(spark, path, loads)
    return stored if len(loads) == 1 else location_rows(stored)


def compact_location_index(
    spark: SparkSession, path: str, with_base: bool = False, partitions: int | None = None
) -> str | None:
    """Fold the streamed loads into one, with ``with_base`` the base too; the new load's name, or None.

    Safe beside the stream and beside lookups: it folds the loads of one snapshot, those published meanwhile stay
    as they are, and no file is changed or deleted. Folded directories may be deleted when no lookup that began
    before is still running.
    """
    loads = [name for name in live_loads(spark, path) if with_base or name != BASE]
    if len(loads) < 2:
        return None
    name = f"folded-{uuid.uuid4().hex}"
    _write_sorted(location_rows(_read(spark, path, loads)), f"{path}/load={name}", partitions)
    publish(spark, path, name, loads)
    return name


def lookup_location(
    spark: SparkSession, path: str, lat: float | str, lon: float | str, n: int | None = None
) -> DataFrame:
    """Rows at a point in clustering order; ``n`` keeps the first ``n`` keys.

    A load has a key at most once, so the first ``n`` keys and all their versions lie within the first
    ``n * loads`` rows: with ``n`` there is a top-k and no shuffle of the point's readings.
    """
    loads = live_loads(spark, path)
    rows = at_point(_read(spark, path, loads), lat, lon)
    if n is not None:
        rows = rows.orderBy(*clustering_order()).limit(n * len(loads))
    if len(loads) > 1:
        rows = location_rows(rows)
    rows = rows.orderBy(*clustering_order()).select(*LOCATION_COLUMNS)
    return rows if n is None else rows.limit(n)
