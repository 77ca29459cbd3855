from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from aneroid.operators.filters import at_point
from aneroid.operators.location_index import (
    build_location_index, compact_location_index, live_loads, location_rows, lookup_location, publish,
    read_location_index,
)
from aneroid.schema import LOCATION_COLUMNS, LOCATION_KEY
from aneroid.streaming.location_upkeep import maintain_location_index, write_load

AT = {"timestamp": "2025-02-21 01:00:00", "id": 1}


def test_latest_write_wins_and_keys_are_required(make):
    df = make(
        {**AT, "temp": 1.0, "processed_at": "2025-02-21 02:00:00"},
        {**AT, "temp": 2.0, "processed_at": "2025-02-21 03:00:00"},
        {**AT, "temp": 9.0, "processed_at": None},
        {**AT, "temp": 5.0, "lat": 1.0},
        {**AT, "temp": 6.0, "lat": 1.0},
        {**AT, "temp": 6.0, "lat": 1.0, "humidity": None},
        *[{**AT, "temp": 7.0, k: None} for k in LOCATION_KEY],
    )
    rows = location_rows(df).orderBy("lat").collect()
    assert [(r.lat, r.temp, r.humidity) for r in rows] == [(1.0, 6.0, 2.0), (45.41, 2.0, 2.0)]


def test_lookup_equals_base_table(spark, base, tmp_path):
    path = str(tmp_path / "index")
    build_location_index(base, path, partitions=4)
    want = sorted(tuple(r) for r in at_point(base, -58, -170).select(*LOCATION_COLUMNS).collect())
    got = [tuple(r) for r in lookup_location(spark, path, "-58", -170.0).collect()]
    assert sorted(got) == want and len(got) == 60
    assert [tuple(r) for r in lookup_location(spark, path, -58, -170, n=5).collect()] == got[:5]
    assert lookup_location(spark, path, 0.5, 0.5).count() == 0


def test_files_are_range_partitioned_and_sorted(spark, base, tmp_path):
    path = str(tmp_path / "index")
    build_location_index(base, path, partitions=4)
    files = sorted(f for f in os.listdir(f"{path}/load=base") if f.endswith(".parquet"))
    assert len(files) == 4
    last = None
    for f in files:
        rows = spark.read.parquet(f"{path}/load=base/{f}").coalesce(1).collect()
        order = [(r.lat, r.lon, r.country, r.state, r.postal_code, -r.timestamp.timestamp(), r.id) for r in rows]
        assert order == sorted(order)
        assert last is None or last <= order[0]
        last = order[-1]


def test_a_station_with_most_readings_is_spread_over_files(spark, base, tmp_path):
    path = str(tmp_path / "index")
    build_location_index(base.withColumns({"lat": F.lit(1.0), "lon": F.lit(2.0)}), path, partitions=4)
    sizes = [r["count"] for r in spark.read.parquet(path).groupBy(F.input_file_name()).count().collect()]
    assert len(sizes) == 4 and max(sizes) < 500


def test_build_never_overwrites(base, tmp_path):
    build_location_index(base, str(tmp_path / "index"), partitions=1)
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        build_location_index(base, str(tmp_path / "index"))


def updates(base):
    """The readings with a correction for every fifth one and, earlier in time, a stale copy."""
    fifth = base.where("id % 5 = 0")
    later = fifth.withColumns({"temp": F.lit(500.0), "processed_at": F.expr("processed_at + interval '1' hour")})
    stale = fifth.withColumns({"temp": F.lit(-500.0), "processed_at": F.expr("processed_at - interval '1' hour")})
    return later, stale


def test_stream_equals_rebuild(spark, base, tmp_path):
    later, stale = updates(base)
    feed = str(tmp_path / "feed")
    for part in (base, later, stale):
        part.coalesce(1).write.mode("append").parquet(feed)
    index, checkpoint = str(tmp_path / "index"), str(tmp_path / "checkpoint")
    stream = spark.readStream.schema(base.schema).option("maxFilesPerTrigger", 1).parquet(feed)
    maintain_location_index(stream, index, checkpoint).awaitTermination()
    assert len(os.listdir(index)) == 3

    rebuilt = location_rows(spark.read.parquet(feed)).select(*LOCATION_COLUMNS)
    want = sorted(tuple(r) for r in rebuilt.collect())
    assert sorted(tuple(r) for r in read_location_index(spark, index).select(*LOCATION_COLUMNS).collect()) == want
    found = [tuple(r) for r in lookup_location(spark, index, -58, -170).collect()]
    assert sorted(found) == [r for r in want if r[:2] == (-58.0, -170.0)]
    assert [tuple(r) for r in lookup_location(spark, index, -58, -170, n=7).collect()] == found[:7]

    # new files continue the numbering of the checkpoint
    base.limit(1).coalesce(1).write.mode("append").parquet(feed)
    maintain_location_index(stream, index, checkpoint).awaitTermination()
    assert len(os.listdir(index)) == 4

    # a query of its own, with a new checkpoint, adds loads and replaces none
    maintain_location_index(stream, index, f"{checkpoint}-2").awaitTermination()
    assert len(os.listdir(index)) == 8

    # folding the loads into a new base changes nothing
    folded = str(tmp_path / "folded")
    build_location_index(read_location_index(spark, index), folded, partitions=2)
    assert os.listdir(folded) == ["load=base"]
    assert sorted(tuple(r) for r in read_location_index(spark, folded).select(*LOCATION_COLUMNS).collect()) == want


def test_a_retried_batch_changes_nothing(spark, base, tmp_path):
    index = str(tmp_path / "index")
    for _ in range(2):
        write_load(base, index, "batch-000000000000")
    assert read_location_index(spark, index).count() == base.count()


def everything(spark, index):
    return sorted(tuple(r) for r in read_location_index(spark, index).select(*LOCATION_COLUMNS).collect())


def test_compaction_keeps_what_lookups_find(spark, base, tmp_path):
    later, stale = updates(base)
    index = str(tmp_path / "index")
    build_location_index(base.where("id % 2 = 0"), index, partitions=2)
    parts = [base.where("id % 2 = 1"), later, stale]
    for i, part in enumerate(parts):
        write_load(part, index, f"q-{i}")
    before = everything(spark, index)
    assert len(live_loads(spark, index)) == 4
    running = read_location_index(spark, index)  # began before the compaction
    name = compact_location_index(spark, index, partitions=2)
    assert live_loads(spark, index) == ["base", name] and everything(spark, index) == before
    assert running.count() == len(before)

    # a retry of a batch that has been folded adds nothing, another batch does; its files are folded next time
    write_load(later.withColumn("temp", F.lit(-1.0)), index, "q-1")
    assert everything(spark, index) == before
    write_load(later.withColumns({"temp": F.lit(900.0), "processed_at": F.expr("processed_at + interval '2' hour")}), index, "q-3")
    after = everything(spark, index)
    assert after != before and sum(r[2] == 900.0 for r in after) == later.count()
    compact_location_index(spark, index, with_base=True)
    assert len(live_loads(spark, index)) == 1 and everything(spark, index) == after
    assert compact_location_index(spark, index) is None


def test_half_written_loads_do_not_show(spark, base, tmp_path):
    index = str(tmp_path / "index")
    build_location_index(base, index, partitions=1)
    want = everything(spark, index)
    half = base.withColumn("temp", F.lit(7.0)).select(*LOCATION_COLUMNS, F.lit(None).cast("timestamp_ntz").alias("processed_at"))
    half.write.parquet(f"{index}/load=q-0")
    assert everything(spark, index) == want
    write_load(base.where("id % 2 = 0"), index, "q-0")  # the try that succeeds replaces it
    assert everything(spark, index) == want


def test_loads_published_during_a_compaction_stay(spark, base, tmp_path):
    index = str(tmp_path / "index")
    for i in range(2):
        write_load(base.where(f"id % 3 = {i}"), index, f"q-{i}")
    seen = live_loads(spark, index)
    write_load(base.where("id % 3 = 2"), index, "q-2")
    # what a compaction that began with ``seen`` publishes at its end
    write_load(base.where("id % 3 < 2"), index, "made")
    publish(spark, index, "folded", seen)
    spark.read.parquet(f"{index}/load=made").write.parquet(f"{index}/load=folded")
    assert live_loads(spark, index) == ["folded", "made", "q-2"]
    assert read_location_index(spark, index).count() == base.count()
