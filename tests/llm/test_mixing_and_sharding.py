"""Mixing and sharding: exact shares, quotas, schedules, laws of movement, gapless slots."""

from __future__ import annotations

from collections import Counter

import pytest
from pyspark.sql import functions as F

from aneroid.llm import hash_tree, mixing
from aneroid.llm.numbering import hash_bucket, running

SCHEMA = "doc_id long, source string, n long"


def water_filling(sizes, weights, most=3.0):
    """Targets by resharing again and again."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, target, open_ = float(sum(sizes.values())), {}, set(names)
    while open_:
        left = total - sum(target.values())
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = {s for s in open_ if share[s] > most * sizes[s]}
        target |= {s: most * sizes[s] for s in full} if full else share
        open_ = open_ - full if full else set()
    return target


def rows_of(sizes):
    return [(100 * i + j, s, n) for i, (s, ns) in enumerate(sizes.items()) for j, n in enumerate(ns)]


def mixed(spark, rows, **kwargs):
    docs = spark.createDataFrame(rows, SCHEMA)
    placed, slots = mixing.mix(docs, F.col("n"), weights=(5, 2, 1), **kwargs)
    return [r.asDict() for r in placed.collect()], [r.asDict() for r in slots.orderBy("slot").collect()]


CASES = [
    {"a": [100, 300, 250], "b": [50, 10, 0], "c": [1000, 900], None: [70, 30]},
    {"only": [5, 6, 7]},
    {"tiny": [1], "empty": [0, 0], "large": [5000] * 9, "z": [40] * 20},
]


@pytest.mark.parametrize("sizes", CASES)
def test_targets_and_words_taken(spark, sizes):
    rows = rows_of(sizes)
    placed, slots = mixed(spark, rows)
    target = water_filling({s: sum(n) for s, n in sizes.items()}, (5, 2, 1))
    assert len(placed) == len(rows)
    for s in sizes:
        mine = [r for r in placed if r["source"] == s]
        assert all(r["target"] == pytest.approx(target[s]) for r in mine)
        assert sum(r["taken"] for r in mine) == round(mine[0]["target"]) == sum(
            x["words"] for x in slots if x["source"] == s
        )
        assert all(0 <= r["taken"] <= 3 * r["size"] for r in mine)
    ranks = Counter(x["source"] for x in slots)
    assert {(x["source"], x["rank"]) for x in slots} == {(s, i) for s, n in ranks.items() for i in range(n)}


def test_every_stretch_of_the_schedule_is_mixed(spark):
    _, slots = mixed(spark, rows_of({"a": [4000] * 20, "b": [4000] * 20, "c": [4000] * 20}), blocks=2000)
    share = Counter(x["source"] for x in slots)
    for at in range(0, len(slots) - 100, 100):
        here = Counter(x["source"] for x in slots[at : at + 100])
        assert all(abs(here[s] - 100 * n / len(slots)) <= 3 for s, n in share.items())


def test_reruns_agree_and_the_order_of_rows_does_not_matter(spark):
    rows = rows_of(CASES[0])
    key = lambda r: (r["doc_id"], r["taken"], r["first_word"])
    assert sorted(mixed(spark, rows)[0], key=key) == sorted(mixed(spark, rows[::-1])[0], key=key)


def test_repeated_rows_null_ids_and_empty_tables(spark):
    rows = [(1, "a", 10), (1, "a", 10), (None, "a", 7), (None, "a", 7), (2, None, None)]
    placed, _ = mixed(spark, rows)
    assert len(placed) == 5 and sum(r["taken"] for r in placed) == 34
    assert mixed(spark, []) == ([], [])


def test_running_sums_over_buckets(spark):
    df = spark.range(500).select(F.col("id"), (F.col("id") % 3).alias("k"), (F.col("id") % 7).alias("n"))
    df = df.withColumn("b", hash_bucket("id", buckets=16))
    rows = running(df, "k", "b", [F.col("id")], F.col("n"), "before").collect()
    for k in range(3):
        at = 0
        for r in sorted((r for r in rows if r["k"] == k), key=lambda r: (r["b"], r["id"])):
            assert r["before"] == at
            at += r["n"]


TREE = {
    "east": {"r1": {0: 1.0, 1: 2.0}, "r2": {2: 1.0}},
    "west": {"r1": {3: 3.0}, "r2": {4: 0.5, 5: 0.5}},
}


def placement(spark, tree, n=20_000):
    df = spark.range(n).select("id", hash_tree.shard_of(F.col("id"), tree).alias("s"))
    return {r["id"]: r["s"] for r in df.collect()}


def test_shares_follow_the_weights(spark):
    counts = Counter(placement(spark, TREE).values())
    for shard, weight in {0: 1, 1: 2, 2: 1, 3: 3, 4: 0.5, 5: 0.5}.items():
        assert counts[shard] == pytest.approx(20_000 * weight / 8, rel=0.12)


def test_a_changed_weight_moves_rows_inside_its_subtree_only(spark):
    before = placement(spark, TREE)
    racks = {**TREE["east"], "r1": {0: 2.0, 1: 1.0}}  # the rack's own weight stays
    after = placement(spark, {**TREE, "east": racks})
    moved = [(a, after[i]) for i, a in before.items() if a != after[i]]
    assert moved and all({a, b} == {0, 1} and (a, b) == (1, 0) for a, b in moved)


@pytest.mark.parametrize("shards", [1, 2, 7, 8])
def test_one_more_shard_takes_rows_only_into_itself(spark, shards):
    tree = hash_tree.regular_tree(shards)
    before, after = placement(spark, tree), placement(spark, hash_tree.grown(tree, shards))
    moved = [after[i] for i, s in before.items() if s != after[i]]
    assert set(moved) == {shards}
    assert len(moved) == pytest.approx(20_000 / (shards + 1), rel=0.1)


def test_slots_are_gapless_for_repeated_null_and_clashing_rows(spark):
    rows = [(i % 40 if i % 11 else None, "t" if i % 2 else None, 9) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, shard long")
    got = hash_tree.shard(df, "doc_id", TREE, buckets=8).collect()
    assert len(got) == 400
    by_shard: dict[int, list[int]] = {}
    for r in got:
        by_shard.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in by_shard.values())
    assert len({r["shard"] for r in got if r["doc_id"] is None}) == 1
    assert hash_tree.shard(df.limit(0), "doc_id", TREE).count() == 0


def test_wrong_trees_are_rejected():
    with pytest.raises(ValueError):
        hash_tree.grown(TREE, 3)
    with pytest.raises(ValueError):
        hash_tree.shard_of(F.lit(1), {"a": {"b": {0: 0.0, 1: 1.0}}})
