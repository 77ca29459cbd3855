"""Near-duplicates and components against brute force."""

from __future__ import annotations

import re

import numpy as np
import pytest

from aneroid.llm import odd_sketch
from aneroid.llm.components import components


def exact(rows, percent=75):
    """n_shingles and component of each row, by comparing all pairs."""
    sets = []
    for _, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        grams = {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} - {()}
        sets.append(grams)
    parent = {k: k for k, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, _) in enumerate(rows):
        for j, (b, _) in enumerate(rows[:i]):
            both = len(sets[i] & sets[j])
            if a is not None and b is not None and both and 100 * both >= percent * len(sets[i] | sets[j]):
                low, high = sorted((find(a), find(b)))
                parent[high] = low
    return sorted(((k, len(s), find(k)) for (k, _), s in zip(rows, sets, strict=True)), key=str)


def found(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = odd_sketch.near_duplicates(docs).collect()
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=str)


def text(rng, n):
    return [f"w{x}" for x in rng.integers(0, 3000, n)]


def changed(rng, words, share):
    return [f"c{rng.integers(0, 10**6)}" if rng.random() < share else w for w in words]


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(5)
    out = []
    for _ in range(12):
        base = text(rng, int(rng.integers(30, 200)))
        for share in (0.0, 0.01, 0.02, 0.04, 0.06):
            out.append(" ".join(changed(rng, base, share)))
    out += [" ".join(text(rng, 60)) for _ in range(20)] + ["one two", "One two", "one  two\n", "one", "", " \t", None]
    return [(int(i), t) for i, t in zip(rng.permutation(len(out)), out, strict=True)]


def test_groups_match_all_pairs(spark, rows):
    assert found(spark, rows) == exact(rows)


def test_repeated_rows_and_null_ids(spark, rows):
    more = [*rows[:30], *rows[:10], (None, rows[0][1]), (None, rows[0][1]), (rows[1][0], "another text of the same id here")]
    assert found(spark, more) == exact(more)


def test_a_large_bucket_is_linked_without_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(odd_sketch, "SMALL_BUCKET", 3)
    rng = np.random.default_rng(9)
    base = text(rng, 80)
    rows = [(i, " ".join(changed(rng, base, 0.03))) for i in range(60)]
    assert found(spark, rows) == exact(rows)


def test_chains_link_what_is_not_similar_itself(spark):
    words = [f"x{i}" for i in range(200)]
    rows = [(i, " ".join(words[i * 12 : i * 12 + 100])) for i in range(8)]
    assert {c for _, _, c in found(spark, rows)} == {0}
    assert found(spark, rows) == exact(rows)


def test_empty_table_and_other_names(spark):
    assert found(spark, []) == []
    docs = spark.createDataFrame([(1, "a b", 5), (2, "A b", 6)], "id long, body string, n_shingles long")
    got = odd_sketch.near_duplicates(docs, "id", "body").orderBy("id").collect()
    assert [tuple(r) for r in got] == [(1, 1, 1), (2, 1, 1)]


def test_estimates_follow_the_similarity(spark):
    rng = np.random.default_rng(3)
    samples = rng.integers(0, 1 << 32, (1, odd_sketch.SAMPLES), dtype=np.uint32)
    for unequal in (0, 10, 36):
        other = samples.copy()
        other[0, :unequal] ^= 12345
        a, b = (np.unpackbits(odd_sketch.odd_sketches(x)) for x in (samples, other))
        differing = int((a != b).sum())
        df = spark.range(1).select(odd_sketch.estimate(odd_sketch.F.lit(differing)).alias("e"))
        assert abs(df.first()["e"] - (1 - unequal / odd_sketch.SAMPLES)) < 0.09


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 140)] + [(7, 7), (200, 201), (201, 200)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r["node"]: r["component"] for r in components(df).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 140)}, 200: 200, 201: 200}
    assert components(df.limit(0)).count() == 0
