"""Collocations against a brute force that counts every phrase of all documents at once."""

from __future__ import annotations

import random
import re
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from compare import connect, difference
from pyspark.sql import functions as F

from aneroid.llm import phrases, queries

SCHEMA = "doc_id long, text string, lang string, source string"


def brute_force(rows, support=100, longest=5, top=2000, absorb=100, scale=1000):
    f, n = defaultdict(Counter), Counter()
    for _, text, lang, _ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                f[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = set()
    for lang, counts in f.items():
        many = {p: a for p, a in counts.items() if a >= support}
        found = []
        for p, a in many.items():
            if len(p) < 2:
                continue
            cuts = [(scale * a * n[lang] // (many[p[:k]] * many[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            held = any(
                len(q) > len(p) and 100 * many[q] >= absorb * a and any(q[i : i + len(p)] == p for i in range(len(q)))
                for q in many
            )
            if not held:
                found.append((-score, -a, " ".join(p).encode(), many[p[:k]], many[p[k:]]))
        for rank, (score, a, p, left, right) in enumerate(sorted(found)[:top], 1):
            out.add((lang, rank, p.decode(), -a, left, right, n[lang], -score))
    return out


def corpus(seed=3, size=240):
    rng = random.Random(seed)
    words = ["new", "York", "CITY", "of", "the", "é", "日本", "a", "b", "x-1", "#"]
    breaks = [" ", " ", " ", "  ", "\t", ". ", ",", "\n", " \x0b", "!?", " ", ": "]
    rows = []
    for i in range(size):
        parts = []
        for _ in range(rng.choice([0, 1, 3, 60])):
            parts += [rng.choice([rng.choice(words), "New York City", "kick the bucket"]), rng.choice(breaks)]
        rows.append((i % 50, "".join(parts), rng.choice(["en", "en", "fr", None, "und", ""]), "s"))
    rows += [(1, "over and over and over and over", "en", None)] * 40  # overlaps, and repeated rows
    rows += [(None, None, "en", "s"), (2, "", "zz", "s"), (3, " .,;:!? \n", "yy", "s"), (4, "a b", "only", "s")]
    return rows


def result(spark, rows, parts=6, **kwargs):
    docs = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    found = phrases.collocations(docs, **kwargs)
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(set(got))
    return set(got)


@pytest.mark.parametrize("parts", [1, 6, 40])
def test_equals_brute_force(spark, parts):
    rows = corpus()
    want = brute_force(rows, support=20)
    assert len(want) > 20 and result(spark, rows, parts, support=20) == want


@pytest.mark.parametrize("options", [{"support": 2, "top": 7}, {"support": 30, "absorb": 60, "longest": 3}])
def test_options(spark, options):
    rows = corpus(5, 60)
    assert result(spark, rows, 5, **options) == brute_force(rows, **options)


def test_several_blocks_and_unknown_languages(spark, monkeypatch):
    """More candidates than a block holds, and languages whose sizes the tasks don't know."""
    rows = corpus(6)
    want = brute_force(rows, support=15)
    monkeypatch.setattr(phrases, "BLOCK", 10)
    assert result(spark, rows, 4, support=15) == want
    monkeypatch.setattr(phrases, "PAIRS", 3)
    assert result(spark, rows, 4, support=15) == want
    monkeypatch.setattr(phrases, "LANGS", 1)
    assert result(spark, rows, 4, support=15) == want


def test_hot_phrase_in_one_shard_and_long_text(spark):
    """A phrase that only one partition has; a text of 3 MB with and one without an end of a piece."""
    rows = corpus(7, 30) + [(9, "rare pair, " * 300_000, "en", "s"), (9, "no end " * 150_000, "de", "s")]
    docs = spark.createDataFrame(rows, SCHEMA).coalesce(1).union(spark.createDataFrame(corpus(8, 30), SCHEMA).coalesce(1))
    got = {tuple(r) for r in phrases.collocations(docs).collect()}
    assert got == brute_force(rows + corpus(8, 30))


def test_keys_are_grouped_in_parts():
    keys = np.random.default_rng(1).integers(0, 1000, 3 << 19)
    first, count, number = phrases._grouped(keys)
    assert (keys[first][number] == keys).all() and (np.bincount(number) == count).all() and len(first) == 1000


def test_shard_is_mined_in_parts():
    """Mining takes little memory beside the words' numbers, and counts what a shard of many parts has."""
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{x}" for x in (rng.random(1000) ** 3 * 5000).astype(int)) for _ in range(1500)]
    batch = pa.RecordBatch.from_pydict({"lang": ["en", "fr", "en"] * 500, "text": texts})

    def mine():
        shard = phrases._Shard(None)
        for part in phrases._parts(batch):
            shard.add(*part)
        tracemalloc.start()
        yield from shard.mine({"en": 10**9, "fr": 500_000}, 100, 1, 3)

    for _ in mine():
        pass
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 50 * 1_500_000  # all phrases of a length at once took 75 bytes a word

    got = Counter()
    for rows in list(mine()):
        for lang, phrase, here in zip(*(rows.column(c).to_pylist() for c in ("lang", "phrase", "here")), strict=True):
            if phrase is not None:
                assert (lang, phrase) not in got
                got[lang, phrase] = here
    tracemalloc.stop()
    want = Counter()
    for lang, text in zip(["en", "fr", "en"] * 500, texts, strict=True):
        words = text.split(" ")
        for k in (1, 2, 3):
            want.update((lang, " ".join(p)) for p in zip(*(words[j:] for j in range(k)), strict=False))
    assert got == Counter({p: a for p, a in want.items() if a >= (1 if p[0] == "en" else 2)})


def test_empty_table_and_clashing_columns(spark):
    assert result(spark, []) == set()
    rows = corpus(9, 80)
    docs = spark.createDataFrame(rows, SCHEMA)
    for name in ("phrase", "length", "here", "slack", "f", "n", "a", "l", "r", "score", "rank", "cut", "left", "right"):
        docs = docs.withColumn(name, F.lit("mine"))
    assert {tuple(r) for r in phrases.collocations(docs, support=20).collect()} == brute_force(rows, support=20)


def test_scores_beyond_64_bits(spark):
    a, left, right, n = 10**12, 3 * 10**12, 7 * 10**12, 10**13 + 7
    f = spark.createDataFrame([("x", "p q", 2, a), ("x", "p", 1, left), ("x", "q", 1, right)], "lang string, phrase string, length int, f long")
    (row,) = phrases.best_phrases(f, spark.createDataFrame([("x", n)], "lang string, n long"), 5, 100, 1000).collect()
    assert row.score == 1000 * a * n // (left * right)


def test_query_matches_sql(spark):
    sf_dir, name = "/root/testdata/sf0.001", "op11_phrases"
    assert difference(spark, connect(sf_dir), queries.QUERIES[name], queries.ORACLES[name], sf_dir) is None


@pytest.mark.parametrize("parts", [1, 4])
def test_words_that_are_names_of_languages(spark, parts):
    """A word named like another text's language, and both ways round, and words named like their own."""
    rng = random.Random(11)
    rows = [
        (i, " ".join(rng.choice(["de", "en", "und", "fr", "a"]) for _ in range(40)), rng.choice(["de", "en", None, "fr", "fr"]), "s")
        for i in range(60)
    ]
    want = brute_force(rows, support=15)
    assert {r[0] for r in want} == {"de", "en", "und", "fr"} and result(spark, rows, parts, support=15) == want


def test_phrases_whose_first_words_are_not_frequent():
    """Shards that don't know the frequent pairs may send such phrases; they must not take another one's place."""
    listed = ["a", "b", "c", "d", "a b d", "b c d", "c d", "c d d", "a b d d", "c d d a"]
    tree = phrases.Candidates.of(pa.table({"lang": ["x"] * len(listed), "phrase": listed}))
    assert [sorted(x.to_pylist()) for x in tree.phrases] == [["a", "b", "c", "d"], ["c d"], ["c d d"], ["c d d a"]]
