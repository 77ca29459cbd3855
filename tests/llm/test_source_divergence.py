"""Divergence of sources against a dense brute force that never collapses copies."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import pytest
from compare import connect, difference
from pyspark.sql import functions as F

from aneroid.llm import queries, slices, source_divergence
from aneroid.llm.source_divergence import NOT_LETTER

SCHEMA = "doc_id long, text string, lang string, source string"
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def brute_force(rows, least=30, top=50, scale=10**9):
    documents, counts, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        terms = TERM.findall(lower(text or ""))
        documents[lang].update(set(terms))
        counts[lang, source].update(terms)
    out = set()
    for lang, source in groups:
        kept = [t for t, n in documents[lang].items() if n >= least]

        def shares(names):
            count = Counter()
            for name in names:
                count.update({t: counts[lang, name][t] for t in kept})
            total = sum(count.values()) + 5 * len(kept)
            return {t: 1 + scale * (count[t] + 5) // total for t in kept}

        mine = shares([source])
        others = {s for la, s in groups if la == lang} - {source}
        pairs = []
        for other in others:
            theirs = shares([other])
            pairs.append((-sum(abs(mine[t] - theirs[t]) for t in kept), other.encode(), "pair"))
        whole = shares([s for la, s in groups if la == lang])
        over = [
            (whole[t] - mine[t], t.encode(), "term") for t in kept if counts[lang, source][t] and mine[t] > whole[t]
        ]
        for part in (sorted(pairs), sorted(over)[:top]):
            out |= {(lang, source, kind, item.decode(), -v, i) for i, (v, item, kind) in enumerate(part, 1)}
    return out


def result(spark, rows, **kwargs):
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    found = source_divergence.divergence(docs, **kwargs)
    assert found.columns == ["lang", "source", "part", "item", "value", "rank"]
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(set(got))
    return set(got)


def corpus(seed=1):
    """A hot source, one text copied within and across sources, ties, NULLs, texts without terms."""
    rng = random.Random(seed)
    words = ["Éa", "über", "ÑU", "ab", "AB", "aB9cd", "x", "y", "日本", "the", "of"]
    rows = []
    for i in range(300):
        source = "hot" if i % 3 == 0 else rng.choice(["a", "b", "", None, "é"])
        lang = rng.choice(["en", "en", "fr", None, ""])
        n = rng.choice([0, 1, 5, 40])
        rows.append((i, " ".join(rng.choices(words, k=n)), lang, source))
    copy = "the same, THE same; über"
    rows += [(1000 + i % 7, copy, "en", ["hot", "a", None][i % 3]) for i in range(120)]
    rows += [(None, None, "en", "empty"), (5, "", "en", "empty"), (6, "1 2 3 --", "zz", "one"), (7, "lone words", "yy", "q")]
    rows += [(8, "lone words", "yy", "r")]
    return rows


@pytest.mark.parametrize("least, top", [(30, 50), (1, 3), (10_000, 50)])
def test_equals_brute_force(spark, least, top):
    rows = corpus()
    assert result(spark, rows, least_documents=least, top=top) == brute_force(rows, least, top)


def test_small_flushes_and_long_texts(spark, monkeypatch):
    rows = corpus(2) + [(1, "word und OF " * 30_000, "en", "long"), (1, "x" * 200_000, "en", "long")]
    want = brute_force(rows, 2, 50)
    assert result(spark, rows, least_documents=2) == want


def test_steps_over_many_sources():
    """A text of many sources goes out in several steps with the same sums."""
    monkey = source_divergence.FLUSH_PAIRS
    source_divergence.FLUSH_PAIRS = 2
    try:
        import pyarrow as pa

        batch = pa.RecordBatch.from_pylist(
            [{"lang": "en", "text": "a b a", "copies": [{"source": f"s{i}", "m": i + 1} for i in range(9)]}] * 2
        )
        out = Counter()
        for part in source_divergence._count(iter([batch, batch])):
            for r in part.to_pylist():
                out[r["source"], r["term"]] += r["n"]
    finally:
        source_divergence.FLUSH_PAIRS = monkey
    assert out == {(f"s{i}", t): 4 * n * (i + 1) for i in range(9) for t, n in (("a", 2), ("b", 1))}


def test_empty_table_and_clashing_columns(spark):
    assert result(spark, []) == set()
    rows = corpus()
    docs = spark.createDataFrame(rows, SCHEMA)
    for name in ("term", "n", "df", "digest", "copies", "m", "p", "q", "v", "all", "none", "item", "value", "rank"):
        docs = docs.withColumn(name, F.lit("mine"))
    assert {tuple(r) for r in source_divergence.divergence(docs).collect()} == brute_force(rows)


def test_shares_are_exact_beyond_64_bits(spark):
    count = 9_000_000_000_000_000
    row = spark.range(1).select(
        source_divergence._share(F.lit(count), F.lit(3 * count + 1), 10**9).alias("p")
    ).first()
    assert row.p == 1 + 10**9 * (count + 5) // (3 * count + 1)


def test_slices_cut_after_a_break():
    data = b"one two three. four" * 50
    parts = list(slices.cut(data, NOT_LETTER, 40))
    assert b"".join(parts) == data and all(len(p) <= 60 for p in parts)
    assert all(NOT_LETTER[p[-1]] for p in parts[:-1])
    assert list(slices.cut(b"x" * 100, NOT_LETTER, 40)) == [b"x" * 100]


def test_query_matches_sql(spark):
    sf_dir, name = "/root/testdata/sf0.001", "op13_source_divergence"
    assert difference(spark, connect(sf_dir), queries.QUERIES[name], queries.ORACLES[name], sf_dir) is None
