"""Toxicity, quality and language-model operators: held-out accuracy and brute force."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from aneroid.llm import compression, pitman_yor, pu_learning, sampling
from aneroid.llm.queries import trained_on

SYLLABLES = ["the", "ing", "er", "an", "re", "on", "at", "en", "nd", "ti", "es", "or"]
INSULTS = ["moronic", "scumbag", "worthless", "trashy"]


def ordinary(rng, n=60):
    return " ".join("".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4))) for _ in range(n))


def toxic(rng):
    words = ordinary(rng).split()
    for _ in range(3):
        words[rng.randrange(len(words))] = rng.choice(INSULTS) + rng.choice(["", ",", ".", "!"])
    return " ".join(words).capitalize()


@pytest.fixture(scope="module")
def toxicity():
    rng = random.Random(1)
    return compression.fit([toxic(rng) for _ in range(120)], [ordinary(rng) for _ in range(300)])


def test_toxic_texts_are_told_apart(toxicity):
    rng, scorer = random.Random(2), toxicity.scorer()
    assert sum(scorer.score(toxic(rng)) >= 0.5 for _ in range(100)) >= 97
    assert sum(scorer.score(ordinary(rng)) >= 0.5 for _ in range(300)) <= 3


def test_a_late_window_of_a_very_long_text_counts(toxicity):
    rng, scorer = random.Random(3), toxicity.scorer()
    long = ordinary(rng, 40_000)
    assert scorer.score(long) < 0.5 <= scorer.score(f"{long} {' '.join(INSULTS)}")


def test_passages_copied_into_many_toxic_texts_are_no_marks():
    rng = random.Random(4)
    passage = "zyxwvut qponmlk jihgfed"
    model = compression.fit([f"{passage} {toxic(rng)}" for _ in range(120)], [ordinary(rng) for _ in range(300)])
    assert b"qponmlk" not in model.toxic and b"scumbag" in model.toxic


def test_surroundings_are_counted_the_same_way_at_every_vocabulary():
    few = ["a mark b", "a mark c", "a mark c", "d mark b"]
    assert compression.contexts(few)[b"mark"] == 3
    many = [*few, " ".join(f"{i:x}z" for i in range((1 << 20) + 10))]
    assert compression.contexts(many)[b"mark"] == 3


def test_scores_in_spark(spark, toxicity):
    rows = [(1, None), (2, ""), (3, "x" * 5000), (4, " ".join(INSULTS)), (4, " ".join(INSULTS))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["s"] for r in df.select("doc_id", compression.score(df, toxicity).alias("s")).collect()}
    assert got[1] == got[2] < 0.5 <= got[4] and all(0 <= x <= 1 for x in got.values())
    assert df.limit(0).select(compression.score(df, toxicity)).count() == 0


@pytest.mark.parametrize(("bad", "good"), [([], ["a"]), (["a"], []), ([], [])])
def test_labels_of_one_kind_reject_nothing(bad, good):
    assert 0 <= compression.fit(bad, good).scorer().score("any text") < 0.5


def junk(rng):
    kind = rng.randrange(3)
    words = ordinary(rng).split()
    if kind == 0:
        return " ".join(w.upper() + "!!" for w in words)
    return " ".join(w + rng.choice(["***", "$$$"]) for w in words) if kind == 1 else " ".join([words[0]] * 60)


def test_positives_and_unlabelled_texts_are_enough():
    rng = random.Random(5)
    model = pu_learning.fit([ordinary(rng) for _ in range(300)], [junk(rng) if i % 5 == 0 else ordinary(rng) for i in range(1000)])
    assert 0.7 <= model.prior <= 0.95
    good = model.probability(np.array([pu_learning.statistics(ordinary(rng)) for _ in range(200)]))
    bad = model.probability(np.array([pu_learning.statistics(junk(rng)) for _ in range(200)]))
    assert (good >= 0.3).mean() >= 0.98 and (bad < 0.3).mean() >= 0.9


def test_quality_of_odd_texts(spark):
    rng = random.Random(6)
    model = pu_learning.fit([ordinary(rng) for _ in range(50)], [ordinary(rng) for _ in range(50)])
    df = spark.createDataFrame([(1, None), (2, ""), (3, "\n"), (4, "w " * 50_000)], "doc_id long, text string")
    got = {r[0]: r[1] for r in df.select("doc_id", pu_learning.score(df, model)).collect()}
    assert got[1] == got[2] == got[3] and all(0 <= x <= 1 for x in got.values())
    assert pu_learning.fit([], ["a"]).probability(np.zeros((1, 12)))[0] == 0.5
    assert pu_learning.fit(["a"], []).probability(np.zeros((1, 12)))[0] > 0.5


def test_samples_are_bounded_and_do_not_depend_on_order(spark):
    docs = spark.createDataFrame([(i, f"text {i}" * (1 + i % 5)) for i in range(300)] + [(None, "x"), (7, None)], "doc_id long, text string")
    ids = spark.range(250).withColumnRenamed("id", "doc_id")
    some = sampling.bounded(docs, ids, rows=40, megabytes=1)
    assert len(some) == 40 and sorted(some) == sorted(sampling.bounded(docs.orderBy(F.desc("text")), ids, rows=40, megabytes=1))
    assert len(sampling.bounded(docs, ids, rows=1000, megabytes=1)) == 250
    assert sampling.bounded(docs, ids, rows=40, megabytes=0) == []
    assert sampling.bounded(docs, ids.limit(0), rows=40, megabytes=1) == []


def test_long_texts_and_copies_take_no_room_from_the_others(spark):
    ids = spark.range(300).withColumnRenamed("id", "doc_id")
    first = [r[0] for r in ids.orderBy(F.xxhash64("doc_id")).limit(12).collect()]
    text = {i: f"text {i}" for i in range(300)}
    text |= {first[0]: "x" * (2 << 20), **{i: f"{i}" + "y" * 300_000 for i in first[1:6]}}
    rows = [*text.items(), *[(first[6], text[first[6]])] * 500]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    everything = sampling.bounded(docs, ids, rows=1000, megabytes=1)
    assert sorted(t for t in everything if len(t) < 100) == sorted(t for t in text.values() if len(t) < 100)
    assert len(everything) == 294 + 3 and sum(map(len, everything)) <= 1 << 20  # three of the long ones fill the rest
    some = sampling.bounded(docs, ids, rows=40, megabytes=1)
    assert len(some) == len(set(some)) == 40 and max(map(len, some)) < 100
    without = docs.filter(~F.col("doc_id").isin(first))
    assert len(sampling.bounded(without, ids, rows=10, megabytes=1)) == 10  # further ids are looked up


def corpus(n=150):
    rng = random.Random(8)
    nouns = [f"n{i}" for i in range(30)]
    rows = []
    for i in range(n):
        at, words = rng.choice(nouns), []
        for _ in range(rng.randint(0, 60)):
            words.append(at)
            at = nouns[(nouns.index(at) * 7 + rng.randint(0, 2)) % 30] if rng.random() < 0.9 else rng.choice(nouns)
        rows.append((i, " ".join(words).title() if i % 2 else " ".join(words)))
    return rows


def scores(spark, rows, train=None):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return pitman_yor.score_corpus(df, trained_on(7, 2) if train is None else train).collect()


def test_base_scores_and_counts_match_brute_force(spark):
    rows = [*corpus(), (900, None), (901, ""), (902, "n1 n1 unknown É"), (3, corpus()[3][1]), (None, "n1 n2")]
    import zlib

    tokens = [[*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), "</>"] for _, t in rows]
    held = [i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows]
    counts = Counter(w for t, h in zip(tokens, held, strict=True) if not h for w in t)
    n, v = counts.total(), len(counts)
    expected = sorted((
        (i, len(t), sum(w in counts for w in t), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in t), 6))
        for (i, _), t in zip(rows, tokens, strict=True)
    ), key=str)
    got = sorted(((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in scores(spark, rows)), key=str)
    assert got == expected


def test_contexts_help_on_held_out_texts_and_reruns_agree(spark):
    rows = corpus()
    got = {r["doc_id"]: r for r in scores(spark, rows)}
    import zlib

    held = [r for i, r in got.items() if zlib.crc32(str(i).encode()) % 7 == 2]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held) * 0.75
    again = {r["doc_id"]: r["score"] for r in scores(spark, rows[::-1])}
    assert again == pytest.approx({i: r["score"] for i, r in got.items()})
    assert all(r["score"] < 0 for r in got.values())


def test_no_training_rows_and_empty_tables(spark):
    got = scores(spark, [(1, "a b"), (2, None)], F.lit(False))
    assert [(r["n_tokens"], r["n_known"], r["train_tokens"]) for r in sorted(got)] == [(3, 0, 0), (1, 0, 0)]
    assert all(math.isfinite(r["score"]) for r in got)
    assert scores(spark, []) == []


def one_part(tokens, hot=()):
    """A Part over all tokens, and the function that scores with its own sums."""
    blobs = []
    w, u, flagged = (np.array(x) for x in zip(*tokens, strict=True))
    order = np.argsort(w, kind="stable")
    words, counts = np.unique(w, return_counts=True)
    blobs.append((0, pitman_yor.pack(words.astype(np.uint64), counts.astype(np.uint32), pitman_yor._planes(u[order].astype(np.uint64)), flagged[order].astype(np.uint16))))
    part = pitman_yor.Part(blobs, 1, np.array(hot, np.uint64), pitman_yor.Settings(), 0)
    return part, part.score(part.sums()[1], part.scalars())


def test_predictive_probabilities_add_up_to_one():
    rng = np.random.default_rng(2)
    train = [(int(w) % 20 + 1, int(u) % 5 + 1, 1) for w, u in rng.zipf(1.5, (2000, 2))]
    probe = [(w, u, 2) for u in range(1, 6) for w in range(1, 21)]  # row 1, not trained on
    for hot in ((), (1, 2)):
        part, (_, model, _, n) = one_part([*train, *probe], hot)
        assert n == 2000
        own = part.token_row == 1
        seen = set(np.array(train)[:, 0].tolist())
        by_context: dict[int, float] = {}
        for c, w, p in zip(part.contexts[part.pair_context[part.token_pair[own]]], part.words[part.pair_word[part.token_pair[own]]], 10 ** model[own], strict=True):
            if int(w) in seen:
                by_context[int(c)] = by_context.get(int(c), 0) + p
        assert len(by_context) == 5 and all(0.97 < x < 1 for x in by_context.values())  # the rest is for unknown words


def test_hot_words_are_counted_whole(spark):
    rows = [(i, "is " * 200 + f"w{i}") for i in range(40)]
    got = scores(spark, rows)
    assert all(r["n_known"] in (201, 202) for r in got) and len({r["train_tokens"] for r in got}) == 1


def test_scores_do_not_depend_on_the_number_of_parts(spark):
    rng = np.random.default_rng(3)
    words = [f"w{x}" for x in np.minimum(rng.zipf(1.3, 20_000), 400)]
    texts = [" ".join(words[i : i + 50] + ["regardless", "of"] * 3 + [f"once{i}"]) for i in range(0, len(words), 50)]
    probe = (-1, "regardless of")
    before, got = spark.conf.get("spark.sql.shuffle.partitions"), {}
    try:
        for parts in (1, 8, 200):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            rows = scores(spark, [*enumerate(texts), probe], F.col("doc_id") >= 0)
            got[parts] = {r["doc_id"]: r["score"] for r in rows}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert sum(got[8].values()) == pytest.approx(sum(got[1].values()), rel=0.003)
    assert sum(got[200].values()) == pytest.approx(sum(got[1].values()), rel=0.003)
    assert got[8][-1] == pytest.approx(got[1][-1], abs=0.05) and got[200][-1] == pytest.approx(got[1][-1], abs=0.05)


def exact_law(c, a, d):
    """Probabilities of t = 1..c tables, by adding up the weights of all seatings."""
    t, weights = np.arange(1, c + 1), np.where(np.arange(c) == 0, 0.0, -np.inf)
    with np.errstate(divide="ignore"):
        for i in range(1, c):
            weights = np.logaddexp(weights + np.log(np.maximum(i - d * t, 0)), np.concatenate([[-np.inf], weights[:-1]]))
    p = weights + t * np.log(a)
    p = np.exp(p - p.max())
    return p / p.sum()


@pytest.mark.parametrize("c, a, d", [(2, 1.0, 0.8), (20, 1.0, 0.8), (60, 1.0, 0.8), (60, 10.0, 0.8), (40, 0.05, 0.6), (300, 3.0, 0.8), (1500, 3.0, 0.6), (1500, 200.0, 0.8), (300, 40.0, 0.6), (300, 0.01, 0.8), (1500, 0.05, 0.8)])
def test_seating_follows_the_exact_law(c, a, d):
    n, p, t = 20_000, exact_law(c, a, d), np.arange(1, c + 1)
    mean = (p * t).sum()
    variance = (p * t * t).sum() - mean**2
    tables = pitman_yor.seat(np.full(n, c) if c <= pitman_yor.EXACT else np.full(2000, c), np.full(n, a), d, np.random.default_rng(1))
    assert tables.mean() == pytest.approx(mean, abs=5 * np.sqrt(variance / len(tables)) + 0.01 * mean)
    assert tables.var() == pytest.approx(variance, rel=0.15, abs=0.01)


def reseated(c, a, d, rounds, rng):
    """Tables of one dish while customers leave and come back one by one."""
    sizes, seen = [1] * c, []
    for _ in range(rounds):
        for _ in range(c):
            i = rng.choices(range(len(sizes)), sizes)[0]
            sizes[i] -= 1
            sizes = [x for x in sizes if x]
            k = rng.choices(range(len(sizes) + 1), [*(x - d for x in sizes), a])[0]
            sizes = [x + (j == k) for j, x in enumerate(sizes)] + [1] * (k == len(sizes))
        seen.append(len(sizes))
    return np.mean(seen[rounds // 10 :])


def test_seating_equals_customer_by_customer_sampling():
    rng = random.Random(4)
    for c, a, d in ((6, 2.0, 0.8), (20, 1.0, 0.5)):
        tables = pitman_yor.seat(np.full(20_000, c), np.full(20_000, a), d, np.random.default_rng(2))
        assert tables.mean() == pytest.approx(reseated(c, a, d, 3000, rng), rel=0.05)


def test_seating_of_few_and_without_new_tables():
    assert pitman_yor.seat(np.array([400, 3, 1, 0]), np.zeros(4), 0.5, np.random.default_rng(0)).tolist() == [1, 1, 1, 0]
    assert pitman_yor.seat(np.zeros(0, np.int64), np.zeros(0), 0.5, np.random.default_rng(0)).tolist() == []
    everyone = pitman_yor.seat(np.array([400, 3]), np.full(2, 1e12), 0.5, np.random.default_rng(0))
    assert everyone.tolist() == [400, 3]


def test_packing_round_trip():
    arrays = [np.arange(5, dtype=np.uint16), np.zeros(0, np.int64), np.array([1.5, -2.0])]
    assert all((a == b).all() and a.dtype == b.dtype for a, b in zip(pitman_yor.unpack(pitman_yor.pack(*arrays)), arrays, strict=True))
    u = np.array([0, 1, (1 << 40) - 1, 123456789012], np.uint64)
    assert (pitman_yor._from_planes(pitman_yor._planes(u)) == u).all()


def test_surroundings_are_counted_once_each():
    rng = random.Random(2)
    texts = [" ".join(rng.choices(["a", "b", "c.", '"D"', "e", "ff"], k=rng.randrange(30))) for _ in range(300)] + [""]
    triples = set()
    for text in texts:
        words = [b"", *compression.windows(text), b""]
        triples |= set(zip(words, words[1:], words[2:], strict=False))
    assert compression.contexts(texts) == Counter(word for _, word, _ in triples if word)
    assert not compression.contexts([]) and not compression.contexts([""])
