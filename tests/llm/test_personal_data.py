"""Personal data: base spans against the contract's own patterns, and what the words before them add."""

from __future__ import annotations

import hashlib
import random
import re
import time

from pyspark.sql import functions as F

from aneroid.llm import personal_data as P
from aneroid.llm import queries

# the contract's patterns as they stand
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def valid(kind, match):
    digits = re.sub(r"\D", "", match)
    if kind == "ip":
        return all(int(p) <= 255 for p in match.split("."))
    if kind == "card":
        return 12 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 9 <= len(digits) <= 15


def plain(text):
    found = []
    for k, (kind, pattern) in enumerate(PLAIN.items()):
        found += [(m.start(), k, m.end()) for m in re.finditer(pattern, text or "") if valid(kind, m[0])]
    return sorted(found)


def test_base_spans_equal_the_plain_patterns():
    rng = random.Random(4)
    pieces = [
        "a@b.co", "@", ".", "-", " ", "x.y", "1", "25", "255", "256", "4111 1111 1111 1111", "4111111111111111", "+1 (555) 555-1234",
        "+", "é", "日本", "10.0.0.1", "..", "%_", "0000", "\n", "a@b", "12-34-", "(", ")", "007.1.2.3",
    ]
    for _ in range(4000):
        text = "".join(rng.choices(pieces, k=rng.randrange(14)))
        assert P.base_spans(text) == plain(text), text


def test_long_runs_are_read_once():
    begin = time.perf_counter()
    for run in ("1" * 300_000, "a" * 300_000, "@" * 300_000, "1." * 150_000, "+1" + " " * 300_000, "1 " * 150_000, "a.b@" * 70_000):
        P.base_spans(run)
        list(P.unseen(run, []))
    assert time.perf_counter() - begin < 30


SCHEMA = "doc_id long, text string, spans string, base string, row string, kind string"


def corpus():
    """Seeds after `write to`, an unseen form after the same words, the same form after others, and plain texts."""
    rows = [(i, f"please write to user{i}@mail.example.com today") for i in range(30)]
    rows += [(100 + i, f"please write to user{i}(at)mail0 today") for i in range(4)]
    rows += [(200, "room user77(at)mail0x is open"), (201, "é write to\nuser1(at)mail0 and 10.0.0.1"), (None, None), (300, "")]
    rows += [(400, f"chapter the number{i}x of") for i in range(50)] + [(400, "chapter the 10.1.1.1 of")] * 3
    rows += [(500, "nothing here at all")] * 3
    return [(*r, "mine", "mine", "mine", "mine") for r in rows]


def judged(spark, rows, parts=4):
    docs = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    return [(r.doc_id, [tuple(x) for x in r.base], [tuple(x) for x in r.spans]) for r in P.personal_data(docs).collect()]


def test_words_before_seeds_find_unseen_identifiers(spark):
    rows = corpus()
    got = judged(spark, rows)
    assert len(got) == len(rows)
    texts = {r[0]: r[1] for r in rows}
    for doc_id, base, spans in got:
        text = texts[doc_id] or ""
        assert set(base) <= set(spans) and spans == sorted(spans)
        assert base == plain(text) or doc_id == 400
        added = [text[s:e] for s, k, e in spans if (s, k, e) not in base]
        if doc_id is not None and 100 <= doc_id < 104 or doc_id == 201:
            assert len(added) == 1 and "(at)mail0" in added[0]
            assert all(k == 0 for s, k, e in spans if (s, k, e) not in base)
        else:
            assert not added
    assert sorted(map(repr, judged(spark, rows, 1))) == sorted(map(repr, got))


def test_scores_equal_plain_iteration(spark):
    edges = [
        (1, 10, 0, 3), (1, 11, 0, 1), (1, 12, 0, 2), (1, 90, -1, 2), (2, 90, -1, 1), (2, 13, 0, 5), (2, 14, 0, 1), (2, 15, 0, 1),
        (2, 91, -1, 4), (3, 91, -1, 1), (3, 20, 1, 1), (3, 21, 1, 1), (3, 22, 1, 1), (4, 92, -1, 3), (4, 30, 2, 1),
    ]
    links = [(p, i, n) for p, i, k, n in edges if k < 0]
    known = {1: (0, 6, 8), 2: (0, 7, 12), 3: (1, 3, 4)}
    p = {x: hits / (of + 3) for x, (_, hits, of) in known.items()}
    seen = {i: sum(n for _, j, n in links if j == i) for _, i, _ in links}
    for _ in range(200):
        s = {(i, known[x][0]): 0.0 for x, i, _ in links if x in known}
        for x, i, n in links:
            if x in known:
                s[i, known[x][0]] += n * p[x] / seen[i]
        p = {x: (hits + sum(n * s[i, k] for y, i, n in links if y == x)) / (of + 3) for x, (k, hits, of) in known.items()}
    best = {i: max((v, -k) for (j, k), v in s.items() if j == i) for i, _ in s}
    want = {(x, i, known[x][0]) for x, i, _ in links if x in known and p[x] >= 0.4 and best[i][0] >= 0.4 and -best[i][1] == known[x][0]}
    frame = spark.createDataFrame(edges, "pattern long, instance long, kind int, n long")
    assert want and {tuple(r) for r in P.confident(frame, 0.4, 3, 1e-9).collect()} == want


def test_empty_table(spark):
    assert judged(spark, []) == []


def test_query_over_the_given_tables(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = queries.op12_personal_data(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        base = [f"{P.KINDS[k]}:{s}:{e}" for s, k, e in plain(texts[r.doc_id])]
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(b.startswith(k + ":") for b in base) for k in P.KINDS]
        assert set(base) <= set(r.spans.split(",")) | ({""} if not base else set())
