"""Word splitting, the FM-index and decontamination against brute force."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from aneroid.llm import fm_index
from aneroid.llm.words import NOT_ALPHANUMERIC, SPACES, chunks, hash_of

SPACE_WORD, PLAIN_WORD = r"[^\x20\x09-\x0D]+", r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="aAzZ09 \t\n\x0b.é 　漢_-", max_size=30)), max_size=8)


def lower(text: str | None) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def split(texts, breaks) -> list[list[str]]:
    out = []
    for part in chunks(texts, breaks):
        for a, b in zip(part.bounds, part.bounds[1:], strict=False):
            words = [bytes(part.data[s:e]) for s, e in zip(part.starts[a:b], part.ends[a:b], strict=True)]
            assert [hash_of(w) for w in words] == part.hashes[a:b].tolist()
            out.append([w.decode() for w in words])
    return out


@settings(max_examples=100, deadline=None)
@given(TEXTS, st.integers(0, 3))
def test_words_match_the_regular_expression(texts, skip):
    for breaks, pattern in ((SPACES, SPACE_WORD), (NOT_ALPHANUMERIC, PLAIN_WORD)):
        array = pa.array(texts, pa.string())[skip:]
        assert split(array, breaks) == [re.findall(pattern, lower(t)) for t in texts[skip:]]


def test_a_text_longer_than_a_chunk_stays_whole(monkeypatch):
    monkeypatch.setattr("aneroid.llm.words.CHUNK_BYTES", 16)
    texts = ["a b", "word " * 50, None, "", "x" * 40, "c d"]
    assert split(pa.array(texts), SPACES) == [(t or "").split() for t in texts]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 4), min_size=1, max_size=60), st.lists(st.integers(1, 4), min_size=1, max_size=4))
def test_index_finds_every_occurrence(text, pattern):
    index = fm_index.FMIndex(np.array([0, *text]), 4)
    lo, hi = index.search(np.array([pattern]))
    found = sorted(index.locate(np.arange(lo[0], hi[0])).tolist())
    assert found == [i + 1 for i in range(len(text)) if text[i : i + len(pattern)] == pattern]


def brute_force(documents, items, window=13):
    windows = {}
    for item, text in items:
        words = re.findall(PLAIN_WORD, lower(text))
        n = min(window, len(words))
        for i in range(len(words) - n + 1) if n else ():
            windows.setdefault(tuple(words[i : i + n]), set()).update(() if item is None else (str(item),))
    out = []
    for key, text in documents:
        words, hit, found = re.findall(PLAIN_WORD, lower(text)), set(), set()
        for n in {len(w) for w in windows}:
            for i in range(len(words) - n + 1):
                if (owners := windows.get(tuple(words[i : i + n]))) is not None:
                    hit |= set(range(i, i + n))
                    found |= owners
        out.append((key, len(words), sorted(hit), sorted(found)))
    return out


def found(spark, documents, items):
    docs = spark.createDataFrame(documents, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = fm_index.contamination(docs, bench).collect()
    return [
        (r["doc_id"], r["n_words"], [i for s in r["spans"] for i in range(s["first_word"], s["end_word"])], r["items"])
        for r in rows
    ]


PASSAGE = " ".join(f"w{i}" for i in range(20))
ITEMS = [(1, PASSAGE), (2, "Short one"), (3, "solo"), (4, ""), (5, None), (2, "Short one"), (6, " ".join(["go"] * 15)), (None, "w0")]
DOCUMENTS = [
    (1, f"before {PASSAGE} after"), (2, f"x {PASSAGE.upper()}, {PASSAGE}"), (3, " ".join(f"w{i}" for i in range(12))),
    (4, "a short-one b; solo!"), (5, ""), (6, None), (None, "solo"), (1, "solo"), (7, " ".join(["go"] * 40)),
    (8, " ".join(f"w{i}" for i in range(7)) + " short one " + " ".join(f"w{i}" for i in range(7, 20))),
    (9, "filler " * 30_000 + PASSAGE), (1, "solo"),
]


def ordered(rows):
    return sorted(rows, key=str)


def test_contamination_matches_brute_force(spark):
    assert ordered(found(spark, DOCUMENTS, ITEMS)) == ordered(brute_force(DOCUMENTS, ITEMS))


def test_benchmark_in_several_blocks_and_shards_gives_the_same(spark, monkeypatch):
    monkeypatch.setattr(fm_index, "BLOCK_WORDS", 3)
    assert ordered(found(spark, DOCUMENTS, ITEMS)) == ordered(brute_force(DOCUMENTS, ITEMS))


def test_blocks_are_sent_one_at_a_time(spark, monkeypatch):
    blocks, lookup, read, sent = fm_index._blocks, fm_index._lookup, [], []

    def reading(*args):
        for block in blocks(*args):
            read.append(block)
            yield block

    def sending(*args, **kwargs):
        sent.append(len(read))
        return lookup(*args, **kwargs)

    monkeypatch.setattr(fm_index, "BLOCK_WORDS", 3)
    monkeypatch.setattr(fm_index, "_blocks", reading)
    monkeypatch.setattr(fm_index, "_lookup", sending)
    assert ordered(found(spark, DOCUMENTS, ITEMS)) == ordered(brute_force(DOCUMENTS, ITEMS))
    assert len(read) > 2 and sent == [min(n + 2, len(read)) for n in range(len(read))]


@pytest.mark.parametrize(("documents", "items"), [([], ITEMS), (DOCUMENTS, []), ([], [])])
def test_empty_tables(spark, documents, items):
    assert ordered(found(spark, documents, items)) == ordered(brute_force(documents, items))


def test_ids_of_items_may_be_strings_or_missing(spark):
    docs = spark.createDataFrame([(1, "a solo b go")], "doc_id long, text string")
    bench = spark.createDataFrame([("x-1", "solo"), (None, "go"), ("10", "b"), ("9", "b")], "item_id string, text string")
    row = fm_index.contamination(docs, bench).first()
    assert row["items"] == ["10", "9", "x-1"]
    assert [(s["first_word"], s["end_word"]) for s in row["spans"]] == [(1, 4)]


def test_bytes_of_spans_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "é Solo x", 7, "e")], "doc_id long, text string, n_words long, spans string")
    row = fm_index.contamination(docs, spark.createDataFrame([(3, "solo")], "item_id long, text string")).first()
    assert row.asDict()["n_words"] == 3
    span = row["spans"][0]
    assert "é Solo x".encode()[span["first_byte"] : span["end_byte"]] == b"Solo"


def test_random_documents(spark):
    rng = np.random.default_rng(1)
    text = lambda n: " ".join(f"v{x}" for x in rng.integers(0, 5, n))
    items = [(i, text(int(n))) for i, n in enumerate(rng.integers(1, 18, 30))]
    documents = [(i, text(int(n))) for i, n in enumerate(rng.integers(0, 80, 60))]
    assert ordered(found(spark, documents, items)) == ordered(brute_force(documents, items))
