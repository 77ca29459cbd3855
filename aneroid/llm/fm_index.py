"""Benchmark decontamination with an FM-index per shard of the training text."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aneroid.llm.words import NOT_ALPHANUMERIC, chunks

WINDOW = 13
SHARD_WORDS = 1 << 23  # words of text behind one index
BLOCK_WORDS = 1 << 20  # words of benchmark items that are looked up in one pass
SAMPLE = 8  # every eighth text position is kept in the suffix array

SPAN = "struct<first_word: bigint, end_word: bigint, first_byte: bigint, end_byte: bigint>"


class WaveletMatrix:
    """Counts of a symbol before a position, for many positions at once: one bit plane per bit of the symbols."""

    def __init__(self, symbols: np.ndarray, largest: int):
        self.bits = max(1, int(largest).bit_length())
        self.ones: list[np.ndarray] = []  # per plane: ones before each position
        for bit in reversed(range(self.bits)):
            plane = (symbols >> bit) & 1
            count = np.zeros(len(symbols) + 1, np.int32)
            np.cumsum(plane, out=count[1:])
            self.ones.append(count)
            symbols = np.concatenate([symbols[plane == 0], symbols[plane == 1]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often ``symbol[i]`` occurs before position ``at[i]``."""
        begin, end = np.zeros_like(at), at
        for bit, count in zip(reversed(range(self.bits)), self.ones, strict=True):
            one = ((symbol >> bit) & 1).astype(bool)
            zeros = len(count) - 1 - int(count[-1])
            begin, end = (
                np.where(one, zeros + count[p], p - count[p]) for p in (begin, end)
            )
        return end - begin


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Positions of the suffixes in order, by doubling the length they are compared on. The last symbol is unique."""
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    width = 1
    while True:
        second = np.zeros_like(rank)
        second[:-width] = rank[width:] + 1
        key = rank * (len(text) + 1) + second
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        new = np.cumsum(np.concatenate([[0], ordered[1:] != ordered[:-1]]))
        rank = np.empty_like(new)
        rank[order] = new
        if new[-1] == len(text) - 1:
            return order
        width *= 2


class FMIndex:
    """Full-text index of a sequence of symbols from 1 up; 0 ends it and is not searched for."""

    def __init__(self, text: np.ndarray, largest: int):
        text = np.concatenate([text.astype(np.int64) + 1, [0]])  # separators (0) become 1
        order = suffix_array(text)
        self.size = len(text)
        last = text[order - 1]
        self.last = last
        self.tree = WaveletMatrix(last, largest + 1)
        self.before = np.searchsorted(text[order], np.arange(largest + 3))  # rows with a smaller first symbol
        self.sampled = order % SAMPLE == 0
        self.sampled_before = np.concatenate([[0], np.cumsum(self.sampled)])
        self.positions = order[self.sampled]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows [lo, hi) of the suffixes that begin with each pattern; patterns are rows of equal length."""
        lo = np.zeros(len(patterns), np.int64)
        hi = np.full(len(patterns), self.size, np.int64)
        for column in range(patterns.shape[1])[::-1]:
            symbol = patterns[:, column].astype(np.int64) + 1
            lo, hi = (self.before[symbol] + self.tree.rank(symbol, p) for p in (lo, hi))
            hi = np.maximum(lo, hi)
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffixes: steps back through the text to the next sampled position."""
        position = np.full(len(rows), -1, np.int64)
        rows, open_, steps = rows.copy(), np.arange(len(rows)), 0
        while len(open_):
            at = rows[open_]
            found = self.sampled[at]
            position[open_[found]] = self.positions[self.sampled_before[at[found]]] + steps
            open_, at = open_[~found], at[~found]
            symbol = self.last[at]
            rows[open_] = self.before[symbol] + self.tree.rank(symbol, at)
            steps += 1
        return position


class Phrases:
    """The windows of a block of benchmark items, over the numbers of the items' words."""

    def __init__(self, ids: Sequence[str | None], texts: Sequence[str | None], window: int):
        hashes, bounds = [], [0]
        for part in chunks(pa.array(texts, pa.string()), NOT_ALPHANUMERIC):
            hashes.append(part.hashes)
            bounds.extend((part.bounds[1:] + bounds[0] + sum(map(len, hashes[:-1]))).tolist())
        words = np.concatenate([*hashes, np.zeros(0, np.uint64)])
        self.vocabulary, numbers = np.unique(words, return_inverse=True)
        numbers = numbers + 1
        found: dict[int, dict[bytes, set[str]]] = {}
        for item, a, b in zip(ids, bounds, bounds[1:], strict=False):
            length = min(window, b - a)
            for i in range(a, b - length + 1) if length else ():
                owners = found.setdefault(length, {}).setdefault(numbers[i : i + length].tobytes(), set())
                owners.update(() if item is None else (item,))
        self.by_length = {
            n: (np.frombuffer(b"".join(p), numbers.dtype).reshape(len(p), n), list(p.values())) for n, p in found.items()
        }
        self.shortest = min(self.by_length, default=0)

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each word from 1 up; 0 for a word that no item has."""
        at = np.searchsorted(self.vocabulary, hashes)
        at[at == len(self.vocabulary)] = 0
        return np.where(self.vocabulary[at] == hashes, at + 1, 0)


class Shard:
    """Words of documents that can be in a match, with their places."""

    def __init__(self, phrases: Phrases):
        self.phrases = phrases
        self.parts: list[tuple[np.ndarray, ...]] = []

    def add(self, words, first_row: int) -> None:
        """Keeps the runs of benchmark words that are as long as the shortest window; no other word can be in one."""
        if not self.phrases.shortest or not len(words.hashes):
            return
        numbers = self.phrases.numbers(words.hashes)
        known = numbers > 0
        row = words.rows()
        breaks = np.flatnonzero(np.concatenate([[True], (known[1:] != known[:-1]) | (row[1:] != row[:-1]), [True]]))
        lengths = np.diff(breaks)
        run = known[breaks[:-1]] & (lengths >= self.phrases.shortest)
        at = np.flatnonzero(np.repeat(run, lengths))
        if not len(at):
            return
        run_of = np.repeat(np.arange(len(lengths)), lengths)[at]
        head = np.concatenate([[True], run_of[1:] != run_of[:-1]])
        in_row = at - words.bounds[:-1][row[at]]
        row_start = words.row_starts[row[at]]
        self.parts.append((
            numbers[at], head, row[at] + first_row, in_row, words.starts[at] - row_start, words.ends[at] - row_start
        ))

    def matches(self) -> tuple[dict[int, list[tuple[int, int, int, int]]], dict[int, set[str]]]:
        """Per row: the merged spans of all occurrences of all windows, and the items with an occurrence."""
        spans: dict[int, list[tuple[int, int, int, int]]] = {}
        items: dict[int, set[str]] = {}
        if not self.parts:
            return spans, items
        numbers, head, row, place, start, end = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        # a separator (0) before every run; text position -> word
        moved = np.arange(len(numbers)) + np.cumsum(head)
        text = np.zeros(moved[-1] + 1, np.int64)
        text[moved] = numbers
        word_at = np.zeros(len(text), np.int64)
        word_at[moved] = np.arange(len(numbers))
        index = FMIndex(text, len(self.phrases.vocabulary))
        cover = np.zeros(len(numbers) + 1, np.int64)
        for length, (patterns, owners) in self.phrases.by_length.items():
            lo, hi = index.search(patterns)
            for p in np.flatnonzero(hi > lo):
                words = word_at[index.locate(np.arange(lo[p], hi[p]))]
                np.add.at(cover, words, 1)
                np.add.at(cover, words + length, -1)
                for r in np.unique(row[words]).tolist():
                    items.setdefault(r, set()).update(owners[p])
        hit = np.cumsum(cover[:-1]) > 0
        at = np.flatnonzero(hit)
        if len(at):
            cut = np.flatnonzero((np.diff(row[at]) != 0) | (np.diff(place[at]) != 1)) + 1
            for a, b in zip(np.concatenate([[0], cut]), np.concatenate([cut, [len(at)]]), strict=True):
                f, e = at[a], at[b - 1]
                spans.setdefault(int(row[f]), []).append((int(place[f]), int(place[e]) + 1, int(start[f]), int(end[e])))
        return spans, items


def merge(spans: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    merged: list[tuple[int, int, int, int]] = []
    for s in sorted(spans):
        if merged and s[0] <= merged[-1][1]:
            m = merged[-1]
            merged[-1] = (m[0], max(m[1], s[1]), m[2], max(m[3], s[3]))
        else:
            merged.append(s)
    return merged


def contamination(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", keep: Sequence[str] | None = None,
    item_id: str = "item_id", item_text: str = "text", window: int = WINDOW,
) -> DataFrame:
    """Adds ``n_words``, ``spans`` and ``items`` to each document.

    Words are runs of digits, letters a-z and non-ASCII characters, A-Z lower-cased. A window is ``window``
    consecutive words of an item; a shorter item is one window; an item without words has none. ``spans`` are
    the merged ranges of words (and of UTF-8 bytes) inside any occurrence of any window; ``items`` the sorted
    ids of the items with an occurrence. ``keep`` names the columns to keep (all). Columns named like the
    results are replaced. Ids of items are returned as strings, sorted as such. NULL and empty texts have 0 words;
    an item without an id marks words like any other but has no place in ``items``; repeated items count once,
    repeated documents each; empty tables give empty results.

    Each task indexes its own documents, in shards of at most ``SHARD_WORDS`` words (a longer document is a
    shard), so nothing is shuffled and documents are read as often as the benchmark has blocks of
    ``BLOCK_WORDS`` words: once, for any usual benchmark. A block is what a task gets broadcast.
    """
    results = {"n_words": "bigint", "spans": f"array<{SPAN}>", "items": "array<string>"}
    keep = [c for c in (keep or docs.columns) if c not in results]
    df = docs.select(*dict.fromkeys([*keep, text_col]))
    blocks = _blocks(benchmark, item_id, item_text)
    n, block = 0, next(blocks, ([], []))
    while block is not None:  # beside those already sent, the driver holds this block and the next
        (ids, texts), block = block, next(blocks, None)
        wanted = keep if block is None else list(dict.fromkeys([*keep, text_col]))
        schema = T.StructType([df.schema[c] for c in wanted])
        for name, kind in results.items():
            schema = schema.add(T.StructField(name, T._parse_datatype_string(kind)))
        df = df.mapInArrow(_lookup(ids, texts, text_col, wanted, window, again=n > 0), schema)
        n += 1
    return df


def _blocks(benchmark: DataFrame, item_id: str, item_text: str) -> Iterator[tuple[list[str | None], list[str]]]:
    ids, texts, size = [], [], 0
    items = benchmark.select(F.col(item_id).cast("string").alias("i"), F.col(item_text).alias("t"))
    for r in items.filter("t IS NOT NULL").toLocalIterator():
        words = len(r["t"]) // 2 + 1
        if ids and size + words > BLOCK_WORDS:
            yield ids, texts
            ids, texts, size = [], [], 0
        ids.append(r["i"])
        texts.append(r["t"])
        size += words
    if ids:
        yield ids, texts


def _lookup(ids, texts, text_col, wanted, window, again):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = Phrases(ids, texts, window)
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text_col))
            counts = np.zeros(len(column), np.int64)
            spans: dict[int, list] = {}
            items: dict[int, set] = {}
            shard, size = Shard(phrases), 0
            for part in chunks(column, NOT_ALPHANUMERIC):
                counts[part.first : part.first + len(part.bounds) - 1] = np.diff(part.bounds)
                if size and size + len(part.hashes) > SHARD_WORDS:
                    for into, new in zip((spans, items), shard.matches(), strict=True):
                        into.update(new)
                    shard, size = Shard(phrases), 0
                shard.add(part, part.first)
                size += len(part.hashes)
            for into, new in zip((spans, items), shard.matches(), strict=True):
                into.update(new)
            if again:
                for name, into in (("spans", spans), ("items", items)):
                    for r, old in enumerate(batch.column(batch.schema.get_field_index(name)).to_pylist()):
                        if old:
                            into[r] = merge([*into.get(r, []), *(tuple(s.values()) for s in old)]) if name == "spans" else {*into.get(r, ()), *old}
            kind = pa.list_(pa.struct([(c, pa.int64()) for c in ("first_word", "end_word", "first_byte", "end_byte")]))
            names = ("first_word", "end_word", "first_byte", "end_byte")
            rows = [[dict(zip(names, s, strict=True)) for s in spans.get(r, ())] for r in range(len(column))]
            columns = [batch.column(batch.schema.get_field_index(c)) for c in wanted]
            yield pa.RecordBatch.from_arrays(
                [
                    *columns, pa.array(counts, pa.int64()), pa.array(rows, kind),
                    pa.array([sorted(items.get(r, ())) for r in range(len(column))], pa.list_(pa.string())),
                ],
                names=[*wanted, "n_words", "spans", "items"],
            )

    return run
