"""Collocations by partitioned mining: every phrase that is frequent in a language, scored by its weakest cut.

A task cuts its documents into shards that fit its memory and mines each shard completely, level by level, at a
support lowered to the shard's part of the language's words. A phrase that reaches the support overall reaches
the lowered one in some shard, so the union of what the shards found misses none. What a shard
didn't find it has at most ``support - 1`` times at its own lowered support; phrases that can't reach the
support even so are dropped, and the rest is counted in all documents.

The lowered support is ``MOST`` at most: a higher one leaves more to be found elsewhere, and so many more candidates,
and makes the work a GB depend on the size of the whole. With very many shards it is 1, and the shards' own counts are exact.

This is done twice: for words and pairs, and then for longer phrases, of which the shards look only at those whose
every pair is frequent overall.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aneroid.llm.slices import gather, sliced
from aneroid.llm.words import Words, chunks, hash_of, mix
from aneroid.scratch import stored

# Bytes between pieces, and those between words.
ENDS_PIECE = np.zeros(256, bool)
ENDS_PIECE[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
ENDS_WORD = ENDS_PIECE.copy()
ENDS_WORD[[0x20, 0x09]] = True
WORD = r"[^\x20\x09.,;:!?\x0A-\x0D]+"

SHARD_BYTES = 24 << 20  # of text that a task mines at once
PAIRS = 2_000_000  # frequent words and pairs that the tasks may know
BLOCK = 1_000_000  # candidates that are counted in one pass over the documents
MOST = 2  # occurrences that a shard may ask of a phrase
NODES = 1 << 14  # candidates whose counts are one row of a task
LANGS = 10_000  # languages whose sizes the tasks know; the shards keep every phrase of others
MINED = "lang string, phrase string, length int, here long, slack long"


def _seed(lang: str) -> np.uint64:
    # mixed once more: else the word "en" in "de" has the key of "de" in "en", and a language's name the same key in each
    return mix(np.array([hash_of(lang.encode())], np.uint64))[0]


def _follows(part: Words) -> np.ndarray:
    """For each word whether the next one is in the same piece."""
    breaks = np.cumsum(ENDS_PIECE[part.data], dtype=np.int64)
    rows = part.rows()
    same = np.zeros(len(part.hashes), bool)
    if len(same):
        same[:-1] = (rows[1:] == rows[:-1]) & (breaks[part.starts[1:] - 1] == breaks[part.ends[:-1] - 1])
    return same


def _parts(batch: pa.RecordBatch) -> Iterator[tuple[Words, list[str], np.ndarray, np.ndarray]]:
    """Words, the languages of the batch, and for each word its language's number and its 64-bit key there."""
    coded = pc.dictionary_encode(batch.column("lang"))
    langs, lang_of = coded.dictionary.to_pylist(), np.asarray(coded.indices)
    seeds = np.array([_seed(x) for x in langs], np.uint64)
    texts, row_of = sliced(batch.column("text"), ENDS_PIECE)
    for part in chunks(texts, ENDS_WORD):
        if len(part.hashes):
            lang = lang_of[row_of[part.first + part.rows()]]
            yield part, langs, lang, mix(part.hashes ^ seeds[lang])


def _grouped(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first position and the count of each different key, and for each position its key's number."""
    parts = 1 + (len(keys) >> 19)  # sorted one after the other, as sorting takes several times the memory
    number = np.empty(len(keys), np.int32)
    firsts, counts, n = [], [], 0
    bucket = None
    if parts > 1:
        bucket = np.empty(len(keys), np.int32)
        np.remainder(keys, parts, out=bucket, casting="unsafe")
    for p in range(parts):
        at = np.arange(len(keys)) if bucket is None else np.flatnonzero(bucket == p)
        different, first, inverse, count = np.unique(keys[at], return_index=True, return_inverse=True, return_counts=True)
        number[at] = n + inverse
        firsts.append(at[first])
        counts.append(count)
        n += len(different)
    return np.concatenate(firsts), np.concatenate(counts), number


class _Shard:
    """Words of some documents, numbered per language; with ``pairs``, only words in frequent pairs."""

    def __init__(self, pairs: Candidates | None) -> None:
        self.pairs = pairs
        self.bytes = 0
        self.names: dict[str, int] = {}
        self.n_words: dict[int, int] = {}
        self.keys: list[np.ndarray] = []
        self.words: list[pa.Array] = []
        self.langs: list[np.ndarray] = []
        self.codes: list[np.ndarray] = []
        self.follows: list[np.ndarray] = []

    def add(self, part: Words, langs: list[str], lang: np.ndarray, key: np.ndarray) -> None:
        ids = np.array([self.names.setdefault(x, len(self.names)) for x in langs])
        for i, n in enumerate(np.bincount(lang, minlength=len(langs)).tolist()):
            self.n_words[int(ids[i])] = self.n_words.get(int(ids[i]), 0) + n
        self.bytes += len(part.data)
        lang, follows, starts, ends = ids[lang], _follows(part), part.starts, part.ends
        if self.pairs is not None:
            follows = self.pairs.pairs(key, follows)
            kept = follows.copy()
            kept[1:] |= follows[:-1]
            lang, follows, starts, ends, key = lang[kept], follows[kept], starts[kept], ends[kept], key[kept]
        keys, at, codes = np.unique(key, return_index=True, return_inverse=True)
        self.keys.append(keys)
        self.words.append(gather(part.data, starts[at], ends[at]))
        self.langs.append(lang[at].astype(np.int32))
        self.codes.append(codes.astype(np.int32))
        self.follows.append(follows)

    def mine(self, totals: dict[str, int], support: int, shortest: int, longest: int) -> Iterator[pa.RecordBatch]:
        """Rows of ``MINED``: the phrases that reach the lowered support, and per language one without a phrase."""
        names, present = list(self.names), np.array([i for i, n in sorted(self.n_words.items()) if n], np.int64)
        if not len(present):
            return
        least = np.ones(len(names), np.int64)
        for i in present:
            if names[i] in totals:
                least[i] = min(MOST, max(1, -(-support * self.n_words[i] // totals[names[i]])))
        yield from _rows(names, present, pa.nulls(len(present), pa.string()), 0, np.zeros(len(present), np.int64), least)

        words, lang_of, word, follows = self._numbered()
        gram, alive = word.copy(), np.ones(len(word), bool)
        for length in range(1, longest + 1):
            if length > 1:
                # both shorter phrases within have to be frequent here
                alive[:-1] &= alive[1:]
                if length == 2:
                    alive &= follows
            if not alive.any():
                return

            def key(at: np.ndarray, length: int = length) -> np.ndarray:
                keys = gram[at].astype(np.int64)
                if length > 1:
                    keys *= len(words)
                    keys += word[at + (length - 1)]
                return keys

            n = 0
            for at in _dealt(alive, key):
                first, count, number = _grouped(key(at))
                lang = lang_of[word[at[first]]]
                frequent = count >= least[lang]
                chosen = np.flatnonzero(frequent) if length >= shortest else []
                for i in range(0, len(chosen), 1 << 16):
                    some = chosen[i : i + (1 << 16)]
                    starts = at[first[some]]
                    texts = [words.take(pa.array(word[starts + j])) for j in range(length)]
                    yield from _rows(names, lang[some], pc.binary_join_element_wise(*texts, " "), length, count[some], least)
                ids = np.cumsum(frequent)  # from 1 on
                gram[at], alive[at] = n + ids[number] - 1, frequent[number]
                n += int(ids[-1])

    def _numbered(self) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
        """The different words, their languages, for each word its number and whether the next one follows. Empties the shard."""
        keys, follows = np.unique(np.concatenate(self.keys)), np.concatenate(self.follows)
        at, word = np.empty(len(keys), np.int64), np.empty(len(follows), np.int32)
        first, end = sum(map(len, self.keys)), len(follows)
        while self.codes:
            own, codes = self.keys.pop(), self.codes.pop()
            number = np.searchsorted(keys, own)
            first -= len(own)
            at[number] = np.arange(first, first + len(own))
            word[end - len(codes) : end] = number[codes]
            end -= len(codes)
        words = pa.chunked_array(self.words, pa.large_binary()).take(pa.array(at)).combine_chunks().cast(pa.string())
        lang_of = np.concatenate(self.langs)[at]
        self.__init__(self.pairs)
        return words, lang_of, word, follows


def _dealt(alive: np.ndarray, key: Callable[[np.ndarray], np.ndarray]) -> Iterator[np.ndarray]:
    """The marked positions in parts, those of equal keys in the same one, so that few keys are in memory at once."""
    parts = min(255, 1 + (int(np.count_nonzero(alive)) >> 18))
    part = np.full(len(alive), parts, np.uint8)  # where nothing is marked
    for i in range(0, len(alive), 1 << 18):
        at = i + np.flatnonzero(alive[i : i + (1 << 18)])
        part[at] = key(at) % parts
    for p in range(parts):
        at = np.flatnonzero(part == p)
        if len(at):
            yield at


def _rows(
    names: list[str], lang: np.ndarray, phrases: pa.Array, length: int, count: np.ndarray, least: np.ndarray
) -> Iterator[pa.RecordBatch]:
    columns = [
        pa.array(names, pa.string()).take(pa.array(lang)), phrases, pa.array(np.full(len(lang), length, np.int32)),
        pa.array(count.astype(np.int64)), pa.array(least[lang] - 1),
    ]
    yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in MINED.split(", ")])


def mined(
    docs: DataFrame, totals: dict[str, int], support: int, shortest: int, longest: int, pairs: Broadcast | None
) -> DataFrame:
    """``MINED`` of all shards. ``docs`` has ``lang`` and ``text``, neither of them NULL."""

    def mine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = None if pairs is None else pairs.value
        shard = _Shard(known)
        for batch in batches:
            for part, langs, lang, key in _parts(batch):
                shard.add(part, langs, lang, key)
                if shard.bytes >= SHARD_BYTES:
                    yield from shard.mine(totals, support, shortest, longest)
                    shard = _Shard(known)
        batch = part = lang = key = None  # a batch may be as large as the shard
        yield from shard.mine(totals, support, shortest, longest)

    return docs.mapInArrow(mine, MINED)


@dataclass
class Candidates:
    """Phrases as a tree: a node is its parent's number and its last word's, in sorted order per length."""

    keys: np.ndarray  # of words
    levels: list[np.ndarray]
    langs: list[pa.Array]  # per length, in the order of the nodes
    phrases: list[pa.Array]

    @staticmethod
    def of(table: pa.Table) -> Candidates:
        """From columns ``lang`` and ``phrase``. A phrase whose first words aren't there, too, is left out: it can't be frequent."""
        table = table.combine_chunks()
        langs, phrases = (table.column(c).cast(pa.string()).combine_chunks() for c in ("lang", "phrase"))
        coded = pc.dictionary_encode(langs)
        seeds = np.array([_seed(x) for x in coded.dictionary.to_pylist()], np.uint64)
        lang_of, found, sizes = np.asarray(coded.indices), [], []
        for part in chunks(phrases, ENDS_WORD):
            found.append(mix(part.hashes ^ seeds[lang_of[part.first + part.rows()]]))
            sizes.append(np.diff(part.bounds))
        keys, codes = np.unique(np.concatenate(found), return_inverse=True)
        size = np.concatenate(sizes)
        first = np.cumsum(size) - size
        tree = Candidates(keys, [], [], [])
        node, open_ = np.zeros(len(size), np.int64), np.arange(len(size))
        for length in range(1, int(size.max()) + 1):
            open_ = open_[size[open_] >= length]
            step = node[open_] * len(keys) + codes[first[open_] + length - 1]
            ends = size[open_] == length
            level, at = np.unique(step[ends], return_index=True)
            rows = pa.array(open_[ends][at])
            node[open_] = _index(level, step)
            open_ = open_[node[open_] >= 0]
            tree.levels.append(level)
            tree.langs.append(langs.take(rows))
            tree.phrases.append(phrases.take(rows))
        return tree

    def pairs(self, key: np.ndarray, follows: np.ndarray) -> np.ndarray:
        """For each word whether it and the next one are a pair of the tree."""
        code = _index(self.keys, key)
        node = np.where(code >= 0, _index(self.levels[0], code), -1)
        found = np.zeros(len(key), bool)
        at = np.flatnonzero(follows & (node >= 0))
        at = at[code[at + 1] >= 0]
        if len(self.levels) > 1:
            found[at] = _index(self.levels[1], node[at] * len(self.keys) + code[at + 1]) >= 0
        return found

    def count(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The occurrences of all nodes in the documents of a task, ``NODES`` in a row: ``block, counts``."""
        counts = [np.zeros(len(x), np.int64) for x in self.levels]
        for batch in batches:
            for part, _, _, key in _parts(batch):
                code = _index(self.keys, key)
                follows = _follows(part)
                starts = np.flatnonzero(code >= 0)
                node = np.zeros(len(starts), np.int64)
                for length, level in enumerate(self.levels, 1):
                    if length > 1:
                        last = starts + length - 2
                        goes_on = follows[last]
                        starts, node, last = starts[goes_on], node[goes_on], last[goes_on]
                        known = code[last + 1] >= 0
                        starts, node = starts[known], node[known]
                    found = _index(level, node * len(self.keys) + code[starts + length - 1])
                    starts, node = starts[found >= 0], found[found >= 0]
                    counts[length - 1] += np.bincount(node, minlength=len(level))
        flat = np.concatenate(counts)
        for block in range(-(-len(flat) // NODES)):
            some = flat[block * NODES : (block + 1) * NODES]
            if some.any():
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([some.tobytes()])], names=["block", "counts"])

    def add(self, batches: Iterator[pa.RecordBatch], shortest: int, support: int) -> Iterator[pa.RecordBatch]:
        """``lang, phrase, length, f`` of the frequent nodes, from the rows of all tasks in order of their blocks."""
        langs, phrases = pa.chunked_array(self.langs), pa.chunked_array(self.phrases)
        lengths = np.repeat(np.arange(1, len(self.levels) + 1, dtype=np.int32), [len(x) for x in self.levels])

        def total(block: int, counts: np.ndarray) -> pa.RecordBatch:
            at = np.flatnonzero(counts >= support)
            counts, at = counts[at], at + block * NODES
            kept = lengths[at] >= shortest
            nodes = pa.array(at[kept])
            columns = [langs.take(nodes), phrases.take(nodes)]
            columns = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns]
            return pa.RecordBatch.from_arrays([*columns, pa.array(lengths[at[kept]]), pa.array(counts[kept])], names=["lang", "phrase", "length", "f"])

        now, counts = None, None
        for batch in batches:
            for block, some in zip(batch.column("block").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                if block != now:
                    if now is not None:
                        yield total(now, counts)
                    now, counts = block, np.zeros(len(some) // 8, np.int64)
                counts += np.frombuffer(some, np.int64)
        if now is not None:
            yield total(now, counts)


def _index(ordered: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The positions of the values, -1 for those that are not there."""
    if not len(ordered):
        return np.full(len(values), -1)
    at = np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)
    return np.where(ordered[at] == values, at, -1)


def frequent_phrases(docs: DataFrame, totals: DataFrame, support: int, longest: int) -> DataFrame:
    """``lang, phrase, length, f`` of all phrases of 1 to ``longest`` words with ``f >= support``.

    ``totals`` has a row ``lang, n`` for every language. The driver holds the sizes of at most ``LANGS``
    languages, and either the frequent words and pairs or the candidates of one block. There are at most two for
    every ``support`` words; beyond ``PAIRS`` of them the shards look at longer phrases without knowing them. A
    block has whole first words, about ``BLOCK`` candidates; more candidates are more blocks.
    """
    spark = docs.sparkSession
    largest = totals.filter("n > 0").orderBy(F.col("n").desc(), "lang").limit(LANGS)
    sizes = {r.lang: r.n for r in largest.collect()}
    found = mined(docs, sizes, support, 1, min(2, longest), None)
    short = stored(_frequent(docs, found, None, support), "phrases-short")
    if longest <= 2 or short.isEmpty():
        return short
    pairs = None
    if short.count() <= PAIRS:
        pairs = spark.sparkContext.broadcast(Candidates.of(short.select("lang", "phrase").toArrow()))
    found = mined(docs, sizes, support, 3, longest, pairs)
    return short.unionByName(_frequent(docs, found, short, support))


def _frequent(docs: DataFrame, found: DataFrame, short: DataFrame | None, support: int) -> DataFrame:
    """The mined phrases that are frequent overall; ``short`` has the frequent words and pairs in them."""
    union = found.groupBy("lang", "phrase", "length").agg(F.sum("here").alias("here"), F.sum("slack").alias("slack"))
    union = stored(union, "phrases-mined")
    slack = union.filter(F.col("phrase").isNull()).select("lang", F.col("slack").alias("all_slack"))
    rest = F.col("all_slack") - F.col("slack")
    union = union.filter(F.col("phrase").isNotNull()).join(slack, "lang")
    union = union.select("lang", "phrase", "length", "here", rest.alias("rest"))
    union = stored(union.filter(F.col("here") + F.col("rest") >= support), "phrases-candidates")
    # with nothing left to find elsewhere, the shards' own counts are exact
    if union.filter("rest > 0").isEmpty():
        return union.select("lang", "phrase", "length", F.col("here").alias("f"))
    columns = ["lang", "phrase", "length"]
    tree = union.select(*columns)
    if short is not None:
        tree = tree.filter("length > 2").unionByName(short.select(*columns))
    blocks = -(-tree.count() // BLOCK)
    block = F.pmod(F.xxhash64("lang", F.substring_index("phrase", " ", 1)), F.lit(blocks))
    shortest, counted = (1 if short is None else 3), None
    for i in range(blocks):
        some = tree.filter(block == i)
        if some.filter(F.col("length") >= shortest).isEmpty():
            continue
        part = _counted(docs, some, shortest, support)
        part = part if blocks == 1 else stored(part, f"phrases-counted-{i}")
        counted = part if counted is None else counted.unionByName(part)
    return counted


def _counted(docs: DataFrame, candidates: DataFrame, shortest: int, support: int) -> DataFrame:
    tree = docs.sparkSession.sparkContext.broadcast(Candidates.of(candidates.select("lang", "phrase").toArrow()))
    rows = docs.mapInArrow(lambda batches: tree.value.count(batches), "block int, counts binary")
    rows = rows.repartition("block").sortWithinPartitions("block")
    schema = "lang string, phrase string, length int, f long"
    return rows.mapInArrow(lambda batches: tree.value.add(batches, shortest, support), schema)


def collocations(
    docs: DataFrame, support: int = 100, longest: int = 5, top: int = 2000, absorb: int = 100, scale: int = 1000
) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the best phrases of every language.

    Words are separated by spaces and tabs, and no phrase goes over ``.,;:!?`` or a line's end; A-Z is
    lower-cased. A phrase of 2 to ``longest`` words with ``a >= support`` occurrences (overlapping ones included) has for
    each cut the score ``floor(scale * a * n / (l * r))``, ``l`` and ``r`` being the occurrences of both parts and ``n``
    all words of the language; its lowest cut counts, the first one among equals. Phrases of which a longer
    candidate holds at least ``absorb`` percent are left out. The ``top`` ones come by score, occurrences and the
    phrase's bytes.

    A NULL lang is ``und``, a NULL text is empty. Repeated rows count each. Empty tables and languages
    without such phrases have no rows. Other columns of ``docs`` are not read. Words of one language whose 64-bit
    hashes agree would be taken for one.
    """
    rows = docs.select(
        F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text")
    )
    totals = rows.select("lang", F.regexp_count("text", F.lit(WORD)).cast("long").alias("n"))
    totals = stored(totals.groupBy("lang").agg(F.sum("n").alias("n")), "phrases-totals")
    f = stored(frequent_phrases(rows, totals, support, longest), "phrases-frequent")
    return best_phrases(f, totals, top, absorb, scale)


def best_phrases(f: DataFrame, totals: DataFrame, top: int, absorb: int, scale: int) -> DataFrame:
    """Scores, absorption and ranks, from the frequencies of all frequent phrases."""
    cuts = f.filter("length > 1").withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("length") - 1)))
    cuts = cuts.select(
        "lang", "phrase", "length", "cut", F.col("f").alias("a"),
        F.call_function("substring_index", F.col("phrase"), F.lit(" "), F.col("cut")).alias("left"),
        F.call_function("substring_index", F.col("phrase"), F.lit(" "), F.col("cut") - F.col("length")).alias("right"),
    )
    for side, name in (("left", "l"), ("right", "r")):
        parts = f.select("lang", F.col("phrase").alias(side), F.col("f").alias(name))
        cuts = cuts.join(parts, ["lang", side])
    big = "decimal(38,0)"
    wide = [F.col(c).cast("decimal(18,0)") for c in ("a", "n", "l", "r")]
    product = (wide[0] * wide[1]).cast(big) * F.lit(scale).cast("decimal(9,0)")
    score = F.call_function("div", product.cast(big), (wide[2] * wide[3]).cast(big))
    cuts = stored(cuts.join(totals, "lang").withColumn("score", score), "phrases-cuts")
    scored = cuts.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "cut", "l", "r")).alias("cut"))
    # a longer phrase's first and last words; longer ones still occur no more often than these
    held = F.lit(100) * F.col("a")
    absorbed = cuts.filter((F.col("cut") == F.col("length") - 1) & (held >= absorb * F.col("l"))).select("lang", F.col("left").alias("phrase"))
    absorbed = absorbed.unionByName(
        cuts.filter((F.col("cut") == 1) & (held >= absorb * F.col("r"))).select("lang", F.col("right").alias("phrase"))
    )
    left = scored.join(absorbed, ["lang", "phrase"], "left_anti").select(
        "lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score"
    )
    return _ranked(left, top)


def _ranked(rows: DataFrame, top: int) -> DataFrame:
    """The first ``top`` per language, of which each of 64 parts has sent its first ``top``."""

    def rank(*keys: Column | str) -> Column:
        order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()]
        return F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long")

    part = F.pmod(F.xxhash64("phrase"), F.lit(64))
    some = rows.withColumn("part", part).withColumn("rank", rank("lang", "part")).filter(F.col("rank") <= top)
    best = some.withColumn("rank", rank("lang")).filter(F.col("rank") <= top)
    return best.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
