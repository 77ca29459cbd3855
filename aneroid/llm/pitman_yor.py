"""Language-model scores by a hierarchical Pitman-Yor process over words and pairs of words.

Every word u that is followed by others is a restaurant whose dishes are the following words w; all these
restaurants share one parent, whose customers are their tables and whose own base is uniform. Tables are
sampled by Gibbs sweeps, which draw the number of tables of a dish given everything else, and predictive probabilities are averaged over several samples.

The tokens are shuffled once, by w. So each part of the vocabulary has all contexts of its words, and their
restaurants and the parent's counts are sampled together. What a part can't see are the sums over all words of
one context, those over all words, and those of words that are spread over the parts: after every sweep they are
added up over the parts and sent back, so that each sweep has the same sums as if there were one part.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aneroid.llm.words import chunks, mix

BEGIN, END = (mix(np.array([x], np.uint64))[0] for x in (0xB0, 0xE0))
CONTEXT_BITS = 40  # contexts whose hashes agree in so many bits share a restaurant; words have 64
FLUSH_TOKENS, FLUSH_ROWS = 1 << 21, 1 << 15
PART_TOKENS = 1_500_000
EXACT = 256  # customers of a dish up to which arrangements are counted by recursion


@dataclass(frozen=True)
class Settings:
    discount: float = 0.8
    strength: float = 1.0
    parent_discount: float = 0.6
    parent_strength: float = 10.0
    burn_in: int = 2
    samples: int = 3
    seed: int = 7


def pack(*arrays: np.ndarray) -> bytes:
    parts = []
    for a in arrays:
        parts.append(f"{a.dtype.str},{a.size};".encode())
    body = b"".join(np.ascontiguousarray(a).tobytes() for a in arrays)
    return zstandard.compress(b"".join(parts) + b"\n" + body, 1)


def unpack(blob: bytes) -> list[np.ndarray]:
    data = zstandard.decompress(blob)
    head, out = data.index(b"\n"), []
    at = head + 1
    for kind in data[:head].decode().split(";")[:-1]:
        dtype, size = kind.split(",")
        out.append(np.frombuffer(data, dtype, int(size), at))
        at += out[-1].nbytes
    return out


def _planes(u: np.ndarray) -> np.ndarray:
    return u.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : CONTEXT_BITS // 8].T.ravel()


def _from_planes(planes: np.ndarray) -> np.ndarray:
    n = CONTEXT_BITS // 8
    full = np.zeros((len(planes) // n, 8), np.uint8)
    full[:, :n] = planes.reshape(n, -1).T
    return full.view("<u8").ravel()


def _tokens(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """First row, and for all tokens of some rows: word, context and row; every row ends with END."""
    for part in chunks(texts):
        rows = len(part.bounds) - 1
        w = np.insert(part.hashes, part.bounds[1:], END)
        row = np.repeat(np.arange(rows), np.diff(part.bounds) + 1)
        u = np.empty_like(w)
        u[1:] = w[:-1]
        u[part.bounds[:-1] + np.arange(rows)] = BEGIN
        yield part.first, w, u & np.uint64((1 << CONTEXT_BITS) - 1), row


def _frequent(parts: int):
    """Per chunk: the number of tokens (word NULL), and words with over 1 / (8 * parts) of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, w, _, _ in _tokens(batch.column(0)):
                words, n = np.unique(w, return_counts=True)
                often = n * 8 * parts > len(w)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([None, *words[often].view(np.int64).tolist()], pa.int64()), pa.array([len(w), *n[often].tolist()], pa.int64())],
                    names=["word", "n"],
                )

    return run


def _part_of(w: np.ndarray, u: np.ndarray, parts: int, hot: np.ndarray) -> np.ndarray:
    """Words are dealt out by their hash; the contexts of a hot word are dealt out, too."""
    key = np.where(np.isin(w, hot), mix(w ^ mix(u)), w) if len(hot) else w
    return (((key >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)).astype(np.int32)


def _deal(parts: int, hot: np.ndarray):
    """Packs tokens by part. A chunk's rows are numbered; its table of rows goes to one of the parts."""

    def flush(chunk: int, waiting: list, table: list) -> pa.RecordBatch:
        w, u, row = (np.concatenate(x) for x in zip(*waiting, strict=True))
        ids, missing, train = (np.concatenate(x) for x in zip(*table, strict=True))
        part = _part_of(w, u, parts, hot)
        order = np.lexsort((w, part))
        w, u, row, part = w[order], u[order], row[order], part[order]
        flagged = (row.astype(np.uint16) << 1) | train[row].astype(np.uint16)
        cuts = np.searchsorted(part, np.arange(parts + 1))
        home = chunk % parts
        out: dict[str, list] = {"part": [], "chunk": [], "tokens": [], "rows": []}
        counts = np.bincount(row, minlength=len(ids))
        for p in range(parts):
            a, b = cuts[p], cuts[p + 1]
            if a == b and p != home:
                continue
            first = np.flatnonzero(np.concatenate([[True], w[a + 1 : b] != w[a : b - 1]])) if b > a else np.zeros(0, int)
            out["part"].append(p)
            out["chunk"].append(chunk)
            out["tokens"].append(pack(w[a:b][first], np.diff(np.append(first, b - a)).astype(np.uint32), _planes(u[a:b]), flagged[a:b]))
            out["rows"].append(pack(ids, missing, train, counts.astype(np.int64)) if p == home else None)
        return pa.RecordBatch.from_arrays(
            [pa.array(out["part"], pa.int32()), pa.array(out["chunk"], pa.int64()), pa.array(out["tokens"], pa.binary()), pa.array(out["rows"], pa.binary())],
            names=list(out),
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 32
        waiting, table, rows, tokens = [], [], 0, 0
        for batch in batches:
            ids = batch.column(0)
            all_ids = ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            missing = ids.is_null().to_numpy(zero_copy_only=False)
            train = batch.column(2).fill_null(True).to_numpy(zero_copy_only=False)
            for first, w, u, row in _tokens(batch.column(1)):
                n = int(row[-1]) + 1
                for a in range(0, n, FLUSH_ROWS):  # empty texts can be many
                    b = min(n, a + FLUSH_ROWS)
                    if rows and (rows + b - a > FLUSH_ROWS or tokens + len(w) > FLUSH_TOKENS):
                        yield flush(chunk, waiting, table)
                        chunk, waiting, table, rows, tokens = chunk + 1, [], [], 0, 0
                    i, j = np.searchsorted(row, [a, b])
                    waiting.append((w[i:j], u[i:j], row[i:j] - a + rows))
                    at = slice(first + a, first + b)
                    table.append((all_ids[at], missing[at], train[at]))
                    rows, tokens = rows + b - a, tokens + j - i
        if rows:
            yield flush(chunk, waiting, table)

    return run


@functools.cache
def _arrangements(discount: float) -> np.ndarray:
    """The logarithm of S(c, t), the weight of all ways to seat c customers at t tables, for c up to EXACT.

    S(c + 1, t) = S(c, t - 1) + (c - discount * t) S(c, t): the next customer opens a table or joins one.
    """
    out = np.full((EXACT + 1, EXACT + 1), -np.inf)
    out[0, 0] = 0.0
    t = np.arange(1, EXACT + 1)
    with np.errstate(divide="ignore"):
        for c in range(EXACT):
            join = np.log(np.maximum(c - discount * t, 0.0)) + out[c, 1:]
            out[c + 1, 1:] = np.logaddexp(out[c, :-1], join)
    return out


@functools.cache
def _curve(discount: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Points log y, log(x f'(x) / f(x)) and log(x f'(x)) of f(x) = (1 - y ** discount) / discount, y = 1 - x."""
    log_y = -np.concatenate([np.geomspace(1e-9, 0.05, 4000), np.linspace(0.05, 60, 40_000)[1:]])
    x = -np.expm1(log_y)
    log_f = np.log(-np.expm1(discount * log_y) / discount)
    log_slope = np.log(x) + (discount - 1) * log_y
    return log_y, log_slope - log_f, log_slope


@functools.cache
def _few_tables(discount: float) -> np.ndarray:
    """What the saddle point is off by for 1 to EXACT / 4 tables, which hardly depends on the customers."""
    t = np.arange(1, EXACT // 4 + 1)
    return _arrangements(discount)[EXACT, t] - _saddle_point(EXACT, t, discount)


def _many_arrangements(c: int, t: np.ndarray, discount: float) -> np.ndarray:
    """log S(c, t) for more than EXACT customers."""
    off = _few_tables(discount)
    return _saddle_point(c, t, discount) + np.where(t == c, 0.0, off[np.minimum(t, len(off)) - 1] * np.minimum(1, len(off) / t))


def _saddle_point(c: int, t: np.ndarray, discount: float) -> np.ndarray:
    """log S(c, t): S is c! / t! times the coefficient of x ** c in f(x) ** t, taken at its saddle point."""
    log_y, ratio, _ = _curve(discount)
    ly = np.interp(np.log(c / np.minimum(t, c - 0.5)), ratio, log_y)
    x, y = -np.expm1(ly), np.exp(ly)
    f = -np.expm1(discount * ly) / discount
    first = x * y ** (discount - 1) / f
    spread = t * (first + x * x * (1 - discount) * y ** (discount - 2) / f - first**2)
    lg = np.array([math.lgamma(c + 1) - math.lgamma(k + 1) for k in t.tolist()])
    found = lg + t * np.log(f) - c * np.log(x) - 0.5 * np.log(2 * math.pi * spread)
    return np.where(t == c, 0.0, found)


def _draw(logs: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    weights = np.cumsum(np.exp(logs - logs.max(axis=1, keepdims=True)), axis=1)
    return (weights <= rng.random((len(logs), 1)) * weights[:, -1:]).sum(axis=1)


def seat(customers: np.ndarray, new: np.ndarray, discount: float, rng: np.random.Generator) -> np.ndarray:
    """Gibbs step: the tables of each dish, drawn given its customers and all the rest.

    ``new`` is strength times base probability: the weight of a new table. Given that, t tables of c customers
    have the weight S(c, t) * new ** t, which is what taking customers out and seating them again, one by one,
    settles on. ``customers`` is in descending order. Up to EXACT customers S is exact; beyond, it is a
    saddle-point value, corrected for few tables, and t is drawn among those within eight deviations of its mode.
    """
    tables = np.minimum(customers, 1).astype(np.int64)
    log_new = np.log(np.maximum(new, 1e-300))
    large, several = (int(np.searchsorted(-customers, -n, "left")) for n in (EXACT, 1))
    exact = _arrangements(discount)
    cuts = large + np.flatnonzero(np.diff(customers[large:several], prepend=-1, append=-1)) if several > large else []
    for a, b in zip(cuts, cuts[1:], strict=False):
        size = int(customers[a])
        t, step = np.arange(1, size + 1), max(1, (1 << 20) // size)
        for i in range(a, b, step):
            some = slice(i, min(b, i + step))
            tables[some] = 1 + _draw(exact[size, 1 : size + 1] + log_new[some, None] * t, rng)
    if large:
        log_y, _, log_slope = _curve(discount)
        at = np.interp(np.log(customers[:large]) - log_new[:large], log_slope, log_y)
        mode = np.exp(log_new[:large]) * -np.expm1(discount * at) / discount
        for i in range(large):
            c = int(customers[i])
            m = min(max(mode[i], 1.0), c)
            reach = 8 * math.sqrt(m) + 8
            t = np.arange(max(1, int(m - reach)), min(c, int(m + reach)) + 1)
            tables[i] = t[_draw((_many_arrangements(c, t, discount) + t * log_new[i])[None], rng)[0]]
    return tables


class Part:
    """The words of one part with their contexts, from the blobs of all chunks."""

    def __init__(self, blobs: list[tuple[int, bytes]], parts: int, hot: np.ndarray, settings: Settings, seed: int):
        self.settings, self.parts = settings, parts
        columns: list[list[np.ndarray]] = [[], [], [], []]
        self.chunks: list[int] = []
        for n, (chunk, blob) in enumerate(sorted(blobs)):
            words, counts, planes, flagged = unpack(blob)
            for into, x in zip(columns, (np.repeat(words, counts), _from_planes(planes), flagged, np.full(len(flagged), n, np.int32)), strict=True):
                into.append(x)
            self.chunks.append(chunk)
        w, u, flagged, self.token_chunk = (np.concatenate(x) for x in columns)
        self.token_row, train = (flagged >> 1).astype(np.int64), (flagged & 1).astype(bool)
        self.words, word = np.unique(w, return_inverse=True)
        self.contexts, context = np.unique(u, return_inverse=True)
        del w, u
        key = word * len(self.contexts) + context
        pairs, self.token_pair = np.unique(key, return_inverse=True)
        self.pair_word, self.pair_context = pairs // max(1, len(self.contexts)), pairs % max(1, len(self.contexts))
        self.pair_count = np.bincount(self.token_pair, weights=train, minlength=len(pairs)).astype(np.int64)
        self.word_count = np.bincount(self.pair_word, weights=self.pair_count, minlength=len(self.words)).astype(np.int64)
        self.hot_at = np.searchsorted(self.words, hot)
        self.hot_here = np.array([a < len(self.words) and self.words[a] == h for a, h in zip(self.hot_at, hot, strict=True)], bool)
        self.is_hot = np.zeros(len(self.words), bool)
        self.is_hot[self.hot_at[self.hot_here]] = True
        self.seed, self.hot, self.seating = seed, hot, None
        seen = np.flatnonzero(self.pair_count)
        order = seen[np.argsort(-self.pair_count[seen], kind="stable")]
        self.many = order[self.pair_count[order] > 1]  # a dish with one customer has one table

    def repeated(self) -> list[np.ndarray]:
        """What the sweeps need, for Seating."""
        n, trained = len(self.contexts), self.pair_count > 0
        hot_count = np.zeros(len(self.hot), np.int64)
        hot_count[self.hot_here] = self.word_count[self.hot_at[self.hot_here]]
        return [
            _planes(self.contexts),
            np.bincount(self.pair_context, weights=self.pair_count, minlength=n).astype(np.uint32),
            np.bincount(self.pair_context, weights=trained, minlength=n).astype(np.uint32),
            self.pair_count[self.many].astype(np.uint32), self.pair_word[self.many].astype(np.uint32), self.pair_context[self.many].astype(np.uint32),
            np.bincount(self.pair_word, weights=trained, minlength=len(self.words)).astype(np.uint32),
            np.flatnonzero(self.hot_here).astype(np.uint32), self.hot_at[self.hot_here].astype(np.uint32), hot_count,
            np.array([float(self.word_count.sum()), float(((self.word_count > 0) & ~self.is_hot).sum())]),
        ]

    def _alone(self) -> Seating:
        """All sweeps, where this part is the only one."""
        if self.seating is None:
            self.seating = Seating(self.repeated(), self.settings, 1, self.seed)
            for sweep in range(self.settings.burn_in + self.settings.samples):
                self.seating.sweep(sweep)
                told = add_up(0, sweep, [x for _, x in self.seating.ask(sweep)], self.settings)
                self.seating.hear(sweep, [(0, x) for x in told])
        return self.seating

    def sums(self) -> tuple[np.ndarray, list[np.ndarray]]:
        """Per context: training tokens, and tables in each sample."""
        return self.contexts, self._alone().totals

    def scalars(self) -> np.ndarray:
        """Training tokens, words in them, and the hot words' counts."""
        return self._alone().scalars

    def score(self, totals: list[np.ndarray], scalars: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        """Per token: base and model log10 probability and whether the word is known; and the training tokens."""
        s, k = self.settings, self.settings.samples
        n_tokens, vocabulary = scalars[:2]
        count = self.word_count.astype(float)
        count[self.hot_at[self.hot_here]] = scalars[2:][self.hot_here]
        base = np.log10((count + 1) / (n_tokens + vocabulary + 1))
        chance = np.zeros(len(self.pair_count))
        context_count = totals[0].astype(float)[self.pair_context]
        for j, (seated, parent) in enumerate(self.seating.samples):
            tables = (self.pair_count > 0).astype(np.int64)
            tables[self.many] = seated
            back = s.strength + s.discount * totals[1 + j].astype(float)[self.pair_context]
            own = self.pair_count - s.discount * tables
            chance += (own + back * parent[self.pair_word]) / (s.strength + context_count)
        word = self.pair_word[self.token_pair]
        return base[word], np.log10(chance / k)[self.token_pair], (count > 0)[word], n_tokens


class Seating:
    """The tables of one part. Gibbs sweeps: context restaurants given the parent, then the parent given their tables.

    A round is ``sweep``, ``ask``, ``add_up`` at the owners of contexts and hot words, and ``hear``. Before the
    first round every pair and every word has one table. Only pairs with several customers are seated anew.
    """

    def __init__(self, repeated: list[np.ndarray], settings: Settings, parts: int, seed: int, state: bytes | None = None):
        planes, *rest = repeated
        self.settings, self.parts, self.seed = settings, parts, seed
        self.contexts = _from_planes(planes)
        self.context_count, self.context_pairs, self.count, self.word, self.context, self.pairs, self.hot_index, self.hot_word, self.hot_count, self.own = rest
        self.count, self.pairs = self.count.astype(np.int64), self.pairs.astype(np.int64)
        self.wanted = np.zeros(len(self.contexts), bool)
        self.wanted[self.context] = True
        self.samples: list[tuple[np.ndarray, np.ndarray]] = []  # tables, and the parent's probability of each word
        self.base, self.tables, self.parent = 0.0, np.ones(len(self.count), np.int64), np.minimum(self.pairs, 1)
        if state is not None:
            tables, self.parent, base, *samples = unpack(state)
            self.tables, self.base = tables.astype(np.int64), float(base[0])
            self.samples = list(zip(samples[::2], samples[1::2], strict=True))

    def state(self) -> bytes:
        return pack(self.tables.astype(np.uint32), self.parent, np.array([self.base]), *(x for t, c in self.samples for x in (t.astype(np.uint32), c)))

    def customers(self) -> np.ndarray:
        extra = np.bincount(self.word, weights=self.tables - 1, minlength=len(self.pairs))
        return self.pairs + extra.astype(np.int64)

    def sweep(self, sweep: int) -> None:
        """Seats the pairs, then the words, with the sums heard last."""
        if not sweep:
            return
        s, rng = self.settings, np.random.default_rng([self.settings.seed, self.seed, sweep])
        everywhere = np.zeros(len(self.contexts))
        everywhere[self.wanted] = self.totals[0]
        new = (s.strength + s.discount * everywhere[self.context]) * self.chance[self.word]
        self.tables = seat(self.count, new, s.discount, rng)
        customers = self.customers()
        customers[self.hot_word] = 0  # seated by their owners
        by_size = np.argsort(-customers, kind="stable")
        self.parent = np.zeros(len(customers), np.int64)
        self.parent[by_size] = seat(customers[by_size], np.full(len(by_size), self.base), s.parent_discount, rng)

    def ask(self, sweep: int) -> list[tuple[int, list[np.ndarray]]]:
        """For each owner this part's sums. Totals return for the first contexts in a message, which are sorted.

        In the last sweep they return for all contexts, with the training tokens and the tables of each sample.
        """
        n, last = len(self.contexts), sweep == self.settings.burn_in + self.settings.samples - 1
        tables = [*(t for t, _ in self.samples), self.tables] if last else [self.tables]
        sums = [self.context_pairs + np.bincount(self.context, weights=t.astype(np.int64) - 1, minlength=n).astype(np.int64) for t in tables]
        sums = [self.context_count, *sums] if last else sums
        first = np.arange(n) if last else np.flatnonzero(self.wanted)
        others = np.flatnonzero(~self.wanted & (self.context_pairs > 0)) if not last else first[:0]
        customers = self.customers()
        hot = np.zeros(len(self.hot_count), np.int64)
        hot[self.hot_index] = customers[self.hot_word]
        plain = np.ones(len(customers), bool)
        plain[self.hot_word] = False
        scalars = np.array([*self.own, customers[plain].sum(), self.parent[plain].sum()], float)
        cuts = [np.searchsorted(_owner(self.contexts[x], self.parts), np.arange(self.parts + 1)) for x in (first, others)]
        out = []
        for o in range(self.parts):
            at = [x[c[o] : c[o + 1]] for x, c in zip((first, others), cuts, strict=True)]
            if o == 0 or o < len(hot) or len(at[0]) or len(at[1]):
                out.append((o, [
                    *(_planes(self.contexts[x]) for x in at), self.hot_count[o :: self.parts], hot[o :: self.parts],
                    scalars if o == 0 else scalars[:0], np.array([self.base]), *(x[np.concatenate(at)].astype(np.uint32) for x in sums),
                ]))
        return out

    def hear(self, sweep: int, answers: list[tuple[int, list[np.ndarray]]]) -> None:
        """Takes the totals, given by owner in their order."""
        s = self.settings
        hot = [np.zeros(len(self.hot_count), np.int64) for _ in range(3)]
        for o, answer in answers:
            for into, x in zip(hot, answer[:3], strict=True):
                into[o :: self.parts] = x
        tokens, plain, all_customers, all_tables = next(a[3] for o, a in answers if o == 0)
        self.totals = [np.concatenate(x) for x in zip(*(a[4:] for _, a in answers), strict=True)]
        hot_count, hot_customers, hot_tables = hot
        vocabulary = plain + (hot_count > 0).sum()
        self.scalars = np.array([tokens, vocabulary, *hot_count], float)
        customers, parent = self.customers(), self.parent.copy()
        customers[self.hot_word], parent[self.hot_word] = hot_customers[self.hot_index], hot_tables[self.hot_index]
        self.base = (s.parent_strength + s.parent_discount * (all_tables + hot_tables.sum())) / (vocabulary + 1)
        self.chance = (customers - s.parent_discount * parent + self.base) / (s.parent_strength + all_customers + hot_customers.sum())
        if sweep >= s.burn_in:
            self.samples.append((self.tables, self.chance.astype(np.float32)))


def _owner(contexts: np.ndarray, parts: int) -> np.ndarray:
    return ((contexts * np.uint64(parts)) >> np.uint64(CONTEXT_BITS)).astype(np.int64)


def add_up(owner: int, sweep: int, asked: list[list[np.ndarray]], settings: Settings) -> list[list[np.ndarray]]:
    """The answers of one owner: exact totals over the parts that asked; and it seats its hot words in the parent."""
    first = [_from_planes(a[0]) for a in asked]
    sent = [np.concatenate([x, _from_planes(a[1])]) for x, a in zip(first, asked, strict=True)]
    known, at = np.unique(np.concatenate(sent), return_inverse=True)
    totals = [np.bincount(at, weights=np.concatenate(x), minlength=len(known)).astype(np.int64) for x in zip(*(a[6:] for a in asked), strict=True)]
    count, customers = (np.sum([a[j] for a in asked], axis=0) for j in (2, 3))
    tables = np.minimum(customers, 1)
    if sweep and len(customers):
        by_size = np.argsort(-customers, kind="stable")
        rng = np.random.default_rng([settings.seed, owner, sweep, 1])
        tables[by_size] = seat(customers[by_size], np.full(len(by_size), asked[0][5][0]), settings.parent_discount, rng)
    scalars = np.sum([a[4] for a in asked], axis=0)
    begin = np.cumsum([0, *map(len, sent)])
    return [[count, customers, tables, scalars, *(t[at[a : a + len(x)]] for t in totals)] for a, x in zip(begin, first, strict=False)]


def _blobs(frame: pd.DataFrame) -> list[tuple[int, bytes]]:
    return list(zip(frame["chunk"].tolist(), frame["tokens"].tolist(), strict=True))


def score_corpus(
    docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", settings: Settings | None = None
) -> DataFrame:
    """Scores every whole text with a model learned from the rows where ``train`` holds.

    Returns ``doc_id, n_tokens, n_known, train_tokens, base_score, score``: words (runs of non-space, A-Z
    lower-cased) and one end are the tokens; ``base_score`` is the sum of log10((c + 1) / (N + V + 1)) with the
    training counts of the words, ``score`` that of the model's averaged predictive probabilities. Perplexity
    is 10 ** (-score / n_tokens).

    NULL and empty texts have just the end; rows with a NULL id or a NULL ``train`` are trained on; repeated
    rows are separate texts; without training rows every token has a uniform share of one unknown word. An
    empty table gives an empty frame.

    Tokens are shuffled once, packed to about 9 bytes, by their word into parts of a bounded number of tokens;
    a first pass finds the words that would fill a part (at most 8 for each part), and their contexts are
    spread. After every sweep the sums per context and hot word go from the parts to their owners and back. Seeds
    depend on the part and the sweep alone, so a lost task samples the same tables again.
    """
    settings = settings or Settings()
    spark = docs.sparkSession
    shuffles = int(spark.conf.get("spark.sql.shuffle.partitions"))
    text = F.col(text_col).alias("text")
    found = docs.select(text).mapInArrow(_frequent(shuffles), "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    often = found.filter(F.col("word").isNotNull()).orderBy(F.desc("n"), "word").limit(8 * shuffles)
    rows = found.filter(F.col("word").isNull()).unionByName(often).collect()  # at most 1 + 8 * parts rows
    n = max([0, *(r["n"] for r in rows if r["word"] is None)])
    parts = max(shuffles, math.ceil(n / PART_TOKENS))
    hot = np.array(sorted(r["word"] for r in rows if r["word"] is not None and r["n"] * 4 * parts > n), np.int64).view(np.uint64)
    hot = np.sort(hot)

    dealt = docs.select(F.col(id_col).cast("long").alias("doc_id"), text, train.alias("train")).mapInArrow(
        _deal(parts, hot), "part int, chunk long, tokens binary, rows binary"
    )

    def asks(seating: Seating, sweep: int, repeated: bytes | None) -> pd.DataFrame:
        p, out = seating.seed, []
        messages = {o: pack(*x) for o, x in seating.ask(sweep)}
        for o in sorted({p, *messages}):
            out.append((o, p, messages.get(o), *((seating.state(), repeated) if o == p else (None, None))))
        return pd.DataFrame(out, columns=["owner", "part", "sums", "state", "repeated"])

    def hear(seating_of, answers: pd.DataFrame, sweep: int) -> Seating:
        answers = answers.sort_values("owner")
        seating = seating_of(next(x for x in answers["state"] if x is not None))
        seating.hear(sweep, [(int(o), unpack(x)) for o, x in zip(answers["owner"], answers["sums"], strict=True) if x is not None])
        return seating

    def begin(frame: pd.DataFrame) -> pd.DataFrame:
        p = int(frame["part"].iloc[0])
        repeated = Part(_blobs(frame), parts, hot, settings, p).repeated()
        return asks(Seating(repeated, settings, parts, p), 0, pack(*repeated))

    def go_on(sweep: int):
        def run(key: tuple, first: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
            p = int(key[0])
            if answers.empty:  # an owner of contexts that has no words
                return pd.DataFrame([], columns=["owner", "part", "sums", "state", "repeated"])
            repeated = unpack(next(x for x in first["repeated"] if x is not None))
            seating = hear(lambda state: Seating(repeated, settings, parts, p, state), answers, sweep - 1)
            seating.sweep(sweep)
            return asks(seating, sweep, None)

        return run

    def answer(sweep: int):
        def run(frame: pd.DataFrame) -> pd.DataFrame:
            frame = frame.sort_values("part")
            owner = int(frame["owner"].iloc[0])
            asked = frame[frame["sums"].notna()]
            found = add_up(owner, sweep, [unpack(x) for x in asked["sums"]], settings) if len(asked) else []
            told = {p: pack(*x) for p, x in zip(asked["part"], found, strict=True)}
            out = [(p, owner, told.get(p), state) for p, state in zip(frame["part"], frame["state"], strict=True)]
            return pd.DataFrame(out, columns=["part", "owner", "sums", "state"])

        return run

    def evaluate(tokens: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        p = int(tokens["part"].iloc[0])
        part = Part(_blobs(tokens), parts, hot, settings, p)
        part.seating = hear(lambda state: Seating(part.repeated(), settings, parts, p, state), answers, sweeps - 1)
        base, model, known, n_tokens = part.score(part.seating.totals, part.seating.scalars)
        tables = dict(zip(tokens["chunk"], tokens["rows"], strict=True))
        out = []
        cuts = np.searchsorted(part.token_chunk, np.arange(len(part.chunks) + 1))
        for chunk, a, b in zip(part.chunks, cuts, cuts[1:], strict=False):
            rows, at = np.unique(part.token_row[a:b], return_inverse=True)
            sums = [np.bincount(at, weights=x[a:b], minlength=len(rows)) for x in (base, model, known)]
            out.append((chunk, p, pack(rows.astype(np.uint16), sums[0], sums[1].astype(np.float32), sums[2].astype(np.uint32), np.array([n_tokens])), tables[chunk]))
        return pd.DataFrame(out, columns=["chunk", "part", "sums", "rows"])

    def finish(frame: pd.DataFrame) -> pd.DataFrame:
        ids, missing, _, counts = unpack(next(x for x in frame["rows"] if x is not None))
        totals = np.zeros((3, len(ids)))
        n_tokens = 0.0
        for blob in frame.sort_values("part")["sums"]:
            rows, *sums, told = unpack(blob)
            n_tokens = told[0]
            for into, x in zip(totals, sums, strict=True):
                into[rows] += x
        return pd.DataFrame({
            "doc_id": pd.arrays.IntegerArray(ids.copy(), missing.copy()),
            "n_tokens": counts, "n_known": totals[2].astype(np.int64), "train_tokens": np.int64(n_tokens),
            "base_score": totals[0], "score": totals[1],
        })

    sweeps = settings.burn_in + settings.samples
    asking = "owner int, part int, sums binary, state binary, repeated binary"
    first = asked = dealt.groupBy("part").applyInPandas(begin, asking)
    for sweep in range(sweeps):
        if sweep:
            asked = first.groupBy("owner").cogroup(answers.groupBy("part")).applyInPandas(go_on(sweep), asking)
        answers = asked.groupBy("owner").applyInPandas(answer(sweep), "part int, owner int, sums binary, state binary")
    scored = dealt.groupBy("part").cogroup(answers.groupBy("part")).applyInPandas(
        evaluate, "chunk long, part int, sums binary, rows binary"
    )
    return scored.groupBy("chunk").applyInPandas(
        finish, "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    ).withColumnRenamed("doc_id", id_col)
