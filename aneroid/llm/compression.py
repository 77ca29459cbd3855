"""Toxicity by compression distance: which of two zstandard dictionaries makes a window shorter?"""

from __future__ import annotations

import math
from array import array
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_EDGES = bytes(set(range(33, 127)) - set(b"0123456789abcdefghijklmnopqrstuvwxyz"))
# Both dictionaries end with the anchor, so every window begins with a match and is stored as a compressed
# block; the compressor looks for no match in a block's last bytes, so those are no part of the text.
_ANCHOR = bytes(range(224, 256))
_TAIL = bytes(range(200, 216))
_LONGEST = 200  # of a window's bytes; a longer word is cut into several windows


def windows(text: str) -> Iterator[bytes]:
    """The words of the whole text, A-Z lower-cased, without punctuation at their edges."""
    for word in text.encode("utf-8", "surrogatepass").translate(_LOWER).split():
        word = word.strip(_EDGES)
        for at in range(0, len(word), _LONGEST):
            yield word[at : at + _LONGEST]


@dataclass(frozen=True)
class CompressionModel:
    """Two dictionaries and the calibrated weights of a document's three largest differences."""

    toxic: bytes
    ordinary: bytes
    weights: tuple[float, ...]  # the last one is the constant
    level: int = 19

    def scorer(self) -> Scorer:
        return Scorer(self)


class Scorer:
    """Compresses windows; one for each task. Remembers a bounded number of words."""

    REMEMBERED = 300_000

    def __init__(self, model: CompressionModel):
        self._weights = np.array(model.weights)
        self._toxic, self._ordinary = (_compressor(d, model.level) for d in (model.toxic, model.ordinary))
        self._known: dict[bytes, int] = {}

    def difference(self, window: bytes) -> int:
        """Bytes by which the toxic dictionary makes the window shorter than the ordinary one does, at least 0."""
        found = self._known.get(window)
        if found is None:
            framed = b"%b %b %b" % (_ANCHOR, window, _TAIL)
            plain = len(window) + self._overhead
            toxic = len(self._toxic.compress(framed))
            # without a match for the toxic dictionary there is nothing to compare
            found = 0 if toxic >= plain - 1 else max(0, len(self._ordinary.compress(framed)) - toxic)
            if len(self._known) >= self.REMEMBERED:
                self._known.clear()
            self._known[window] = found
        return found

    @property
    def _overhead(self) -> int:
        if not hasattr(self, "_empty"):
            self._empty = len(self._toxic.compress(b"%b  %b" % (_ANCHOR, _TAIL)))
        return self._empty

    def features(self, text: str | None) -> np.ndarray:
        """The three largest differences over the windows of the whole text, and 1."""
        top = sorted((self.difference(w) for w in windows(text or "")), reverse=True)[:3]
        return np.array([*top, *[0] * (3 - len(top)), 1], dtype=float)

    def score(self, text: str | None) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.features(text) @ self._weights, -30, 30))))


def _compressor(content: bytes, level: int) -> zstandard.ZstdCompressor:
    parameters = zstandard.ZstdCompressionParameters.from_level(
        level, min_match=3, strategy=zstandard.STRATEGY_BTULTRA2, write_content_size=0, write_checksum=0,
        write_dict_id=0, format=zstandard.FORMAT_ZSTD1_MAGICLESS,
    )
    dictionary = zstandard.ZstdCompressionDict(content + _ANCHOR, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    dictionary.precompute_compress(compression_params=parameters)
    return zstandard.ZstdCompressor(dict_data=dictionary, compression_params=parameters)


def contexts(texts: Sequence[str]) -> Counter:
    """In how many different surroundings (word before, word after) each word appears.

    A passage copied into many documents counts once, so its words don't look typical.
    """
    number: dict[bytes, int] = {b"": 0}
    words = array("i", [0])
    for text in texts:
        words.extend(number.setdefault(w, len(number)) for w in windows(text))
        words.append(0)
    ids = np.frombuffer(words, np.int32)
    at = np.flatnonzero(ids[1:-1]).astype(np.int32) + 1
    size = len(number)
    # in parts by word, as sorting takes several times the memory
    counts = np.zeros(size, np.int64)
    parts = 1 + (len(at) >> 19)
    for part in range(parts):
        some = at[ids[at] % parts == part]
        word = ids[some].astype(np.int64)
        # pairs are numbered first, as the product of three sizes can be over 64 bits
        pairs, pair = np.unique(word * size + ids[some - 1], return_inverse=True)
        surroundings = np.unique(pair * size + ids[some + 1])
        counts += np.bincount(pairs[surroundings // size] // size, minlength=size)
    return Counter({w: int(n) for w, n in zip(number, counts, strict=True) if n and w})


def stems(words: Counter, shortest: int = 4, among: set[bytes] | None = None) -> Counter:
    """The counts of the beginnings of words, of ``shortest`` bytes or more."""
    counts: Counter = Counter()
    for word, n in words.items():
        for end in range(shortest, len(word)):
            stem = word[:end]
            if among is None or stem in among:
                counts[stem] += n
    return counts


def fit(
    toxic: Sequence[str], ordinary: Sequence[str], kilobytes: tuple[int, int] = (16, 128), contrast: float = 8.0
) -> CompressionModel:
    """Trains both dictionaries on labelled texts, then the weights that turn differences into a probability.

    The toxic dictionary gets the words that toxic texts use in at least ``max(3, half a percent of the
    texts)`` surroundings and, at the lower end of that count's error, ``contrast`` times as often as ordinary texts, and the words whose beginning is
    used so, the most frequent last; the ordinary dictionary gets the words that recur in ordinary texts. Their sizes are
    bounded by ``kilobytes``. The weights are a logistic regression over all the given texts. With texts of
    one kind only, or none, nothing can be told apart: every score is the (smoothed) share of toxic texts, but
    below a half.
    """
    if not toxic or not ordinary:
        share = min(0.49, (len(toxic) + 0.5) / (len(toxic) + len(ordinary) + 1))
        return CompressionModel(b" ", b" ", (0.0, 0.0, 0.0, math.log(share / (1 - share))))
    bad, usual = contexts(toxic), contexts(ordinary)
    n_bad, n_usual = max(1, bad.total()), max(1, usual.total())
    least = max(3, len(toxic) // 200)

    def marked(toxic_counts: Counter, usual_counts: Counter) -> dict[bytes, int]:
        return {
            w: n for w, n in toxic_counts.items()
            if n >= least and (n - 1.64 * math.sqrt(n)) / n_bad >= contrast * (usual_counts[w] + 1) / n_usual
        }

    begin = stems(bad)
    begin = Counter({w: n for w, n in begin.items() if n >= least})
    beginnings = marked(begin, stems(usual, among=set(begin)))
    marks = marked(bad, usual)
    for w, n in bad.items():
        if usual[w] == 0 and any(w[:end] in beginnings for end in range(4, len(w))):
            marks[w] = n
    common = {w: n for w, n in usual.items() if n >= 2 and w not in marks}

    def dictionary(words: dict[bytes, int], limit: int) -> bytes:
        content = b"".join(b" %b " % w for w in sorted(words, key=lambda w: (words[w], w)))
        return content[-limit:] or b" "

    first = CompressionModel(
        dictionary(marks, kilobytes[0] << 10), dictionary(common, kilobytes[1] << 10), (0.0,) * 4
    )
    scorer = first.scorer()
    x = np.array([scorer.features(t) for t in [*toxic, *ordinary]])
    y = np.repeat([1.0, 0.0], [len(toxic), len(ordinary)])
    return CompressionModel(first.toxic, first.ordinary, tuple(float(v) for v in _logistic(x, y)))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1, steps: int = 50) -> np.ndarray:
    w = np.zeros(x.shape[1])
    penalty = np.diag([ridge] * (x.shape[1] - 1) + [1e-6])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (y - p) - penalty @ w
        move = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, slope)
        w = w + move
        if np.abs(move).max() < 1e-8:
            break
    return w


def score(docs: DataFrame, model: CompressionModel, text_col: str = "text") -> Column:
    """A column with the probability that the whole text is toxic; NULL and empty texts have no windows.

    The model (bounded by the dictionaries' sizes) goes to the tasks with the function; nothing is shuffled.
    """

    @F.pandas_udf("double")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = model.scorer()
        for texts in batches:
            yield pd.Series([scorer.score(t) for t in texts], dtype=float)

    return of(docs[text_col])
