"""Words of many texts at once, as numpy arrays over the bytes of an Arrow batch."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

# Bytes that end a word. All are ASCII, so words of UTF-8 bytes are words of code points.
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
NOT_ALPHANUMERIC = np.zeros(256, bool)
NOT_ALPHANUMERIC[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True

_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2 ** 64
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x.astype(np.uint64, copy=True)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    x ^= x >> np.uint64(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=np.uint64)) | np.uint64(1)
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, CHUNK_BYTES + 1)
        made = []
        for b in (_BASE, _INVERSE):
            p = np.full(size, b & _MASK, np.uint64)
            p[0] = 1
            made.append(np.multiply.accumulate(p))
        _POWERS[:] = made
    return _POWERS[0][:n], _POWERS[1][:n]


@dataclass
class Words:
    """Words of the rows ``first ... first + len(bounds) - 2`` of a batch.

    Row r has the words ``bounds[r] ... bounds[r + 1]``, each with a 64-bit hash, and lies at ``starts``
    to ``ends`` of ``data`` (lower-cased bytes); row r begins there at ``row_starts[r]``.
    """

    first: int
    bounds: np.ndarray
    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    data: np.ndarray
    row_starts: np.ndarray

    def rows(self) -> np.ndarray:
        """For each word the number of its row, from 0."""
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))


def chunks(texts: pa.Array, breaks: np.ndarray = SPACES) -> Iterator[Words]:
    """Whole texts, in chunks of about ``CHUNK_BYTES``; a longer text is a chunk of its own.

    A-Z is lower-cased before ``breaks`` are looked up. NULL and empty texts have no words.
    """
    texts = texts.cast(pa.large_binary()) if len(texts) else pa.array([], pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else [0]
    data = texts.buffers()[2] if len(texts) else None
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    valid = np.asarray(texts.is_valid()) if texts.null_count else None
    row = 0
    while row < len(texts):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + CHUNK_BYTES, "right")) - 1)
        at = np.asarray(offsets[row : end + 1]) - offsets[row]
        lengths = np.diff(at) if valid is None else np.where(valid[row:end], np.diff(at), 0)
        yield _chunk(row, _LOWER[data[offsets[row] : offsets[end]]], at, lengths, breaks)
        row = end


def _chunk(first: int, data: np.ndarray, at: np.ndarray, lengths: np.ndarray, breaks: np.ndarray) -> Words:
    inside = ~breaks[data]
    for r in np.flatnonzero(lengths != np.diff(at)):
        inside[at[r] : at[r + 1]] = False  # what lies under a NULL
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    heads = at[:-1][at[:-1] < len(data)]
    begins[heads] = inside[heads]
    stops = inside.copy()
    stops[:-1] &= ~inside[1:]
    lasts = at[1:][at[1:] > 0] - 1
    stops[lasts] = inside[lasts]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    powers, inverses = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * powers[:-1], out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * inverses[starts])
    return Words(first, np.searchsorted(starts, at), hashes, starts, ends, data, at[:-1])


def hash_of(word: bytes) -> int:
    """The hash that ``chunks`` gives the word."""
    total = 0
    for i, b in enumerate(word):
        total += int(_BYTE[b]) * pow(_BASE, i, 1 << 64)
    return int(mix(np.array([total & _MASK], np.uint64))[0])
