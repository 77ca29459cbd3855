"""Long texts in bounded slices that cut no word, and words as Arrow values."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from aneroid.llm.words import CHUNK_BYTES


def cut(data: bytes, ends: np.ndarray, size: int = CHUNK_BYTES) -> Iterator[bytes]:
    """``data`` in slices that end after one of the bytes marked in ``ends``, the first one past ``size`` bytes.

    A stretch without such a byte stays whole, however long it is.
    """
    if len(data) <= size:
        yield data
        return
    stops = np.flatnonzero(ends[np.frombuffer(data, np.uint8)]) + 1
    at = 0
    while at < len(data):
        i = np.searchsorted(stops, at + size)
        end = int(stops[i]) if i < len(stops) else len(data)
        yield data[at:end]
        at = end


def sliced(texts: pa.Array, ends: np.ndarray, size: int = CHUNK_BYTES) -> tuple[pa.Array, np.ndarray]:
    """The texts with long ones cut, as binary, and for every slice the number of its text; NULL is empty."""
    texts = texts.cast(pa.large_binary())
    lengths = np.diff(np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]) if len(texts) else np.zeros(0, int)
    if not (lengths > size).any():
        return texts, np.arange(len(texts))
    parts, rows = [], []
    for row, text in enumerate(texts):
        for piece in cut(text.as_py() or b"", ends, size):
            parts.append(piece)
            rows.append(row)
    return pa.array(parts, pa.large_binary()), np.array(rows, np.int64)


def gather(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The bytes ``data[start:end]`` of every pair."""
    lengths = ends - starts
    offsets = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(lengths, out=offsets[1:])
    at = np.repeat(starts - offsets[:-1], lengths) + np.arange(offsets[-1])
    return pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data[at]))]
    )


def added(keys: tuple[np.ndarray, ...], values: tuple[np.ndarray, ...]) -> tuple[tuple[np.ndarray, ...], tuple[np.ndarray, ...]]:
    """The different keys in order, and the sums of their values."""
    order = np.lexsort(keys[::-1])
    keys = tuple(k[order] for k in keys)
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    heads = np.flatnonzero(new)
    sums = tuple(np.add.reduceat(v[order], heads) if len(heads) else v for v in values)
    return tuple(k[heads] for k in keys), sums
