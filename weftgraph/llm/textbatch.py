"""Vectorised helpers on batches of texts, used inside Arrow tasks.

Texts of a batch lie end to end in one byte buffer; words, lines and windows are index arrays into it, so a
task handles some megabytes with a few array operations instead of a Python step for each word.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

#: Bytes that part words: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True

#: Spans beyond this many bytes are hashed one by one.
LONG = 512
_STEP = np.uint64(0x9E3779B97F4A7C15)
#: Masks that keep the first n of eight bytes.
_FIRST = np.array([(1 << (8 * n)) - 1 for n in range(9)], dtype=np.uint64)

Chunk = tuple[int, int, np.ndarray, np.ndarray]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads each input bit over all output bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def eights(data: np.ndarray) -> np.ndarray:
    """At each place the eight bytes that begin there as one number; zeros follow the end."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    return np.ndarray((len(data) + 1,), "<u8", buffer=padded, strides=(1,))


def span_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans [start, end); equal bytes give equal values wherever they lie.

    Eight bytes at a time go through a mixing step that is no linear map, so no family of texts is known to collide.
    """
    size = end - start
    out = mix(size.astype(np.uint64) + np.uint64(1))
    if not len(size):
        return out
    at8, live, at = eights(data), np.flatnonzero((size > 0) & (size <= LONG)), 0
    while len(live):
        left = size[live] - at
        word = at8[start[live] + at] & _FIRST[np.minimum(left, 8)]
        out[live] = mix((out[live] ^ word) * _STEP + np.uint64(at))
        live, at = live[left > 8], at + 8
    for i in np.flatnonzero(size > LONG).tolist():
        out[i] = xxhash.xxh3_64_intdigest(data[start[i] : end[i]])
    return out


def gram_hash(data: np.ndarray, k: int) -> np.ndarray:
    """64-bit hashes of all runs of ``k`` bytes (8 or more), by doubling: two halves that may overlap make a whole."""
    held, width = eights(data)[: max(0, len(data) - 7)] * _STEP, 8
    held ^= held >> np.uint64(32)
    while width < k:
        wide = min(2 * width, k)
        n = max(0, len(data) - wide + 1)
        both = held[:n] * np.uint64(0xBF58476D1CE4E5B9)
        both += held[wide - width : wide - width + n]
        both ^= both >> np.uint64(32)
        held, width = both, wide
    held *= _STEP
    return held


def chunks(column: pa.Array, limit: int = 1 << 20, most: int = 1 << 30) -> Iterator[Chunk]:
    """Runs of rows of a string column with about ``limit`` bytes: first row, last row + 1, bytes, offsets.

    A run has ``most`` rows at most. A null counts as an empty text; a text longer than the limit is a run of its own.
    """
    column = column.cast(pa.large_string()) if isinstance(column, pa.ChunkedArray) or not pa.types.is_large_string(column.type) else column
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64, count=column.offset + n + 1)[column.offset :]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, dtype=np.uint8)
    first = 0
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(n, max(first + 1, last), first + most)
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+``, and for each text the index of its first word."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~SPACE[data]
    start, end = inside.copy(), inside.copy()
    start[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    heads = offsets[:-1][offsets[:-1] < n]
    start[heads] = inside[heads]
    tails = offsets[1:][offsets[1:] > 0] - 1
    end[tails] = inside[tails]
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    return s, e, np.searchsorted(s, offsets)


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """A to Z in lower case, all other bytes as they are."""
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)


def grouped_sum(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of values[bounds[i]:bounds[i + 1]]; 0 where the span is empty."""
    total = np.zeros(len(values) + 1, dtype=values.dtype if values.dtype.kind in "iuf" and values.dtype.itemsize == 8 else np.int64)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def give_back() -> None:
    """Freed memory goes back to the machine: workers live on between tasks, and others start beside them."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def span_sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of floats as ``grouped_sum``, each span added up by itself: what lies beside it changes no bit."""
    out = np.zeros(len(bounds) - 1)
    full = np.flatnonzero(np.diff(bounds))
    if len(full):
        out[full] = np.add.reduceat(values[: bounds[-1]].astype(np.float64), bounds[:-1][full])
    return out


def owner(bounds: np.ndarray) -> np.ndarray:
    """For each item of the spans that ``bounds`` parts, the number of its span."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
