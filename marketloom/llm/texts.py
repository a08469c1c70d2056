"""Vectorised word hashing over Arrow string columns, for functions that run inside tasks.

Words are maximal runs of bytes other than space, tab, line feed, vertical tab, form feed and
carriage return. A batch is cut into slices of bounded bytes (one row at least), so memory
follows the longest text and not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 4 << 20

_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _power_table(base: int, n: int) -> np.ndarray:
    """base**0 ... base**n modulo 2**64; grown by doubling and kept for the worker's life."""
    table = _powers.get(base)
    if table is None or len(table) <= n:
        size = max(n + 1, SLICE_BYTES + 1)
        table = np.ones(size, np.uint64)
        done, factor = 1, base
        while done < size:
            step = min(done, size - done)
            table[done : done + step] = table[:step] * np.uint64(factor)
            done += step
            factor = factor * factor % (1 << 64)
        if size <= 4 * SLICE_BYTES:
            _powers[base] = table
    return table


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def row_slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of ``column`` with at most ``limit`` bytes each, or one row."""
    n = len(column)
    if not n:
        return
    offsets = raw_text(column)[1]
    start = 0
    while start < n:
        end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1)
        yield start, min(end, n)
        start = min(end, n)


def raw_text(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows and the row offsets; a null row is empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or at[-1] == at[0]:
        return np.zeros(0, np.uint8), at - at[0]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and for each row the index of its first word (one more at the end)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    word = ~_SEPARATOR[data]
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    begins, ends = word.copy(), word
    begins[1:] &= ~word[:-1] | first[1:n]
    ends = word.copy()
    ends[:-1] &= ~word[1:] | first[1:n]
    starts, stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return starts, stops, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, stops: np.ndarray, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of every word's bytes, by prefix sums of a polynomial."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    if lower:
        data = _LOWER[data]
    n = len(data)
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power_table(_BASE, n)[:n], out=prefix[1:])
    h = (prefix[stops] - prefix[starts]) * _power_table(_BASE_INVERSE, n)[starts]
    return mix(h + (stops - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def run_hashes(hashes: np.ndarray, length: int, seed: int = 0) -> np.ndarray:
    """The hash of ``length`` consecutive word hashes at each position (fewer positions than words)."""
    n = len(hashes)
    if n < length:
        return np.zeros(0, np.uint64)
    salted = mix(hashes + np.uint64(seed)) if seed else hashes
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum(salted * _power_table(_BASE, n)[:n], out=prefix[1:])
    return mix((prefix[length:] - prefix[: n - length + 1]) * _power_table(_BASE_INVERSE, n)[: n - length + 1])


def local_components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each of ``n`` indices over the pairs (a, b)."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if np.array_equal(before, label):
            break
        open_ = label[a] != label[b]
        if not open_.any():
            break
    while True:
        jumped = label[label]
        if np.array_equal(jumped, label):
            return label
        label = jumped
