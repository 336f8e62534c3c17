"""Helpers for work on Arrow batches: texts as one byte buffer, words as offset arrays, polynomial hashes.

All hashes are sums of ``byte * BASE**i`` modulo 2**64, so the hash of any range follows from two prefix sums.
They only propose equality; callers compare the bytes themselves before they act on it.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

BASE = np.uint64(0x9E3779B97F4A7C15)
#: BASE times this is 1 modulo 2**64.
BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: Texts are handled in slices of about so many bytes, which bounds the memory of a task. A longer text is a slice of its own.
SLICE_BYTES = 1 << 20


def byte_table(members: list[tuple[int, int]], inverted: bool = False) -> np.ndarray:
    """Which of the 256 byte values lie in one of the closed ranges."""
    table = np.zeros(256, bool)
    for low, high in members:
        table[low : high + 1] = True
    return ~table if inverted else table


LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
#: Everything but blanks and the control characters from tab to carriage return.
NOT_SPACE = byte_table([(0x20, 0x20), (0x09, 0x0D)], inverted=True)
#: Digits, a-z and all bytes of characters beyond ASCII.
ALNUM = byte_table([(0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF)])


@lru_cache(maxsize=2)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(size, BASE), np.full(size, BASE_INVERSE)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i below at least ``size``."""
    return _powers(1 << max(20, (max(size, 1) - 1).bit_length()))


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values over all bits (a bijection)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """Prefix sums from which ``range_hash`` reads the hash of any range."""
    up, _ = powers(len(values) + 1)
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], dtype=np.uint64, out=out[1:])
    return out


def range_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of values[start:end], the same wherever the range lies."""
    _, down = powers(len(prefix))
    return (prefix[end] - prefix[start]) * down[start]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts of a column as one byte array and the len + 1 offsets; a null is an empty text."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    raw = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32) if len(column) else np.zeros(1, np.int64)
    offsets = raw[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else raw
    if offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes, or one row where that is longer."""
    low, rows = 0, len(offsets) - 1
    while low < rows:
        high = int(np.searchsorted(offsets, offsets[low] + limit, "right")) - 1
        high = min(max(high, low + 1), rows)
        yield low, high
        low = high


def words(data: np.ndarray, offsets: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each maximal run of member bytes inside one text, and the number of words before each text."""
    inside = member[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    filled = offsets[1:] > offsets[:-1]
    first[offsets[:-1][filled]] = inside[offsets[:-1][filled]]
    last[offsets[1:][filled] - 1] = inside[offsets[1:][filled] - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return mixed(range_hash(prefix_hash(data.astype(np.uint64) + np.uint64(1)), starts, ends))


def run_hashes(hashes: np.ndarray, length: int) -> np.ndarray:
    """Hash of each run of ``length`` consecutive words; runs that cross a text's end are the caller's to drop."""
    if len(hashes) < length:
        return np.zeros(0, np.uint64)
    at = np.arange(len(hashes) - length + 1)
    return mixed(range_hash(prefix_hash(hashes), at, at + length))


def release() -> None:
    """Gives freed memory back to the system. A worker process serves many tasks of many stages, and would else keep the most it ever held."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def freed(work: Callable) -> Callable:
    """``work`` on batches, with ``release`` at its end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from work(batches)
        finally:
            release()

    return run
