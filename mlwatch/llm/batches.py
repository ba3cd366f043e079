"""Texts of an Arrow batch as bytes, and their words as hashes, without a Python loop over words."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IN_WORD = np.ones(256, bool)
IN_WORD[[0x20, *range(0x09, 0x0E)]] = False
STEP = np.uint64(0x9E3779B97F4A7C15)
GRAM = np.uint64(0xC2B2AE3D27D4EB4F)
CODE = np.random.default_rng(20_177).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
CODE_LOWER = CODE[LOWER]
TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


def released() -> None:
    """Hand memory that a task no longer needs back to the system: workers live on, and the tasks of later steps need room."""
    _powers.cache_clear()
    pa.default_memory_pool().release_unused()
    if TRIM is not None:
        TRIM(0)


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches that hold at most ``most`` bytes of text, or a single row; memory is released after the last."""
    yield from _slices(batches, column, most)
    released()


def _slices(batches: Iterator[pa.RecordBatch], column: str, most: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if not b.num_rows:
            continue
        ends = np.cumsum(text_bytes(b.column(column))[1][1:] - text_bytes(b.column(column))[1][:-1])
        at = 0
        while at < b.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + most, "right")))
            yield b.slice(at, to - at)
            at = to


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string array and the offsets of its rows in them; a null is empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.empty(0, np.uint8)
    return raw, at.astype(np.int64) - int(at[0])


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = np.uint64(pow(int(STEP), -1, 1 << 64))
    up, down = np.full(n, STEP), np.full(n, inverse)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """STEP to the powers 0, 1, ... modulo 2**64, and their inverses; kept for the next slice."""
    size = max(SLICE_BYTES + 1, 1 << int(n).bit_length())
    up, down = _powers(size)
    return up[:n], down[:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """A one-to-one scramble of 64-bit numbers, so that any bits of the result serve as a hash."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def words(raw: np.ndarray, at: np.ndarray, fold: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and hash of every word of every row, and the offsets of the rows among the words.

    A word is a longest run of other bytes than space, tab, line feed, vertical tab, form feed and carriage return.
    ``fold`` lower-cases A to Z. Hashes come from running sums of a polynomial, so that their cost does not depend on
    the lengths of the words.
    """
    n = len(raw)
    inside = IN_WORD[raw]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    cut = at[1:-1]
    cut = cut[(cut > 0) & (cut < n)]
    first[cut] = inside[cut]
    last[cut - 1] = inside[cut - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    up, down = powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((CODE_LOWER if fold else CODE)[raw] * up[:n], out=total[1:])
    return start, end, mixed((total[end] - total[start]) * down[start]), np.searchsorted(start, at)


def grams(hashes: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every run of ``k`` words within a row, or of a shorter row's whole sequence, and the rows' offsets."""
    size = np.diff(rows)
    count = np.where(size >= k, size - k + 1, (size > 0).astype(size.dtype))
    offsets = np.concatenate([[0], np.cumsum(count)])
    begin = np.repeat(rows[:-1] - offsets[:-1], count) + np.arange(offsets[-1])
    left = np.repeat(rows[1:], count) - begin
    out = np.zeros(len(begin), np.uint64)
    padded = np.concatenate([hashes, np.zeros(k, np.uint64)])
    for j in range(k):
        out = out * GRAM + np.where(left > j, padded[begin + j], np.uint64(0))
    return mixed(out + np.minimum(left, k).astype(np.uint64)), offsets
