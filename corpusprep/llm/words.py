"""Whole Arrow batches of texts cut into words and hashed with numpy, without a loop over words.

A word's hash is a sum of byte times position multiplier (mod 2^64), passed through a 64-bit mixer;
two different words collide with a chance of about 2^-57.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE = 1 << 16  # bytes hashed at a time: eight bytes of work for each stay in a core's cache
_MULTIPLIERS = np.random.default_rng(20240229).integers(1, 1 << 63, 4096, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SPACES = np.zeros(256, bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finalizer of splitmix, on uint64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``(bytes, offsets)`` of a string column; nulls are empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(batch: pa.RecordBatch, text: str = "text", limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``limit`` bytes of text each; a longer text stands alone."""
    if not batch.num_rows:
        return
    sizes = np.diff(text_bytes(batch.column(text))[1])
    block = np.cumsum(sizes) // limit
    cuts = np.flatnonzero(np.diff(block)) + 1
    for s, e in zip([0, *cuts], [*cuts, batch.num_rows]):
        yield batch.slice(int(s), int(e - s))


def word_spans(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray]:
    """Start and end (in bytes) of every run of non-separators; no run crosses a text's end."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = ~separators[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    heads = offsets[:-1][np.diff(offsets) > 0]  # first byte of every text that has one
    begins[heads] = inside[heads]
    tails = heads[1:] - 1
    ends[tails] = inside[tails]
    return np.flatnonzero(begins), np.flatnonzero(ends) + 1


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One uint64 for each span of ``data``."""
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + PIECE, side="right")))
        s, e = starts[at:to], ends[at:to]
        sizes = e - s
        first = np.cumsum(sizes) - sizes
        within = np.arange(int(sizes.sum()), dtype=np.int64) - np.repeat(first, sizes)
        taken = data[within + np.repeat(s, sizes)].astype(np.uint64) + np.uint64(1)
        out[at:to] = np.add.reduceat(taken * _MULTIPLIERS[within & 4095], first)
        at = to
    return mix(out)


def words_of(batch_text: pa.Array, lower: bool = True, separators: np.ndarray = SPACES):
    """``(data, starts, ends, hashes, rows)``: every word of a text column; ``rows`` has the first
    word's index of each text and one index past the last."""
    data, offsets = text_bytes(batch_text)
    if lower:
        data = LOWER[data]
    starts, ends = word_spans(data, offsets, separators)
    return data, starts, ends, word_hashes(data, starts, ends), np.searchsorted(starts, offsets)


def shingles(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hashes of ``width`` successive words; fewer words make one shingle, none make none."""
    n = len(hashes)
    if n == 0:
        return hashes
    k = min(width, n)
    out = np.full(n - k + 1, np.uint64(k))
    for i in range(k):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + hashes[i : n - k + 1 + i])
    return out
