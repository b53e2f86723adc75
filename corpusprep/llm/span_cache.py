"""Work on the distinct spans of a batch of texts, put back in order with numpy."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

KEPT = 500_000  # distinct spans held between batches
VALUES = 4_000_000  # values of their arrays


def gather(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The runs ``flat[start : start + size]`` end to end."""
    before = np.cumsum(sizes) - sizes
    return flat[np.arange(int(sizes.sum()), dtype=np.int64) + np.repeat(starts - before, sizes)]


class SpanCache:
    """Arrays made from spans (words, say), each distinct span worked on once while it is held.

    ``encode`` takes a list of strings and returns their arrays as one flat array and the lengths.
    Past ``KEPT`` spans or ``VALUES`` values the half that served the most batches stays.
    """

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], dtype: type):
        self.encode = encode
        self.known = np.zeros(0, np.uint64)
        self.start, self.size, self.used = (np.zeros(0, np.int64) for _ in range(3))
        self.flat = np.zeros(0, dtype)

    def _shrink(self) -> None:
        best = np.argsort(-self.used, kind="stable")[: len(self.known) // 2]
        fit = np.cumsum(self.size[best]) <= VALUES // 2
        best = np.sort(best[fit])
        self.flat = gather(self.flat, self.start[best], self.size[best])
        self.known, self.size = self.known[best], self.size[best]
        self.start = np.cumsum(self.size) - self.size
        self.used = self.used[best] // 2

    def _add(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> None:
        raw = data.tobytes()
        flat, sizes = self.encode([raw[s:e].decode() for s, e in zip(starts.tolist(), ends.tolist())])
        begin = np.cumsum(sizes) - sizes + len(self.flat)
        known = np.concatenate([self.known, hashes])
        order = np.argsort(known, kind="stable")
        self.known = known[order]
        self.start = np.concatenate([self.start, begin])[order]
        self.size = np.concatenate([self.size, sizes])[order]
        self.used = np.concatenate([self.used, np.zeros(len(sizes), np.int64)])[order]
        self.flat = np.concatenate([self.flat, flat.astype(self.flat.dtype)])

    def of(
        self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray
    ) -> tuple[np.ndarray, np.ndarray]:
        """The spans' arrays in order as one flat array, and the length of each."""
        if not len(hashes):
            return self.flat[:0], np.zeros(0, np.int64)
        if len(self.known) > KEPT or len(self.flat) > VALUES:
            self._shrink()
        unique, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        at = np.searchsorted(self.known, unique)
        missing = np.ones(len(unique), bool)
        inside = at < len(self.known)
        missing[inside] = self.known[at[inside]] != unique[inside]
        if missing.any():
            new = first[missing]
            self._add(data, starts[new], ends[new], hashes[new])
            at = np.searchsorted(self.known, unique)
        self.used[at] += 1
        slot = at[inverse]
        return gather(self.flat, self.start[slot], self.size[slot]), self.size[slot]
