"""Gathering of variable-length pieces from one flat array."""

from __future__ import annotations

import numpy as np

#: Bytes of strings and ids that a worker keeps.
CACHE_BYTES = 32 << 20


def offsets(length: np.ndarray) -> np.ndarray:
    out = np.zeros(len(length) + 1, np.int64)
    np.cumsum(length, out=out[1:])
    return out


def gather(flat: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """flat[start[i]:start[i] + length[i]] of all i, one after another."""
    end = offsets(length)
    index = np.repeat(start - end[:-1], length)
    index += np.arange(end[-1])
    return flat[index]


class PieceCache:
    """Ids of strings that occur again and again, kept from batch to batch of a worker.  It is emptied before a batch
    when it holds ``limit`` bytes, by an estimate of what a string, its place and its ids take."""

    def __init__(self, encode, limit: int = CACHE_BYTES):
        self.encode, self.limit = encode, limit
        self._clear()

    def _clear(self) -> None:
        self.place: dict[str, int] = {}
        self.bytes = 0
        self.start, self.count = np.empty(1024, np.int64), np.empty(1024, np.int64)
        self.ids, self.used = np.empty(4096, np.int32), 0

    @staticmethod
    def _grown(array: np.ndarray, size: int) -> np.ndarray:
        if size <= len(array):
            return array
        out = np.empty(max(size, 2 * len(array)), array.dtype)
        out[: len(array)] = array
        return out

    def look_up(self, strings: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids' flat array, and where each string's ids start in it and how many they are."""
        if self.bytes > self.limit:
            self._clear()
        at = np.fromiter((self.place.get(x, -1) for x in strings), np.int64, len(strings))
        new = np.flatnonzero(at < 0)
        if len(new):
            fresh = [strings[i] for i in new.tolist()]
            ids, count = self.encode(fresh)
            base, size = len(self.place), len(self.place) + len(fresh)
            self.start, self.count = self._grown(self.start, size), self._grown(self.count, size)
            self.ids = self._grown(self.ids, self.used + len(ids))
            self.ids[self.used : self.used + len(ids)] = ids
            self.start[base:size], self.count[base:size] = self.used + offsets(count)[:-1], count
            self.used += len(ids)
            self.bytes += 200 * len(fresh) + sum(map(len, fresh)) + 4 * len(ids)
            self.place.update(zip(fresh, range(base, size), strict=True))
            if len(self.place) != size:
                raise ValueError("strings must be distinct")
            at[new] = np.arange(base, size)
        return self.ids, self.start[at], self.count[at]
