"""A bounded, vectorised map from 64-bit string hashes to short arrays, for encoding each distinct word once a worker."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from itertools import chain

import numpy as np

U = np.uint64


class WordTable:
    """Open addressing over numpy arrays; emptied when full, which costs time but changes no result."""

    def __init__(self, dtype: type, slots_log2: int = 22, pool_limit: int = 1 << 25):
        self.dtype, self.mask, self.pool_limit = dtype, (1 << slots_log2) - 1, pool_limit
        self.reset()

    def reset(self) -> None:
        n = self.mask + 1
        self.keys = np.zeros(n, np.uint64)
        self.entry = np.zeros(n, np.int32)
        self.start = np.zeros(n // 2 + 1, np.int64)
        self.size = np.zeros(n // 2 + 1, np.int32)
        self.pool = np.zeros(1 << 16, self.dtype)
        self.count = self.used = 0

    def find(self, h: np.ndarray) -> np.ndarray:
        """Entry of each hash, -1 where there is none."""
        out = np.full(len(h), -1, np.int64)
        at = (h & U(self.mask)).astype(np.int64)
        todo = np.arange(len(h))
        while len(todo):
            k = self.keys[at]
            hit = k == h[todo]
            out[todo[hit]] = self.entry[at[hit]]
            on = ~hit & (k != 0)
            todo, at = todo[on], (at[on] + 1) & self.mask
        return out

    def add(self, h: np.ndarray, values: list) -> None:
        """New distinct hashes with their arrays."""
        sizes = np.fromiter(map(len, values), np.int64, len(values))
        flat = np.fromiter(chain.from_iterable(values), self.dtype, int(sizes.sum()))
        if self.used + len(flat) > len(self.pool):
            grown = np.zeros(max(2 * len(self.pool), self.used + len(flat)), self.dtype)
            grown[: self.used] = self.pool[: self.used]
            self.pool = grown
        self.pool[self.used : self.used + len(flat)] = flat
        new = np.arange(self.count, self.count + len(h))
        self.start[new] = self.used + np.cumsum(sizes) - sizes
        self.size[new] = sizes
        self.used += len(flat)
        self.count += len(h)
        at = (h & U(self.mask)).astype(np.int64)
        while len(h):
            free = np.flatnonzero(self.keys[at] == 0)
            _, first = np.unique(at[free], return_index=True)
            put = free[first]
            self.keys[at[put]] = h[put]
            self.entry[at[put]] = new[put]
            left = np.ones(len(h), bool)
            left[put] = False
            h, new, at = h[left], new[left], at[left]
            taken = self.keys[at] != 0
            at = np.where(taken, (at + 1) & self.mask, at)

    def encode(self, h: np.ndarray, make: Callable[[np.ndarray], Iterable]) -> tuple[np.ndarray, np.ndarray]:
        """The arrays of all hashes, joined, and the size of each. make: arrays for the given positions of h."""
        h = np.where(h == 0, U(1), h)
        found = self.find(h)
        missing = np.flatnonzero(found < 0)
        if len(missing):
            unique, first = np.unique(h[missing], return_index=True)
            if self.count + len(unique) >= len(self.size) or self.used > self.pool_limit:
                if len(unique) >= len(self.size):  # more than the table has room for: one half after the other
                    half = len(h) // 2
                    parts = self.encode(h[:half], make), self.encode(h[half:], lambda at: make(at + half))
                    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))
                self.reset()
                return self.encode(h, make)
            self.add(unique, list(make(missing[first])))
            found[missing] = self.find(h[missing])
        sizes = self.size[found].astype(np.int64)
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        take = np.repeat(self.start[found] - (ends - sizes), sizes)
        take += np.arange(total)
        return self.pool[take], sizes
