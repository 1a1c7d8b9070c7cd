"""Vectorised views of a batch of texts: bytes, words, lines and their hashes.

A batch is one uint8 array in which every text is followed by one newline, so no word or line crosses
texts. Words are runs of bytes other than 0x20 and 0x09-0x0D, which in UTF-8 equals the same rule on
characters. Strings are identified by 64-bit polynomial hashes (random byte values, odd base, mixed at
the end): two different strings of a corpus with m distinct strings meet with probability about
m * m / 2**65.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
#: Bytes handled at once; a longer text forms a batch of its own.
CHUNK_BYTES = 1 << 20
#: Batches beyond this size, which are single long texts, are hashed in runs of CHUNK_BYTES.
LONG_BYTES = 1 << 22

_rng = np.random.default_rng(20240229)
BYTE_VALUE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
BASE = int(0x9E3779B97F4A7C15)
BASE_INV = pow(BASE, -1, 2**64)
_pow = {"b": np.ones(1, np.uint64), "i": np.ones(1, np.uint64)}

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def _powers(kind: str, n: int) -> np.ndarray:
    have = _pow[kind]
    step = BASE if kind == "b" else BASE_INV
    while len(have) < n:
        have = np.concatenate([have, have * U(pow(step, len(have), 2**64))])
    _pow[kind] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads all bits."""
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(32))


def chunks(array: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """(first row, slice) of at most `limit` bytes, or one text."""
    array = as_binary(array)
    n = len(array)
    if n == 0:
        return
    sizes = np.diff(np.frombuffer(array.buffers()[1], np.int64, n + 1, array.offset * 8)) if n else np.zeros(0, np.int64)
    ends = np.cumsum(sizes)
    i = 0
    while i < n:
        done = ends[i - 1] if i else 0
        j = max(i + 1, int(np.searchsorted(ends, done + limit, "right")))
        yield i, array.slice(i, j - i)
        i = j


def slices(text: bytes, limit: int, at: np.ndarray) -> Iterator[bytes]:
    """A text in pieces of about `limit` bytes, cut at some of the positions `at`, which ascend."""
    done = 0
    while done < len(text):
        k = int(np.searchsorted(at, done + limit))
        stop = int(at[k]) if k < len(at) else len(text)
        yield text[done:stop]
        done = stop


def as_binary(array: pa.Array) -> pa.Array:
    """Nulls become empty; 64-bit offsets."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    if array.type != pa.large_binary():
        array = array.cast(pa.large_string()).cast(pa.large_binary()) if not pa.types.is_binary(array.type) else array.cast(pa.large_binary())
    return array.fill_null(b"") if array.null_count else array


def _sums(data: np.ndarray) -> np.ndarray:
    s = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_VALUE[data] * _powers("b", len(data)), out=s[1:])
    return s


def _spans(s: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of spans from the running sums of their bytes; a span's hash doesn't depend on its place."""
    inv = _powers("i", len(s))
    return mix((s[end] - s[start]) * inv[start] + (end - start).astype(np.uint64))


def _long_span(data: np.ndarray) -> np.uint64:
    """The hash of one span, added up in runs."""
    total = len(data)
    for at in range(0, len(data), CHUNK_BYTES):
        part = data[at : at + CHUNK_BYTES]
        total += int((BYTE_VALUE[part] * _powers("b", len(part))).sum()) * pow(BASE, at, 2**64)
    return mix(np.array([total % 2**64], np.uint64))[0]


class TextBatch:
    """One chunk as arrays. Offsets are byte positions in `data`."""

    def __init__(self, array: pa.Array, lower: bool = False):
        array = as_binary(array)
        self.n = n = len(array)
        off = np.frombuffer(array.buffers()[1], np.int64, n + 1, array.offset * 8)
        raw = np.frombuffer(array.buffers()[2], np.uint8)[off[0] : off[-1]] if array.buffers()[2] is not None else np.zeros(0, np.uint8)
        self.sizes = np.diff(off)
        self.begin = off[:-1] - off[0] + np.arange(n)
        self.end = self.begin + self.sizes
        data = np.full(len(raw) + n, 10, np.uint8)
        if n == 1:
            data[:-1] = raw
        else:
            keep = np.ones(len(data), bool)
            keep[self.end] = False
            data[keep] = raw
        self.data = LOWER[data] if lower else data
        self._prefix = None

    def prefix(self) -> np.ndarray:
        if self._prefix is None:
            self._prefix = _sums(self.data)
        return self._prefix

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Of spans in ascending order that don't overlap."""
        if len(self.data) <= LONG_BYTES:
            return _spans(self.prefix(), start, end)
        out = np.empty(len(start), np.uint64)
        i = 0
        while i < len(start):
            lo = int(start[i])
            j = int(np.searchsorted(end, lo + CHUNK_BYTES, "right"))
            if j > i:
                out[i:j] = _spans(_sums(self.data[lo : end[j - 1]]), start[i:j] - lo, end[i:j] - lo)
            else:
                j = i + 1
                out[i] = _long_span(self.data[lo : end[i]])
            i = j
        return out

    def words(self) -> tuple[np.ndarray, np.ndarray]:
        """Start and end of each word."""
        solid = np.zeros(len(self.data) + 2, np.int8)
        solid[1:-1] = ~IS_SPACE[self.data]
        edge = np.diff(solid)
        return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)

    def owner(self, positions: np.ndarray) -> np.ndarray:
        """Index of the text that holds each position."""
        return np.searchsorted(self.end, positions, "left")

    def count(self, table: np.ndarray) -> np.ndarray:
        """Bytes of each text for which table is true."""
        if self.n == 1:
            return np.array([np.count_nonzero(table[self.data[:-1]])])
        c = np.zeros(len(self.data) + 1, np.int64)
        np.cumsum(table[self.data], out=c[1:])
        return c[self.end] - c[self.begin]


def windows(h: np.ndarray, owner: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of the k words from i on, i) for every i whose window stays in one text."""
    m = len(h) - k + 1
    if m <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = np.flatnonzero(owner[:m] == owner[k - 1 :])
    out = h[:m].copy()
    for j in range(1, k):
        out *= U(0x9E3779B97F4A7C15)
        out += h[j : j + m]
    return mix(out[at]), at


def repeated(keys: np.ndarray, groups: np.ndarray) -> np.ndarray:
    """True where an equal key occurs elsewhere in the same group; groups ascend."""
    if not len(keys):
        return np.zeros(0, bool)
    both = mix(keys ^ (groups.astype(np.uint64) * U(0x9E3779B97F4A7C15)))
    order = np.argsort(both)
    s = both[order]
    same = s[1:] == s[:-1]
    out = np.zeros(len(keys), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def later_copies(keys: np.ndarray, groups: np.ndarray) -> np.ndarray:
    """True for all but one of equal keys in the same group."""
    if not len(keys):
        return np.zeros(0, bool)
    both = mix(keys ^ (groups.astype(np.uint64) * U(0x9E3779B97F4A7C15)))
    order = np.argsort(both)
    out = np.zeros(len(keys), bool)
    out[order[1:][both[order][1:] == both[order][:-1]]] = True
    return out
