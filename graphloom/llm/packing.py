"""Packing token pieces into sequences by multiway differencing.

A document's ids (tokenizer, then END) are cut into pieces of CAPACITY and a rest, and the rest again into parts of at most
`max_part` ids. Full pieces are sequences of their own. The parts are dealt by a random salt into groups of
about GROUP_WINDOWS sequences, and each group is partitioned by the Karmarkar-Karp method: every part starts as a partial
partition of k windows, of which one holds it; the two partial partitions with the largest
spread are merged, the fullest window of one with the emptiest of the other, until one is left. k starts at the least count
that could hold the group and rises while the fullest window exceeds CAPACITY.

Parts of fewer than SMALL ids are first tied into bundles of about BUNDLE ids, which stay together, so the number of partial partitions follows the tokens
also where texts are short or empty.

Groups bound memory whatever the input: a group is at most some half a million rows of seven numbers (a few thousand, unless texts are tiny), a hot or repeated id spreads over
groups (the salt holds the row's place, not only its id), and no task sees all of the table.

Defined results: null and empty texts hold END alone; each row of the input, repeated or not, is packed; a null id is
kept as null; an empty table gives no pieces.
"""

from __future__ import annotations

import heapq
import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import cut, frugal, worker_cache
from graphloom.llm.textbatch import IS_SPACE, LOWER, TextBatch, chunks, slices
from graphloom.llm.wordtable import WordTable

CAPACITY = 4096
END = 2
GROUP_WINDOWS = 128
#: Several small parts to a window come out almost even; larger parts mean fewer cuts and more padding.
MAX_PART = 512
PART_ENTRIES = 100_000
SMALL, BUNDLE = 128, 256
#: Bytes of a text that are encoded at once, when it is longer.
LONG = 1 << 21

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, salt long"
PACKED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


_LETTER, _STOP, _MARK = (np.zeros(256, bool) for _ in range(3))
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_STOP[[ord("."), ord(",")]] = True
_MARK[[0xCC, 0xCD]] = True  # first bytes of combining marks that join Latin letters


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable bytes stand for themselves, the rest for letters from 256 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(others)) for b in range(256)]


class WordEncoder:
    """Ids of white-space-free chunks. The vocabulary drops white space, so a text's ids are those of its chunks in order.

    Chunks of plain Latin letters are lower-cased, split by the vocabulary's own pattern and given to its model; all others go through
    the whole tokenizer. Each distinct chunk is encoded once a worker, as long as the table has room."""

    _plain = re.compile("[!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u0148\u014a-\u017e]{1,200}")
    _split = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u017e]+|[0-9]|[^a-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u017e0-9]+")

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.model = self.tokenizer.model
        self.letters = byte_letters()
        self.parts: dict[str, list[int]] = {}
        self.table = WordTable(np.uint32, slots_log2=21)

    def chunk(self, text: str) -> list[int]:
        if text.isascii() and text.isalpha() and len(text) < 200:
            return [t.id for t in self.model.tokenize(text.lower())]
        if not self._plain.fullmatch(text):
            return self.tokenizer.encode(text, add_special_tokens=False).ids
        found = self._split.findall(text.lower())
        return self.part(found[0]) if len(found) == 1 else [i for p in found for i in self.part(p)]

    def part(self, p: str) -> list[int]:
        ids = self.parts.get(p)
        if ids is None:
            shown = p if p.isascii() else "".join([self.letters[b] for b in p.encode()])
            ids = [t.id for t in self.model.tokenize(shown)]
            if len(self.parts) >= PART_ENTRIES:
                self.parts.clear()
            self.parts[p] = ids
        return ids

    def texts(self, texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first row, ids joined, ids of each row) of runs of rows; END closes each row. A long text is encoded in pieces."""
        for row, part in chunks(texts):
            text = part[0].as_py() if len(part) == 1 else b""
            if len(text) > LONG:
                space = np.flatnonzero(IS_SPACE[np.frombuffer(text, np.uint8)])
                ids = np.concatenate([*[self._run(pa.array([x], pa.large_binary()))[0] for x in slices(text, LONG, space)], np.array([END], np.uint32)])
                yield row, ids, np.array([len(ids)])
                continue
            ids, own = self._run(part)
            yield row, np.insert(ids, np.cumsum(own), np.uint32(END)), own + 1

    def _run(self, part: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts, joined, and the number of each's."""
        b = TextBatch(part)
        if not _MARK[b.data].any():  # else a mark could join a small letter but not its capital
            b.data = LOWER[b.data]
        start, end = b.words()
        stop = end[_STOP[b.data[end - 1]] & (end - start > 1)]
        stop = stop[_LETTER[b.data[stop - 2]]] - 1  # a full stop or comma after a letter is a match of its own
        start, end = np.sort(np.concatenate([start, stop])), np.sort(np.concatenate([end, stop]))
        raw = b.data.tobytes()
        ids, sizes = self.table.encode(b.hashes(start, end), lambda at: [self.chunk(raw[i:j].decode()) for i, j in zip(start[at].tolist(), end[at].tolist())])
        return ids, np.bincount(b.owner(start), sizes, b.n).astype(np.int64)


_encoders: dict[str, WordEncoder] = worker_cache("packing")


def encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def cuts(n: int, capacity: int, max_part: int) -> Iterator[tuple[int, int]]:
    """(start, length) of a document's pieces: full ones, then the rest in nearly equal parts."""
    full = n - n % capacity
    for s in range(0, full, capacity):
        yield s, capacity
    rest = n - full
    k = -(-rest // max_part)
    for i in range(k):
        a, b = rest * i // k, rest * (i + 1) // k
        yield full + a, b - a


def cut_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, max_part: int = MAX_PART) -> DataFrame:
    """PIECES of every row; a piece's salt mixes task, row and place."""

    @frugal("packing")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        task, rows = TaskContext.get().partitionId(), 0
        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            for first, ids, sizes in enc.texts(batch.column(1)):
                view = memoryview(ids.astype("<u4")).cast("B")
                out, at = [], 0
                for i, n in enumerate(sizes.tolist()):
                    for s, length in cuts(n, capacity, max_part):
                        out.append((doc_ids[first + i], s, length, zlib.crc32(view[4 * (at + s) : 4 * (at + s + length)]), n, zlib.crc32(struct.pack("<QQQ", task, rows, s))))
                    at += n
                    rows += 1
                yield _batch(out)

    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, PIECES)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * 6
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=[x.split()[0] for x in PIECES.split(", ")])


def differencing(sizes: np.ndarray, k: int) -> tuple[np.ndarray, int]:
    """Window of each part and the fullest window's size, for k windows."""
    if k == 1:
        return np.zeros(len(sizes), np.int64), int(sizes.sum())
    heap, sums = [], []
    for i, s in enumerate(sizes.tolist()):
        v = np.zeros(k, np.int64)
        v[0] = s
        sums.append(v)  # falling
        heap.append((-s, i))
    heapq.heapify(heap)
    merged: list[tuple[int, int, np.ndarray]] = []
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        v = sums[a] + sums[b][::-1]
        order = np.argsort(-v)
        v = v[order]
        sums[a] = sums[b] = None
        merged.append((a, b, order))
        sums.append(v - v[-1])
        heapq.heappush(heap, (int(v[-1] - v[0]), len(sums) - 1))
    window = np.zeros(len(sizes), np.int64)
    place: dict[int, np.ndarray] = {len(sums) - 1: np.arange(k)}
    for j in range(len(merged) - 1, -1, -1):
        a, b, order = merged[j]
        here = place.pop(len(sizes) + j)
        at = np.empty(k, np.int64)
        at[order] = here
        for node, slots in ((a, at), (b, at[::-1])):
            if node < len(sizes):
                window[node] = slots[0]
            else:
                place[node] = slots
    return window, int(np.bincount(window, sizes, k).max())


def bundles(sizes: np.ndarray, small: int = SMALL, size: int = BUNDLE) -> np.ndarray:
    """Bundle of each part, from 0: small parts share bundles of less than size + small ids, in their order; each other part is one."""
    tiny = sizes < small
    out = np.empty(len(sizes), np.int64)
    ends = np.cumsum(sizes[tiny])
    out[tiny] = (ends - sizes[tiny]) // size
    n = int(out[tiny].max(initial=-1)) + 1
    out[~tiny] = n + np.arange(len(sizes) - len(ends))
    return np.unique(out, return_inverse=True)[1]


def pack_parts(sizes: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """Window of each part; no window exceeds capacity."""
    bundle = bundles(sizes, min(SMALL, max(1, capacity // 32)), min(BUNDLE, max(1, capacity // 16)))
    return pack_bundles(np.bincount(bundle, sizes).astype(np.int64), capacity)[bundle]


def pack_bundles(sizes: np.ndarray, capacity: int) -> np.ndarray:
    total = int(sizes.sum())
    k = max(1, -(-total // capacity))
    while True:
        window, fullest = differencing(sizes, k)
        if fullest <= capacity:
            return window
        over = fullest - total / k  # the next count's mean leaves room for as uneven a result
        k = max(k + 1, int(np.ceil(total / max(capacity - over, capacity / 2))))


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, max_part: int = MAX_PART) -> DataFrame:
    """PACKED: one row per piece."""
    pieces = cut(cut_pieces(docs, path or tokenizer_path(), capacity, max_part))
    total = pieces.agg(F.sum("length").alias("n")).first()["n"] or 0
    groups = max(1, -(-total // (GROUP_WINDOWS * capacity)))

    def run(key: tuple, t: pa.Table) -> pa.Table:
        t = t.sort_by([("salt", "ascending"), ("doc_id", "ascending"), ("start", "ascending")])
        sizes = t["length"].to_numpy()
        whole = sizes == capacity
        window = np.empty(len(sizes), np.int64)
        window[whole] = np.arange(whole.sum())
        if not whole.all():
            window[~whole] = whole.sum() + np.unique(pack_parts(sizes[~whole], capacity), return_inverse=True)[1]
        order = np.argsort(window, kind="stable")
        ends = np.cumsum(sizes[order])
        first = np.concatenate([[True], np.diff(window[order]) != 0])
        base = np.maximum.accumulate(np.where(first, ends - sizes[order], 0))
        offset = ends - sizes[order] - base
        t = t.take(pa.array(order))
        return pa.table([t[c] for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")] + [pa.array((key[0].as_py() << 32) + window[order]), pa.array(offset)], names=[x.split()[0] for x in PACKED.split(", ")])

    return pieces.withColumn("g", F.pmod(F.col("salt"), F.lit(groups))).groupBy("g").applyInArrow(run, PACKED)
