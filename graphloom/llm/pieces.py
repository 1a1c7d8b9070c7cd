"""Encoding and decoding with a merge-type SentencePiece vocabulary.

A text is encoded as the library does it: spaces become the mark U+2581, one mark is put in front, and characters are merged by an
agenda of adjacent symbol pairs, the highest-scored piece first and of equal ones the leftmost; an entry of the agenda whose symbols
have changed since is skipped. Characters outside the vocabulary become byte pieces.

No piece of such a vocabulary has a mark after another character or holds a newline, so a text is encoded segment by
segment: a run of marks with what follows it, or what follows a newline. Each distinct segment goes through the agenda once a
worker, and is checked against the library in the same Arrow batch; where they differ, the library's ids are
taken and counted in n_repaired of each text that holds the segment. Texts that hold the mark itself, and vocabularies that break the two rules, are
encoded whole.

Defined results: null and empty texts have no ids (and the empty text back); repeated rows have equal results; empty tables give empty results.
"""

from __future__ import annotations

import hashlib
import heapq
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.textbatch import TextBatch, chunks, slices
from graphloom.llm.wordtable import WordTable

MARK = "▁"
#: Bytes of a text that are encoded at once, and ids that are decoded at once, when it is longer.
LONG = 1 << 21
RUN = 1 << 19
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protocol buffer message."""
    i = 0

    def number() -> int:
        nonlocal i
        value = shift = 0
        while True:
            b = data[i]
            i += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while i < len(data):
        key = number()
        if key & 7 == 0:
            yield key >> 3, number()
        else:
            size = {1: 8, 5: 4}.get(key & 7) or number()
            yield key >> 3, data[i : i + size]
            i += size


class PieceEncoder:
    """The vocabulary, the agenda and the cache of segments."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.ids: dict[str, int] = {}
        self.score: dict[str, float] = {}
        self.bytes: dict[int, int] = {}
        self.unknown = 0
        with open(path, "rb") as f:
            data = f.read()
        for i, m in enumerate(dict(_fields(v)) for k, v in _fields(data) if k == 1):
            text, kind = m[1].decode(), m.get(3, NORMAL)
            if kind in (NORMAL, USER, UNUSED):
                self.ids[text] = i
                self.score[text] = struct.unpack("<f", m[2])[0] if 2 in m else 0.0
            elif kind == BYTE:
                self.bytes[int(text[3:-1], 16)] = i
            elif kind == UNKNOWN:
                self.unknown = i
        self.splits = not any("\n" in p or MARK in p.lstrip(MARK) for p in self.ids)
        self.table = WordTable(np.int32)
        self.repaired = 0  # segments so far
        self.wrong = np.zeros(0, np.uint64)  # their hashes
        self.repaired_of = np.zeros(0, np.int64)  # such segments of each row of the run that texts gave last

    def merge(self, text: str) -> list[int]:
        """Ids of marked text, by the agenda."""
        symbols: list[str | None] = list(text)
        n, score = len(symbols), self.score
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        agenda: list[tuple[float, int, int, str]] = []
        for i in range(n - 1):
            pair = symbols[i] + symbols[i + 1]
            if pair in score:
                agenda.append((-score[pair], i, i + 1, pair))
        heapq.heapify(agenda)
        while agenda:
            _, i, j, pair = heapq.heappop(agenda)
            a, b = symbols[i], symbols[j]
            if a is None or b is None or after[i] != j or len(a) + len(b) != len(pair):
                continue
            symbols[i], symbols[j] = pair, None
            k = after[i] = after[j]
            if k >= 0:
                before[k] = i
                right = pair + symbols[k]
                if right in score:
                    heapq.heappush(agenda, (-score[right], i, k, right))
            h = before[i]
            if h >= 0:
                left = symbols[h] + pair
                if left in score:
                    heapq.heappush(agenda, (-score[left], h, i, left))
        out: list[int] = []
        for s in symbols:
            if s is not None:
                i = self.ids.get(s, -1)
                if i >= 0:
                    out.append(i)
                elif self.bytes:
                    out += [self.bytes[b] for b in s.encode()]
                elif not out or out[-1] != self.unknown:
                    out.append(self.unknown)
        return out

    def segments(self, texts: list[str], hashes: np.ndarray) -> list[list[int]]:
        """Ids of segments as they stand in a text (a leading space is the mark), checked against the library."""
        own = [self.merge(t.replace(" ", MARK)) for t in texts]
        # The library puts a mark in front: it stands for a segment's own first space; other segments are given a newline to follow.
        start = self.library.encode("\n")
        theirs = self.library.encode([t[1:] if t[0] == " " else "\n" + t for t in texts], num_threads=1)
        for i, (t, ids) in enumerate(zip(texts, theirs, strict=True)):
            want = ids if t[0] == " " and len(t) > 1 else own[i] if t == " " else ids[len(start) :]
            if want != own[i]:
                own[i] = want
                self.repaired += 1
                self.wrong = np.union1d(self.wrong, hashes[i : i + 1])
        return own

    def texts(self, texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first row, ids joined, ids of each row) of runs of rows. A long text is encoded in pieces that begin with a segment."""
        for row, part in chunks(texts):
            text = part[0].as_py() if len(part) == 1 else b""
            if len(text) <= LONG or not self.splits or MARK.encode() in text:
                yield row, *self._run(pc.binary_join_element_wise(pa.scalar(b" ", pa.large_binary()), part, pa.scalar(b"", pa.large_binary())), np.array(pc.greater(pc.binary_length(part), 0)))
                continue
            d = np.frombuffer(text, np.uint8)
            at = 1 + np.flatnonzero((d[1:] == 32) & (d[:-1] != 32) | (d[1:] == 10))
            found, repaired = [], 0
            for k, x in enumerate(slices(text, LONG, at)):
                found.append(self._run(pa.array([b" " * (k == 0) + x], pa.large_binary()), np.ones(1, bool))[0])
                repaired += int(self.repaired_of[0])
            self.repaired_of = np.array([repaired])
            ids = np.concatenate(found)
            yield row, ids, np.array([len(ids)])

    def _run(self, part: pa.Array, full: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts that begin with a segment, joined, and the number of each's; none where not full."""
        b = TextBatch(part)
        d = b.data
        last = np.concatenate([[10], d[:-1]])
        starts = (d == 32) & (last != 32) | (d == 10) | (last == 10)
        marked = np.zeros(len(d), bool)
        marked[:-2] = (d[:-2] == 0xE2) & (d[1:-1] == 0x96) & (d[2:] == 0x81)
        special = np.unique(b.owner(np.flatnonzero(marked))) if self.splits else np.arange(b.n)
        for i in special.tolist():
            starts[b.begin[i] : b.end[i]] = False
        starts[b.begin] = True
        starts[b.end] = True
        begin = np.flatnonzero(starts)
        stop = np.append(begin[1:], len(d))
        own = b.owner(begin)
        inside = (begin < b.end[own]) & full[own]  # not the separator after each text
        begin, stop, own = begin[inside], stop[inside], own[inside]
        raw = d.tobytes()
        hashes = b.hashes(begin, stop)
        ids, sizes = self.table.encode(hashes, lambda at: self.segments([raw[i:j].decode() for i, j in zip(begin[at].tolist(), stop[at].tolist())], hashes[at]))
        self.repaired_of = np.bincount(own, np.isin(hashes, self.wrong), b.n).astype(np.int64) if len(self.wrong) else np.zeros(b.n, np.int64)
        return ids, np.bincount(own, sizes, b.n).astype(np.int64)

    def digest(self, ids: np.ndarray) -> tuple[str, str]:
        """SHA-256 of the decimal ids, joined by commas, and of the text that the library decodes; ids are decoded in runs, which part between whole pieces."""
        joined, back = hashlib.sha256(), hashlib.sha256()
        part = np.isin(ids, list(self.bytes.values()))
        free = 1 + np.flatnonzero(~(part[:-1] & part[1:]))
        at = 0
        while True:
            k = int(np.searchsorted(free, at + RUN))
            stop = int(free[k]) if k < len(free) else len(ids)
            run = ids[at:stop].tolist()
            joined.update(("," if at else "").encode() + repr(run)[1:-1].replace(" ", "").encode())
            # a run after the first follows a letter, so that its first mark stays a space
            back.update((self.library.decode([self.ids["a"], *run])[1:] if at else self.library.decode(run)).encode())
            at = stop
            if at == len(ids):
                break
        return joined.hexdigest(), back.hexdigest()


_encoders: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    if path not in _encoders:
        _encoders[path] = PieceEncoder(path)
    return _encoders[path]


def encoded(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids: the ids of every whole text."""
    path = path or model_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            for row, ids, sizes in enc.texts(batch.column(1)):
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, len(sizes)), lists], names=["doc_id", "ids"])

    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, n_repaired: one row per document; the ids go through the library's decode."""
    path = path or model_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            for row, ids, sizes in enc.texts(batch.column(1)):
                ends = np.cumsum(sizes).tolist()
                if len(ids) > RUN and len(sizes) == 1:
                    joined, back = ([x] for x in enc.digest(ids))
                else:
                    flat = ids.tolist()
                    lists = [flat[e - n : e] for e, n in zip(ends, sizes.tolist(), strict=True)]
                    joined = [hashlib.sha256(repr(x)[1:-1].replace(" ", "").encode()).hexdigest() for x in lists]
                    back = [hashlib.sha256(x.encode()).hexdigest() for x in enc.library.decode(lists, num_threads=1)] if lists else []
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, len(sizes)), pa.array(sizes), pa.array(joined, pa.string()), pa.array(back, pa.string()), pa.array(enc.repaired_of)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "n_repaired"])

    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, n_repaired long")
