"""Alignment of two tokenizers' tokens by an event sweep.

Every token of A and B is an end event at the byte offset where it ends. A's and B's events are united, dealt by document and sorted by offset within partitions; a state machine that reads them in
order closes a group wherever both sides end at one offset. All A and B occurrences of a group are linked. An id pair's count is the number of documents that
hold it linked; among an A id's pairs those of the highest count are its best.

Plan. Each text is encoded once by both tokenizers; the events of one side in a window of bytes travel as one row (a run: the bytes before it, and its ids, whose byte lengths give the offsets), so that an event costs
two bytes rather than a row. The machine takes runs of many documents at once and keeps between them the open document's sums, its hash and the tokens since its last closed group,
never a document's events. Finished documents are written in blocks with their *distinct* pairs. Pairs are counted over blocks, the counts' table (bounded by the
product of the vocabularies, not broadcast) meets each block's distinct pairs by shuffle, pairs that very many blocks hold by broadcast of a bounded number, and a block's answers meet the block again by its number. Blocks and counts are removed when the result, a few numbers a document, is written.

Offsets are of a space and the text. Texts hold tokenizer marks as plain text.

Defined results: null and empty texts, and texts whose joined A or B token bytes differ from a space and the text (those that hold U+2581, which B reads as a space), have no tokens, count
in no pair and have zeros; repeated rows are documents each; null ids are kept; an empty table gives no rows; other columns have no effect.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import frugal, remove, spread_join, stored, worker_cache
from graphloom.llm.katz import squeeze, unsqueeze
from graphloom.llm.packing import byte_letters
from graphloom.llm.pieces import MARK, PieceEncoder
from graphloom.llm.textbatch import IS_SPACE, TextBatch, as_binary, chunks, slices
from graphloom.llm.wordtable import WordTable

#: Bytes of a text whose end events of one side make a run.
WINDOW = 1 << 15
#: Events that the machine takes at once; a block holds the documents that end among them.
STEP = 1 << 19
#: Bytes of a text that are encoded at once, when it is longer.
LONG = 1 << 21
#: Links of a group up to which they are listed; larger groups multiply the counts of their distinct ids.
LISTED = 1 << 12

EVENTS = "row long, doc_id long, at long, side int, ids binary"
BLOCKS = "block long, doc_id array<long>, sums binary, digests array<string>, codes binary, holders binary, entries binary, times binary"
GROUPS = "row long, doc_id long, start long, stop long, a array<int>, b array<int>"
ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def tokenizer_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


# encoding


def _after_space(d: np.ndarray) -> np.ndarray:
    """True where the character before may be white space: ASCII's, controls, or Unicode's other spaces."""
    last = np.full(len(d), 10, np.uint32)
    last[1:] = d[:-1]
    two, three = last.copy(), last.copy()
    two[2:] |= d[:-2].astype(np.uint32) << 8
    three[3:] |= (d[1:-2].astype(np.uint32) << 8) | (d[:-3].astype(np.uint32) << 16)
    wide = np.isin(two & 0xFFFF, [0xC285, 0xC2A0]) | np.isin(three, [0xE19A80, *range(0xE28080, 0xE2808B), 0xE280A8, 0xE280A9, 0xE280AF, 0xE2819F, 0xE38080])
    return (last <= 32) | wide


class ByteEncoder:
    """Ids of a byte-level vocabulary. Its pattern never matches across the start of a run of white space, so each distinct run with the characters after it is encoded once a worker."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.table = WordTable(np.uint32, slots_log2=21)
        letters = {c: b for b, c in enumerate(byte_letters())}
        names = sorted(self.tokenizer.get_vocab().items(), key=lambda x: x[1])
        self.bytes = [bytes(letters[c] for c in name) if all(c in letters for c in name) else name.encode() for name, _ in names]

    def run(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, joined, and the number of each's."""
        b = TextBatch(texts)
        d = b.data
        starts = IS_SPACE[d] & ~_after_space(d)
        starts[b.begin] = True
        starts[b.end] = True
        begin = np.flatnonzero(starts)
        stop = np.append(begin[1:], len(d))
        own = b.owner(begin)
        inside = begin < b.end[own]
        begin, stop, own = begin[inside], stop[inside], own[inside]
        raw = d.tobytes()

        def make(at: np.ndarray) -> list[list[int]]:
            return [x.ids for x in self.tokenizer.encode_batch([raw[i:j].decode() for i, j in zip(begin[at].tolist(), stop[at].tolist())], add_special_tokens=False)]

        ids, sizes = self.table.encode(b.hashes(begin, stop), make)
        return ids, np.bincount(own, sizes, b.n).astype(np.int64)

    def text(self, spaced: bytes) -> np.ndarray:
        """Ids of one text, encoded in pieces if it is long."""
        if len(spaced) <= LONG:
            return self.run(pa.array([spaced], pa.large_binary()))[0]
        d = np.frombuffer(spaced, np.uint8)
        at = np.flatnonzero(IS_SPACE[d] & ~_after_space(d))
        return np.concatenate([self.run(pa.array([x], pa.large_binary()))[0] for x in slices(spaced, LONG, at)])


class Vocabulary:
    """The bytes of each id, joined."""

    def __init__(self, tokens: list[bytes]):
        self.size = np.array([len(t) for t in tokens], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.pool = np.frombuffer(b"".join(tokens), np.uint8)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        size = self.size[ids]
        end = np.cumsum(size)
        return self.pool[np.repeat(self.start[ids] - (end - size), size) + np.arange(end[-1] if len(end) else 0)]

    def spells(self, ids: np.ndarray, text: np.ndarray) -> bool:
        """Whether the ids' bytes are the text; long ones are compared in runs."""
        if int(self.size[ids].sum()) != len(text):
            return False
        at = 0
        for k in range(0, len(ids), STEP):
            part = self.joined(ids[k : k + STEP])
            if not np.array_equal(part, text[at : at + len(part)]):
                return False
            at += len(part)
        return True


class Pair:
    """Both encoders and their vocabularies."""

    def __init__(self, a_path: str, b_path: str):
        self.a, self.b = ByteEncoder(a_path), PieceEncoder(b_path)
        self.words = self.vocabularies(a_path, b_path, self.a)

    @staticmethod
    def vocabularies(a_path: str, b_path: str, a: ByteEncoder | None = None) -> tuple[Vocabulary, Vocabulary]:
        import sentencepiece

        library = sentencepiece.SentencePieceProcessor(model_file=b_path)
        pieces = [bytes([int(p[3:5], 16)]) if library.is_byte(i) else p.replace(MARK, " ").encode() for i, p in ((i, library.id_to_piece(i)) for i in range(library.get_piece_size()))]
        return Vocabulary((a or ByteEncoder(a_path)).bytes), Vocabulary(pieces)

    def encode(self, texts: pa.Array) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids of both sides, joined, and the number of each text's; none where a text isn't spelt by both."""
        raw = [t.as_py() for t in texts]
        spaced = [b" " + t if t else b"" for t in raw]
        (_, b_ids, b_sizes), = self.b.texts(texts)
        if len(raw) == 1:
            a_ids = self.a.text(spaced[0])
            a_sizes = np.array([len(a_ids)])
        else:
            a_ids, a_sizes = self.a.run(pa.array(spaced, pa.large_binary()))
        text = np.frombuffer(b"".join(spaced), np.uint8)
        ids, sizes = [a_ids, np.asarray(b_ids)], [a_sizes, b_sizes]
        length = np.array([len(t) for t in spaced])
        for side in range(2):  # almost always all texts are spelt; else one by one
            v, own = self.words[side], np.repeat(np.arange(len(raw)), sizes[side])
            if (np.bincount(own, v.size[ids[side]], len(raw)).astype(np.int64) == length).all() and v.spells(ids[side], text):
                continue
            ends, at = np.cumsum(sizes[side]), np.cumsum(length)
            bad = np.array([not v.spells(ids[side][e - n : e], text[p - m : p]) for e, n, p, m in zip(ends.tolist(), sizes[side].tolist(), at.tolist(), length.tolist(), strict=True)])
            for s in range(2):
                ids[s] = ids[s][~np.repeat(bad, sizes[s])]
                sizes[s] = np.where(bad, 0, sizes[s])
            spaced = [b"" if x else t for x, t in zip(bad.tolist(), spaced, strict=True)]
            text, length = np.frombuffer(b"".join(spaced), np.uint8), np.where(bad, 0, length)
        return ids, sizes


_kept: dict = worker_cache("aligning")


def _pair(paths: tuple[str, str]) -> Pair:
    if paths not in _kept:
        _kept[paths] = Pair(*paths)
    return _kept[paths]


def _vocabularies(paths: tuple[str, str]) -> tuple[Vocabulary, Vocabulary]:
    key = ("words", *paths)
    if key not in _kept:
        _kept[key] = Pair.vocabularies(*paths)
    return _kept[key]


def _narrow(n: int) -> type:
    return np.uint16 if n <= 1 << 16 else np.uint32


def events(docs: DataFrame, paths: tuple[str, str] | None = None, window: int = WINDOW) -> DataFrame:
    """EVENTS: runs of end events of both sides; a document without tokens has one empty run."""
    paths = paths or tokenizer_paths()

    @frugal("aligning")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = _pair(paths)
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            for first, part in chunks(batch.column(1)):
                ids, sizes = pair.encode(part)
                rows = row + np.arange(len(part))
                doc_ids = batch.column(0).slice(first, len(part))
                row += len(part)
                for side in range(2):
                    yield _runs(rows, doc_ids, side, ids[side], sizes[side], pair.words[side], window)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(run, EVENTS)


def _runs(rows: np.ndarray, doc_ids: pa.Array, side: int, ids: np.ndarray, sizes: np.ndarray, v: Vocabulary, window: int) -> pa.RecordBatch:
    own = np.repeat(np.arange(len(rows)), sizes)
    length = v.size[ids]
    before = np.cumsum(length) - length
    first = np.cumsum(sizes) - sizes
    if len(ids):
        before -= np.repeat(before[np.minimum(first, len(ids) - 1)], sizes)
    new = np.ones(len(ids), bool)
    new[1:] = (own[1:] != own[:-1]) | (before[1:] // window != before[:-1] // window)
    begin = np.flatnonzero(new)
    of, at = own[begin], before[begin]
    if side == 0 and not sizes.all():  # documents without tokens
        none = np.flatnonzero(sizes == 0)
        begin, of, at = np.concatenate([begin, first[none]]), np.concatenate([of, none]), np.concatenate([at, np.zeros(len(none), np.int64)])
        order = np.argsort(of, kind="stable")
        begin, of, at = begin[order], of[order], at[order]
    kind = _narrow(len(v.size))
    offsets = np.append(begin, len(ids)) * np.dtype(kind).itemsize
    data = pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(ids.astype(kind).tobytes())])
    return pa.RecordBatch.from_arrays([pa.array(rows[of]), doc_ids.take(pa.array(of)), pa.array(at), pa.array(np.full(len(of), side, np.int32)), data], names=[x.split()[0] for x in EVENTS.split(", ")])


# the machine


class Digits:
    """Decimal digits of each id, from the left."""

    def __init__(self, n: int):
        texts = [str(i).encode() for i in range(n)]
        self.size = np.array([len(t) for t in texts], np.int64)
        self.width = int(self.size.max(initial=1))
        self.digits = np.frombuffer(b"".join(t.ljust(self.width) for t in texts), np.uint8).reshape(n, self.width)


class OpenDocument:
    """What the machine knows of a document that goes on: sums, hash, distinct pairs and the tokens since the last closed group."""

    def __init__(self, row: int, doc_id: int | None):
        self.row, self.doc_id = row, doc_id
        self.sums = np.zeros(4, np.int64)  # A tokens, B tokens, groups, links
        self.hash = hashlib.sha256()
        self.codes, self.times = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def add(self, codes: np.ndarray, times: np.ndarray) -> None:
        if len(self.codes):
            codes, inverse = np.unique(np.concatenate([self.codes, codes]), return_inverse=True)
            times = np.bincount(inverse, np.concatenate([self.times, times]), len(codes)).astype(np.int64)
        self.codes, self.times = codes, times

    def digest(self) -> str:
        return self.hash.hexdigest() if self.sums[2] else ""


class Machine:
    def __init__(self, words: tuple[Vocabulary, Vocabulary], listed: bool = False):
        self.words = words
        self.open: OpenDocument | None = None
        self.left = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * 2  # ids and ends since the open document's last closed group
        self.digits = Digits(max(len(w.size) for w in words))
        self.listed = listed
        self.groups: list[tuple] = []

    def step(self, row: np.ndarray, doc_id: list, at: np.ndarray, side: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> list[OpenDocument]:
        """Takes runs in order (row, at, side) and returns the documents that have ended; the last one stays open."""
        ended = [self.open] if self.open and row[0] != self.open.row else []
        if ended:
            self.open = None
        new = np.ones(len(row), bool)
        new[1:] = row[1:] != row[:-1]
        of = np.cumsum(new) - 1
        docs = [OpenDocument(int(row[i]), doc_id[i]) for i in np.flatnonzero(new).tolist()]
        if self.open:
            docs[0] = self.open
        begun = bool(self.open and self.open.sums[2])
        run = np.repeat(np.arange(len(row)), sizes)
        on_a = side[run] == 0
        tokens, ends, keys = [], [], []
        for s, mine in enumerate((on_a, ~on_a)):
            i, r = ids[mine], run[mine]
            length = self.words[s].size[i]
            total = np.cumsum(length)
            first = np.searchsorted(r, np.arange(len(row)))  # base of each run
            base = np.concatenate([[0], total])[first]
            e = total - base[r] + at[r]
            d = of[r]
            if len(self.left[s][0]):
                i, e, d = np.concatenate([self.left[s][0], i]), np.concatenate([self.left[s][1], e]), np.concatenate([np.zeros(len(self.left[s][0]), np.int64), d])
            tokens.append(i)
            ends.append(e)
            keys.append(d << 44 | e)
        ka, kb = keys
        to = np.searchsorted(kb, ka)
        hit = np.zeros(len(ka), bool)
        inside = to < len(kb)
        hit[inside] = kb[to[inside]] == ka[inside]
        last_a, last_b = np.flatnonzero(hit), to[hit]
        n = len(last_a)
        self._close(docs, begun, tokens, ends, keys, last_a, last_b)
        done = (int(last_a[-1]) + 1, int(last_b[-1]) + 1) if n else (0, 0)
        self.left = [(tokens[s][done[s] :].astype(np.int64), ends[s][done[s] :]) for s in range(2)]
        self.open = docs[-1]
        return ended + docs[:-1]

    def _close(self, docs: list[OpenDocument], begun: bool, tokens: list[np.ndarray], ends: list[np.ndarray], keys: list[np.ndarray], last_a: np.ndarray, last_b: np.ndarray) -> None:
        """Groups end with the tokens last_a and last_b."""
        if not len(last_a):
            return
        first_a, first_b = np.concatenate([[0], last_a[:-1] + 1]), np.concatenate([[0], last_b[:-1] + 1])
        n_a, n_b = last_a - first_a + 1, last_b - first_b + 1
        owner = keys[0][last_a] >> 44
        links = n_a * n_b
        per = np.stack([np.bincount(owner, w, len(docs)).astype(np.int64) for w in (n_a, n_b, np.ones(len(owner)), links)], axis=1)
        a, b = tokens[0][: last_a[-1] + 1].astype(np.uint64), tokens[1][: last_b[-1] + 1].astype(np.uint64)
        self._write(docs, begun, a, b, first_b, last_a, n_a, n_b, owner)
        for d, s in zip(docs, per, strict=True):
            d.sums += s
        if self.listed:
            starts = ends[0][first_a] - self.words[0].size[tokens[0][first_a]]
            for g in range(len(last_a)):
                d = docs[owner[g]]
                self.groups.append((d.row, d.doc_id, int(starts[g]), int(ends[0][last_a[g]]), a[first_a[g] : last_a[g] + 1].tolist(), b[first_b[g] : last_b[g] + 1].tolist()))
        # distinct pairs of each document
        owner_bits = owner.astype(np.uint64)
        bulky = np.flatnonzero(links > LISTED)
        flat = np.where(links > LISTED, 0, links)
        found = []
        heads = np.searchsorted(np.cumsum(flat), np.arange(0, max(1, int(flat.sum())), 4 * STEP))
        for lo, hi in zip(heads, [*heads[1:], len(flat)], strict=True):
            m = flat[lo:hi]
            g = np.repeat(np.arange(lo, hi), m)
            local = np.arange(len(g)) - np.repeat(np.cumsum(m) - m, m)
            code = a[first_a[g] + local // n_b[g]] << np.uint64(32) | b[first_b[g] + local % n_b[g]]
            found.append(self._distinct(owner_bits[g], code))
        for g in bulky.tolist():
            ua, ca = np.unique(a[first_a[g] : last_a[g] + 1], return_counts=True)
            ub, cb = np.unique(b[first_b[g] : last_b[g] + 1], return_counts=True)
            code = (ua[:, None] << np.uint64(32) | ub[None, :]).ravel()
            found.append((np.full(len(code), owner[g]), code, (ca[:, None] * cb[None, :]).ravel()))
        for own, code, times in found:
            at = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(own) else []
            for i, j in zip(at, [*at[1:], len(own)], strict=True):
                docs[int(own[i])].add(code[i:j], times[i:j])

    @staticmethod
    def _distinct(owner: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(owner, code, times), by owner and code. Small ids and few owners share one number, which sorts fast."""
        a, b = code >> np.uint64(32), code & np.uint64(0xFFFFFFFF)
        if len(code) and int(a.max()) < 1 << 20 and int(b.max()) < 1 << 20:
            first = int(owner[0])
            both = (owner - np.uint64(first)) << np.uint64(40) | a << np.uint64(20) | b
            both.sort()
            new = np.concatenate([[True], both[1:] != both[:-1]])
            both, at = both[new], np.flatnonzero(new)
            low = np.uint64((1 << 20) - 1)
            return (both >> np.uint64(40)).astype(np.int64) + first, ((both >> np.uint64(20)) & low) << np.uint64(32) | both & low, np.diff(np.append(at, len(code)))
        order = np.lexsort((code, owner))
        owner, code = owner[order].astype(np.int64), code[order]
        at = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (code[1:] != code[:-1])])) if len(code) else np.zeros(0, np.int64)
        return owner[at], code[at], np.diff(np.append(at, len(code)))

    def _write(self, docs: list[OpenDocument], begun: bool, a: np.ndarray, b: np.ndarray, first_b: np.ndarray, last_a: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, owner: np.ndarray) -> None:
        """Adds the groups' text to the documents' hashes: each token after its mark, which a document's first token lacks."""
        groups = np.arange(len(n_a))
        at_a = np.arange(len(a)) + np.repeat(first_b, n_a)
        at_b = np.arange(len(b)) + np.repeat(last_a + 1, n_b)
        ids = np.empty(len(a) + len(b), np.int64)
        ids[at_a], ids[at_b] = a, b
        mark = np.full(len(ids), ord(","), np.uint8)
        head_a = at_a[np.cumsum(n_a) - n_a]
        mark[head_a] = ord(";")
        mark[at_b[np.cumsum(n_b) - n_b]] = ord("|")
        size = self.digits.size[ids] + 1
        end = np.cumsum(size)
        start = end - size
        out = np.empty(int(end[-1]), np.uint8)
        out[start] = mark
        for k in range(self.digits.width):
            long = size > k + 1
            out[start[long] + (k + 1)] = self.digits.digits[ids[long], k]
        heads = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        begins = start[head_a[heads]].tolist()
        view = memoryview(out)
        for g, lo, hi in zip(heads.tolist(), begins, [*begins[1:], len(out)], strict=True):
            d = int(owner[groups[g]])
            docs[d].hash.update(view[lo if begun and d == 0 else lo + 1 : hi])


def _steps(batches: Iterator[pa.RecordBatch], kinds: tuple[type, type], step: int) -> Iterator[tuple]:
    """Runs of about `step` events, as arrays. A batch's runs of both sides are told apart by `side`."""
    for batch in batches:
        row, at, side = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 2, 3))
        doc_id, data = batch.column(1), as_binary(batch.column(4))
        off = np.frombuffer(data.buffers()[1], np.int64, len(data) + 1, data.offset * 8)
        raw = np.frombuffer(data.buffers()[2], np.uint8) if data.buffers()[2] is not None else np.zeros(0, np.uint8)
        item = np.where(side == 0, np.dtype(kinds[0]).itemsize, np.dtype(kinds[1]).itemsize)
        n = np.diff(off) // item
        done, total = 0, np.cumsum(n)
        while done < len(row):
            j = max(done + 1, int(np.searchsorted(total, (total[done - 1] if done else 0) + step, "right")))
            if kinds[0] == kinds[1]:
                ids = raw[off[done] : off[j]].view(kinds[0]).astype(np.int64)
            else:
                ids = np.concatenate([raw[off[k] : off[k + 1]].view(kinds[int(side[k])]).astype(np.int64) for k in range(done, j)])
            yield row[done:j], doc_id.slice(done, j - done).to_pylist(), at[done:j], side[done:j], ids, n[done:j]
            done = j


def sorted_events(docs: DataFrame, paths: tuple[str, str], window: int) -> DataFrame:
    return events(docs, paths, window).repartition("row").sortWithinPartitions("row", "at", "side")


def _block(number: int, docs: list[OpenDocument]) -> pa.RecordBatch:
    codes, inverse = np.unique(np.concatenate([d.codes for d in docs]), return_inverse=True)
    sums = np.stack([np.append(d.sums, len(d.codes)) for d in docs])
    columns = [[number], [[d.doc_id for d in docs]], [sums.astype("<i8").tobytes()], [[d.digest() for d in docs]], [_two(codes)], [squeeze(np.bincount(inverse, minlength=len(codes)))], [squeeze(inverse)], [squeeze(np.concatenate([d.times for d in docs]))]]
    types = [pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.list_(pa.string()), *[pa.binary()] * 4]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[x.split()[0] for x in BLOCKS.split(", ")])


def _two(codes: np.ndarray) -> bytes:
    a, b = squeeze((codes >> np.uint64(32)).astype(np.int64)), squeeze((codes & np.uint64(0xFFFFFFFF)).astype(np.int64))
    return len(a).to_bytes(8, "little") + a + b


def _codes(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    return unsqueeze(data[8 : 8 + n]) << 32 | unsqueeze(data[8 + n :])


def blocks_of(docs: DataFrame, paths: tuple[str, str], window: int = WINDOW, step: int = STEP) -> DataFrame:
    """BLOCKS: finished documents with their sums, hashes and distinct pairs."""

    @frugal("aligning")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _vocabularies(paths)
        machine, number = Machine(words), TaskContext.get().partitionId() << 33
        for runs in _steps(batches, tuple(_narrow(len(w.size)) for w in words), step):
            if ended := machine.step(*runs):
                yield _block(number, ended)
                number += 1
        if machine.open:
            yield _block(number, [machine.open])

    return sorted_events(docs, paths, window).mapInArrow(run, BLOCKS)


def groups(docs: DataFrame, paths: tuple[str, str] | None = None, window: int = WINDOW, step: int = STEP) -> DataFrame:
    """GROUPS: the groups themselves. row tells documents apart, start and stop are byte offsets in a space and the text, a and b ids."""
    paths = paths or tokenizer_paths()

    @frugal("aligning")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _vocabularies(paths)
        machine = Machine(words, listed=True)
        types = [pa.int64()] * 4 + [pa.list_(pa.int32())] * 2
        for runs in _steps(batches, tuple(_narrow(len(w.size)) for w in words), step):
            machine.step(*runs)
            columns = list(zip(*machine.groups, strict=True)) or [()] * 6
            machine.groups = []
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[x.split()[0] for x in GROUPS.split(", ")])

    return sorted_events(docs, paths, window).mapInArrow(run, GROUPS)


# counts


def _pairs(blocks: DataFrame) -> DataFrame:
    """block, place, code, holders: a row for each distinct pair of a block and the number of its documents that hold it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, codes, holders in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                c = _codes(codes)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(c), block)), pa.array(np.arange(len(c), dtype=np.int32)), pa.array(c), pa.array(unsqueeze(holders)[: len(c)])], names=["block", "place", "code", "holders"])

    return blocks.select("block", "codes", "holders").mapInArrow(run, "block long, place int, code long, holders long")


def pair_counts(pairs: DataFrame) -> DataFrame:
    """code (A id << 32 | B id), n documents, n_blocks, best (whether n is its A id's highest)."""
    counted = pairs.groupBy("code").agg(F.sum("holders").alias("n"), F.count(F.lit(1)).alias("n_blocks"))
    return counted.withColumn("best", F.col("n") == F.max("n").over(Window.partitionBy(F.shiftright("code", 32))))


def aligned(docs: DataFrame, paths: tuple[str, str] | None = None, window: int = WINDOW, step: int = STEP) -> DataFrame:
    """ALIGNED: one row per document."""
    paths = paths or tokenizer_paths()
    blocks, blocks_at = stored(blocks_of(docs, paths, window, step))
    pairs = _pairs(blocks)
    about, about_at = stored(pair_counts(pairs))
    told = spread_join(pairs.select("block", "place", "code"), about, "code", "n_blocks").select("block", "place", "n", "best")

    def answer(key: tuple, block: pa.Table, told: pa.Table) -> pa.Table:
        out = []
        for b in block.to_pylist():
            sums = np.frombuffer(b["sums"], "<i8").reshape(-1, 5)
            place = told["place"].to_numpy()
            n, best = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
            n[place], best[place] = told["n"].to_numpy(), told["best"].to_numpy().astype(np.int64)
            entries, times = unsqueeze(b["entries"]), unsqueeze(b["times"])
            total = int(sums[:, 4].sum())
            entries, times = entries[:total], times[:total]
            ends = np.cumsum(sums[:, 4])
            add = [np.concatenate([[0], np.cumsum(times * x[entries])]) for x in (best, n)]
            columns = [pa.array(b["doc_id"], pa.int64()), *[pa.array(sums[:, i]) for i in range(4)], *[pa.array(x[ends] - x[ends - sums[:, 4]]) for x in add], pa.array(b["digests"], pa.string())]
            out.append(pa.table(columns, names=[x.split()[0] for x in ALIGNED.split(", ")]))
        return pa.concat_tables(out)

    out, _ = stored(blocks.select("block", "doc_id", "sums", "digests", "entries", "times").groupBy("block").cogroup(told.groupBy("block")).applyInArrow(answer, ALIGNED))
    remove(docs.sparkSession, blocks_at, about_at)
    return out


def link_table(docs: DataFrame, paths: tuple[str, str] | None = None) -> DataFrame:
    """a_id, b_id, n documents that hold them linked, best."""
    about = pair_counts(_pairs(stored(blocks_of(docs, paths or tokenizer_paths()))[0]))
    return about.select(F.shiftright("code", 32).cast("int").alias("a_id"), F.col("code").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int").alias("b_id"), "n", "best")
