"""Katz backoff language model of order 3 with Good-Turing discounts, over whole texts.

Tokens are white-space words (A-Z lower-cased) and one END a text; BEGIN, BEGIN stands before each text and is a history only. The model,
from training texts alone, with no n-gram left out:

    P(w)       = d1(c) * c / N                   words of the training texts; d discounts counts up to K by Good-Turing
    P(other)   = the mass so freed               one slot for all unknown words
    P(w | v)   = d2(c) * c(v, w) / c(v)          if (v, w) occurs,  else a(v) * P(w)
    P(w | u v) = d3(c) * c(u, v, w) / c(u, v)    if (u, v, w) occurs, else a(u, v) * P(w | v)

a(.) is what the discounts leave over the mass that the shorter history gives to the words not seen, so every history adds up to one exactly. A history
whose words all occur more than K times has nothing discounted: its counts are scaled by c / (c + 1). An unknown history passes to the shorter one.

Plan. Texts are cut into blocks, which are tokenised once and written. Every level (words, pairs, triples) is one exchange: a block asks for its
*distinct* n-grams, with its own training counts, by bucket; a bucket adds up what all blocks saw (that is the table of n-grams, partitioned) and
answers in the order asked. Answers are written and meet the block again by its number, where each token is evaluated recursively. Words become numbers at
the first level. Buckets follow the number of tokens, so none grows with the input. The n-grams of a history go to one bucket, which so knows what a(.) needs; a history
with more than a quarter of a bucket's tokens is split by the next word, and its sums (at most 1 / HOT histories a level, whatever the input) are the
only thing that reaches the driver besides totals. A text longer than a block becomes several pieces, which know the two words before them.

Tables are written to the shared folder; all are removed when the scores, a few numbers a document, are written. What a lost executor held is read or computed again.

Words are told apart by 64-bit hashes, and histories of two words inside a bucket by hashes of their numbers.

Defined results: null and empty texts consist of END; repeated rows are scored (and, in training, counted) each; null ids count as the empty text in the
fold; without training texts every probability is 1; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import fold, remove, stored, trim
from graphloom.llm.textbatch import IS_SPACE, TextBatch, as_binary, chunks, mix, slices

U = np.uint64
K = 5
ORDER = 3
BLOCK_BYTES = 1 << 21
BUCKET_TOKENS = 1 << 19
#: Least share of the training tokens of a history that is split: the bound of what reaches the driver.
HOT = 1e-6
END = U(1)
BEGIN = 0  # number of what stands before a text; words have numbers from 1
GOLD = U(0x9E3779B97F4A7C15)

BLOCKS = "block long, level int, bucket long, data array<binary>"
ANSWERS = BLOCKS + ", u long, v long, sums array<long>, seen double"
_ANSWER = pa.schema([("block", pa.int64()), ("level", pa.int32()), ("bucket", pa.int64()), ("data", pa.list_(pa.binary())), ("u", pa.int64()), ("v", pa.int64()), ("sums", pa.list_(pa.int64())), ("seen", pa.float64())])
SCORES = "piece long, doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"

_codec = pa.Codec("zstd", compression_level=1)


def squeeze(a: np.ndarray) -> bytes:
    """Unsigned numbers as planes of bytes, as many as the largest needs; compressed if there are many."""
    width = max(1, (int(a.max()).bit_length() + 7) // 8) if len(a) else 1
    raw = a.astype(np.uint8).tobytes() if width == 1 else b"".join([(a >> k).astype(np.uint8).tobytes() for k in range(0, 8 * width, 8)])
    return bytes([width]) + raw if len(raw) < 192 else bytes([width | 128]) + len(raw).to_bytes(8, "little") + _codec.compress(raw, asbytes=True)


def unsqueeze(data: bytes) -> np.ndarray:
    width = data[0] & 127
    raw = np.frombuffer(_codec.decompress(data[9:], int.from_bytes(data[1:9], "little")) if data[0] & 128 else data, np.uint8)
    raw = raw if data[0] & 128 else raw[1:]
    out = np.zeros((len(raw) // width, 8), np.uint8)
    out[:, :width] = raw.reshape(width, -1).T
    return out.reshape(-1).view("<i8")


# the model's formulas


def discounts(n: list[int]) -> np.ndarray:
    """d[0..K] from counts of counts n[1..K+1] (n[0] unused); d[0] = 0. Where Good-Turing gives no proper discounts, half a count is taken off."""
    d = np.zeros(K + 1)
    if all(n[1 : K + 2]):
        a = (K + 1) * n[K + 1] / n[1]
        if a != 1:
            r = np.arange(1, K + 1)
            d[1:] = ((r + 1) * np.array(n[2 : K + 2]) / (r * np.array(n[1 : K + 1])) - a) / (1 - a)
    if not ((d[1:] > 0) & (d[1:] < 1)).all():
        d[1:] = 1 - 0.5 / np.arange(1, K + 1)
    return d


def discounted(c: np.ndarray, d: np.ndarray) -> np.ndarray:
    """d(c) * c."""
    return np.where(c <= K, d[np.minimum(c, K).astype(np.int64)], 1.0) * c


class Unigrams:
    def __init__(self, n_tokens: int, n_types: int, n: list[int]):
        self.N, self.V, self.d = n_tokens, n_types, discounts(n)
        freed = sum((1 - self.d[r]) * r * n[r] for r in range(1, K + 1)) / n_tokens if n_tokens else 1.0
        self.other = max(freed, 1 / (n_tokens + 1))
        self.scale = (1 - self.other) / (1 - freed) if freed < 1 else 0.0

    def p(self, c: np.ndarray) -> np.ndarray:
        return np.where(c > 0, self.scale * discounted(c.astype(float), self.d) / max(self.N, 1), self.other)

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 0.1) / (self.N + 0.1 * (self.V + 1)))


def scaled(size: np.ndarray, bare: np.ndarray) -> np.ndarray:
    """The factor of a history's counts."""
    return np.where(bare, size / (size + 1.0), 1.0)


def backoff(size: np.ndarray, bare: np.ndarray, types: np.ndarray, seen: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Weights of histories that occur `size` times: types[r - 1] of their words occur r times, and `seen` is what the shorter history gives to all their words."""
    off = ((1 - d[1:]) * np.arange(1, K + 1)) @ types
    left = np.where(bare, 1 / (size + 1.0), off / np.maximum(size, 1))
    return np.where(size > 0, left / np.maximum(1 - seen, 1e-15), 1.0)


# blocks


def pieces(array: pa.Array, limit: int) -> Iterator[tuple[pa.Array, np.ndarray, int, bool, bool]]:
    """(texts, their rows, words at the start that only stand before, whether the rows end here, whether they are whole): runs of whole rows, and a longer row in pieces."""
    array = as_binary(array)
    for row, part in chunks(array, limit):
        text = part[0].as_py() if len(part) == 1 else b""
        if len(text) <= limit:
            yield part, np.arange(row, row + len(part)), 0, True, True
            continue
        space = np.flatnonzero(IS_SPACE[np.frombuffer(text, np.uint8)])
        lead, left = [], len(text)
        for piece in slices(text, limit, space):
            left -= len(piece)
            yield pa.array([b" ".join([*lead, piece])], pa.large_binary()), np.array([row]), len(lead), not left, False
            last = piece.rsplit(None, 2)  # bytes part at the same white space as words
            lead = [*lead, *last[len(last) == 3 :]][-2:]


def blocks_of(docs: DataFrame, block_bytes: int) -> DataFrame:
    """One row of level 0 a block: rows' ids, which are null, pieces' rows (of texts in pieces, else none), sizes, words before, training; then each token's word, by place among
    the block's words, the most frequent first; then those words' hashes and training counts. Blocks are numbered by partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n_blocks, n_rows = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            for texts, row, lead_, ends, whole in pieces(batch.column(2), block_bytes):
                b = TextBatch(texts, lower=True)
                start, end = b.words()
                own = b.owner(start)
                size = np.bincount(own, minlength=b.n)
                word = b.hashes(start, end)
                if ends:
                    word = np.insert(word, np.cumsum(size), END)
                    size += 1
                lead = np.full(b.n, lead_)
                train = np.asarray(batch.column(1).take(pa.array(row)))
                words, place, count = np.unique(word, return_inverse=True, return_counts=True)
                order = np.argsort(-count, kind="stable")
                rank = np.empty(len(order), np.int64)
                rank[order] = np.arange(len(order))
                seq, learnt = rank[place], real(size, lead) & np.repeat(train, size)
                piece = np.zeros(0, np.int64) if whole else np.array([task << 40 | n_rows + row[0]])
                ids = batch.column(0).take(pa.array(row))
                data = [np.asarray(ids.fill_null(0)).astype(np.int64).tobytes(), squeeze(np.asarray(ids.is_null())), squeeze(piece), squeeze(size), squeeze(lead), squeeze(train), squeeze(seq)]
                data += [words[order].tobytes(), squeeze(np.bincount(seq, learnt, len(words)).astype(np.int64))]
                yield pa.RecordBatch.from_pylist([{"block": task << 32 | n_blocks, "level": 0, "bucket": 0, "data": data, "n": len(seq), "begins": int(train.sum()) if ends else 0, "pieces": len(piece)}], pa.schema([*list(_ANSWER)[:4], ("n", pa.int64()), ("begins", pa.int64()), ("pieces", pa.int64())]))
                n_blocks += 1
            n_rows += len(batch)

    rows = docs.select("doc_id", (fold("doc_id", 10) != 0).alias("train"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, BLOCKS + ", n long, begins long, pieces long")


def real(size: np.ndarray, lead: np.ndarray) -> np.ndarray:
    """True for tokens that count, not those that only stand before a piece."""
    out = np.ones(int(size.sum()), bool)
    first = np.cumsum(size) - size
    for i in np.flatnonzero(lead).tolist():
        out[first[i] : first[i] + lead[i]] = False
    return out


def _by_bucket(bucket: np.ndarray) -> Iterator[tuple[int, slice]]:
    edge = np.flatnonzero(np.diff(bucket)) + 1
    for a, z in zip(np.concatenate([[0], edge]).tolist(), np.append(edge, len(bucket)).tolist()):
        if z > a:
            yield int(bucket[a]), slice(a, z)


def _told(block, level: int, bucket: int, data: list[bytes]) -> dict:
    return {"block": block, "level": level, "bucket": bucket, "data": data}


def _asks(rows: list[tuple[int, int, list[bytes]]]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * 3
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.list_(pa.binary())), strict=True)], names=["bucket", "block", "data"])


ASKS = "bucket long, block long, data array<binary>"


def word_buckets(words: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(order by bucket, buckets in that order)."""
    b = (mix(words) % U(buckets)).astype(np.int64)
    order = np.argsort(b, kind="stable")
    return order, b[order]


def number_words(blocks: DataFrame, buckets: int) -> DataFrame:
    """Answers of level 1: the number and count of each word asked; totals without a block (types by count to K + 1, types, tokens)."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words, count = np.frombuffer(data[7], np.uint64), unsqueeze(data[8])
                order, b = word_buckets(words, buckets)
                yield _asks([(k, block, [words[order[s]].tobytes(), squeeze(count[order[s]])]) for k, s in _by_bucket(b)])

    def answer(key: tuple, t: pa.Table) -> pa.Table:
        bucket, data = key[0].as_py(), t["data"].to_pylist()
        lists = [np.frombuffer(x[0], np.uint64) for x in data]
        u, of = np.unique(np.concatenate(lists), return_inverse=True)
        c = np.bincount(of, np.concatenate([unsqueeze(x[1]) for x in data])).astype(np.int64)
        number = np.empty(len(u), np.int64)
        number[np.argsort(-c, kind="stable")] = 1 + np.arange(len(u)) * buckets + bucket
        out, at = [], 0
        for block, w in zip(t["block"].to_pylist(), lists, strict=True):
            i = of[at : at + len(w)]
            at += len(w)
            out.append(_told(block, 1, bucket, [squeeze(number[i]), squeeze(c[i])]))
        out.append({"level": 1, "bucket": bucket, "sums": [*np.bincount(c[c <= K + 1], minlength=K + 2).tolist(), int((c > 0).sum()), int(c.sum())]})
        return pa.Table.from_pylist(out, _ANSWER)

    return blocks.select("block", "data").mapInArrow(ask, ASKS).groupBy("bucket").applyInArrow(answer, ANSWERS)


def encoded(blocks: DataFrame, told: DataFrame, buckets: int) -> DataFrame:
    """Blocks with their words' numbers and counts in place of hashes."""

    def run(key: tuple, t: pa.Table) -> pa.Table:
        rows = sorted(t.select(["level", "bucket", "data"]).to_pylist(), key=lambda r: (r["level"], r["bucket"]))
        *own, words, _ = rows[0]["data"]
        order, _ = word_buckets(np.frombuffer(words, np.uint64), buckets)
        out = []
        for k in (0, 1):
            x = np.zeros(len(order), np.int64)
            x[order] = np.concatenate([np.zeros(0, np.int64), *[unsqueeze(r["data"][k]) for r in rows[1:]]])
            out.append(squeeze(x))
        return pa.Table.from_pylist([_told(key[0].as_py(), 0, 0, [*own, *out])], pa.schema(list(_ANSWER)[:4]))

    return blocks.select("block", "level", "bucket", "data").unionByName(told.where("block IS NOT NULL").select("block", "level", "bucket", "data")).groupBy("block").applyInArrow(run, BLOCKS)


# n-grams of a block


def distinct(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct values in order, a place of each, and of each place its value's."""
    values, of = np.unique(key, return_inverse=True)
    at = np.empty(len(values), np.int64)
    at[of] = np.arange(len(key))
    return values, at, of


class Deal:
    """Where n-grams go: a history of `most` tokens or more is split into parts of `part` tokens."""

    def __init__(self, n_tokens: int, begins: int, bucket_tokens: int, hot: float):
        self.begins, self.part = begins, max(1, bucket_tokens // 4)
        self.buckets = max(1, -(-n_tokens // bucket_tokens))
        self.most = max(self.part, hot * n_tokens)

    def spread(self, size: np.ndarray, by: np.ndarray) -> np.ndarray:
        """A number below the parts of a split history, 0 for others."""
        parts = np.where(size >= self.most, -(-size // self.part), 1).astype(np.uint64)
        return mix(by.astype(np.uint64) + U(77)) % parts


class Grams:
    """Distinct n-grams of one level (of level 3 given in order of history), in the order asked: by bucket, then history. A history is asked for once a bucket."""

    def __init__(self, level: int, deal: Deal, history: np.ndarray, u: np.ndarray, v: np.ndarray, w: np.ndarray, size: np.ndarray, v_size: np.ndarray, v_bare: np.ndarray, low: np.ndarray, count: np.ndarray):
        home = mix(v.astype(np.uint64) + U(level))
        if level == 3:
            home = home + deal.spread(v_size, u)
        bucket = ((home + deal.spread(size, w)) % U(deal.buckets)).astype(np.int64)
        order = np.argsort(bucket * (int(history.max(initial=0)) + 1) + history, kind="stable") if level == 2 else np.argsort(bucket.astype(np.uint16) if deal.buckets < 1 << 16 else bucket, kind="stable")
        self.level, self.order, self.bucket = level, order, bucket[order]
        history = history[order]
        new = np.concatenate([[True], (np.diff(history) != 0) | (np.diff(self.bucket) != 0)])[: len(order)]
        self.first = np.flatnonzero(new)
        self.group = np.cumsum(new) - 1  # of each n-gram
        at = order[self.first]
        self.u, self.v, self.size, self.v_size, self.v_bare = u[at], v[at], size[at], v_size[at], v_bare[at]
        self.split = self.size >= deal.most
        self.w, self.low, self.count = w, low, count

    def asks(self, block: int) -> pa.RecordBatch:
        out = []
        many = np.diff(np.append(self.first, len(self.order)))
        for k, s in _by_bucket(self.bucket):
            i = self.order[s]
            g = slice(self.group[s.start], self.group[s.stop - 1] + 1)
            data = [many[g], self.split[g], self.w[i], self.low[i], self.count[i]]
            if self.level == 3:  # histories (u, v) of one v stand together
                v = self.v[g]
                start = np.flatnonzero(np.concatenate([[True], np.diff(v) != 0]))
                data += [v[start], np.diff(np.append(start, len(v))), self.v_size[g][start], self.v_bare[g][start], self.u[g]]
            else:
                data.append(self.v[g])
            out.append((k, block, [squeeze(x) for x in data]))
        return _asks(out)

    def read(self, rows: list[dict], deal: Deal, told: Sums, d: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of each n-gram, in its own order: count, whether the history is bare, size of the history, backoff weight (where the count is 0)."""
        data = [r["data"] for r in sorted(rows, key=lambda r: r["bucket"]) if r["level"] == self.level]
        nothing = np.zeros(0, np.int64)
        c = np.concatenate([nothing, *[unsqueeze(x[0]) for x in data]])
        bare = np.concatenate([nothing, *[unsqueeze(x[1]) for x in data]]) > 0
        if len(c) != len(self.order) or len(bare) != len(self.first):
            raise ValueError("an answer is missing")
        asked = np.flatnonzero(np.bincount(self.group, c == 0, len(self.first)) > 0)
        types, seen = np.zeros((K, len(self.first))), np.zeros(len(self.first))
        types[:, asked] = np.concatenate([np.zeros((K, 0)), *[unsqueeze(x[2]).reshape(K, -1) for x in data]], 1)
        seen[asked] = np.concatenate([nothing.astype(float), *[np.frombuffer(x[3]) for x in data]])
        if self.split.any():
            s = told.find(self.u[self.split], self.v[self.split])
            types[:, self.split], seen[self.split] = told.types[:, s], told.seen[s]
            bare[self.split] = told.types[:, s].sum(0) == 0
        weight = backoff(self.size, bare, types, seen, d)
        out = []
        for x in (c, bare[self.group], self.size[self.group], weight[self.group]):
            y = np.empty(len(x), x.dtype)
            y[self.order] = x
            out.append(y)
        return tuple(out)


class Sums:
    """What is summed up over the parts of split histories."""

    def __init__(self, u: np.ndarray, v: np.ndarray, types: np.ndarray, seen: np.ndarray):
        key = two(u, v)
        order = np.argsort(key)
        self.key, self.types, self.seen = key[order], types[:, order], seen[order]

    def find(self, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.key, two(u, v))
        if len(at) and (at.max() >= len(self.key) or (self.key[at] != two(u, v)).any()):
            raise ValueError("a history is missing")
        return at


def two(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    return mix(mix(u.astype(np.uint64) + U(1)) * GOLD + v.astype(np.uint64))


class Block:
    """An encoded block: its tokens with the distinct pairs and triples they end."""

    def __init__(self, data: list[bytes], deal: Deal):
        ids, null, piece, size, lead, train, seq, number, count = data
        self.ids, self.null = np.frombuffer(ids, np.int64), unsqueeze(null) > 0
        self.size, self.lead, self.train, self.seq, self.number, self.count = map(unsqueeze, (size, lead, train, seq, number, count))
        self.piece, self.deal = unsqueeze(piece), deal
        self.n = len(self.ids)
        self.doc = np.repeat(np.arange(self.n), self.size)
        self.real = real(self.size, self.lead)
        self.learnt = self.real & (self.train[self.doc] > 0)
        self.first = (np.cumsum(self.size) - self.size)[self.size > 0]

    def _before(self, x: np.ndarray) -> np.ndarray:
        out = np.concatenate([[-1], x[:-1]])[: len(x)]
        out[self.first] = -1
        return out

    def pairs(self) -> Grams:
        n = len(self.number)
        # in order of the second word, so that as histories the pairs of one last word stand together
        key, self.pair = np.unique(self.seq * (n + 1) + self._before(self.seq) + 1, return_inverse=True)
        w, h = key // (n + 1), key % (n + 1) - 1
        self.pair_w, v = self.number[w], np.where(h < 0, BEGIN, self.number[h])
        self.pair_v, self.w_size = v, self.count[w]
        size = np.where(h < 0, self.deal.begins, self.count[h])
        none = np.zeros(len(key), np.int64)
        return Grams(2, self.deal, h + 1, none, v, self.pair_w, size, none, none, self.w_size, np.bincount(self.pair, self.learnt, len(key)).astype(np.int64))

    def triples(self, c: np.ndarray, bare: np.ndarray, size: np.ndarray) -> Grams:
        """c, bare, size: of the pairs, as answered."""
        n = len(self.number)
        key, at, self.triple = distinct((self._before(self.pair) + 1) * n + self.seq)
        h, w = key // n - 1, key % n
        self.low = low = self.pair[at]  # the pair that each triple ends with
        u = np.where(h < 0, BEGIN, self.pair_v[h])
        return Grams(3, self.deal, h + 1, u, self.pair_v[low], self.number[w], np.where(h < 0, self.deal.begins, c[h]), size[low], bare[low], c[low], np.bincount(self.triple, self.learnt, len(key)).astype(np.int64))

    def scores(self, rows: list[dict], m: Model) -> list[np.ndarray]:
        """Known tokens, base score and score of each row."""
        values = m.uni.p(self.count)
        p = np.log10(values)[self.seq]
        if self.deal.begins:
            two_ = self.pairs()
            c, bare, size, weight = two_.read(rows, self.deal, m.sums[2], m.d[2])
            # pairs' probabilities: their words' counts say what they back off to
            low = m.uni.p(self.w_size)
            second = np.where(c > 0, scaled(size, bare) * discounted(c, m.d[2]) / np.maximum(size, 1), weight * low)
            three = self.triples(c, bare, size)
            c, bare, size, weight = three.read(rows, self.deal, m.sums[3], m.d[3])
            third = np.where(c > 0, scaled(size, bare) * discounted(c, m.d[3]) / np.maximum(size, 1), weight * second[self.low])
            p = np.log10(third)[self.triple]
        doc, here = self.doc[self.real], self.seq[self.real]
        return [np.bincount(doc, self.count[here] > 0, self.n).astype(np.int64), np.bincount(doc, m.uni.base(self.count)[here], self.n), np.bincount(doc, p[self.real], self.n)]


class Model:
    """Words, discounts by level, and the sums of split histories by level: all that is broadcast."""

    def __init__(self, uni: Unigrams):
        self.uni, self.d, self.sums = uni, {1: uni.d}, {}

    def learn(self, level: int, told: DataFrame) -> None:
        row = told.where("block IS NULL AND u IS NULL").agg(*[F.sum(F.col("sums")[i]).alias(f"n{i}") for i in range(K + 2)]).first()
        self.d[level] = discounts([int(x or 0) for x in row])
        split = told.where("u IS NOT NULL").groupBy("u", "v").agg(F.sum("seen").alias("seen"), *[F.sum(F.col("sums")[i]).alias(f"n{i}") for i in range(K)]).toArrow()
        columns = {c: split[c].to_numpy() for c in split.column_names}
        self.sums[level] = Sums(columns["u"], columns["v"], np.stack([columns[f"n{i}"] for i in range(K)]).astype(float), columns["seen"].astype(float))


def count_grams(asks: DataFrame, level: int, model, buckets: int) -> DataFrame:
    """Answers of a level, totals, and the sums of split histories (u, v)."""

    def answer(key: tuple, t: pa.Table) -> pa.Table:
        bucket, m = key[0].as_py(), model.value
        blocks = t["block"].to_pylist()
        rows = [[unsqueeze(x) for x in data] for data in t["data"].to_pylist()]
        many, split, w, low, count = (np.concatenate([r[i] for r in rows]) for i in range(5))
        asked_, groups = [len(r[2]) for r in rows], [len(r[0]) for r in rows]
        of = np.repeat(np.arange(len(many)), many)
        if level == 3:
            heads, times, size, v_bare, u = (np.concatenate([r[i] for r in rows]) for i in range(5, 10))
            head = np.repeat(np.arange(len(heads)), times)
            v = heads[head]
            history = two(u, v)
        else:
            v = history = np.concatenate([r[5] for r in rows])
            u = np.zeros_like(v)
        del rows
        _, first, place = distinct(history)
        n = len(first)
        gram, at, back = distinct(place[of] << 40 | w)
        c = np.bincount(back, count).astype(np.int64)
        held = np.flatnonzero(c > 0)
        h, ch, at = gram[held] >> 40, c[held], at[held]
        if level == 3:
            i = head[of[at]]
            p = scaled(size[i], v_bare[i] > 0) * discounted(low[at], m.d[2]) / np.maximum(size[i], 1)
        else:
            p = m.uni.p(low[at])
        types = np.array([np.bincount(h[ch == r], minlength=n) for r in range(1, K + 1)])
        seen = np.bincount(h, p, n).astype(float)
        bare = (np.bincount(h, minlength=n) > 0) & (types.sum(0) == 0)
        out, a, g = [], 0, 0
        for block, n_asked, n_groups in zip(blocks, asked_, groups, strict=True):
            mine, own = c[back[a : a + n_asked]], place[g : g + n_groups]
            asked = own[np.bincount(of[a : a + n_asked] - g, mine == 0, len(own)) > 0]
            a, g = a + n_asked, g + n_groups
            out.append(_told(block, level, bucket, [squeeze(mine), squeeze(bare[own]), squeeze(types[:, asked].reshape(-1)), seen[asked].tobytes()]))
        out.append({"level": level, "bucket": bucket, "sums": np.bincount(c[c <= K + 1], minlength=K + 2).tolist()})
        for i in np.flatnonzero(split[first]).tolist():
            out.append({"level": level, "bucket": bucket, "u": int(u[first[i]]), "v": int(v[first[i]]), "sums": types[:, i].tolist(), "seen": float(seen[i])})
        trim()
        return pa.Table.from_pylist(out, _ANSWER)

    return asks.groupBy("bucket").applyInArrow(answer, ANSWERS)


def scores(docs: DataFrame, bucket_tokens: int = BUCKET_TOKENS, hot: float = HOT, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: one row per document. The other parameters only say how n-grams are dealt and texts are cut."""
    spark = docs.sparkSession
    blocks, blocks_at = stored(blocks_of(docs, block_bytes))
    total = blocks.agg(F.sum("n").alias("n"), F.sum("begins").alias("begins"), F.sum("pieces").alias("pieces")).first()
    deal = Deal(int(total["n"] or 0), int(total["begins"] or 0), bucket_tokens, hot)
    told, told_at = stored(number_words(blocks, deal.buckets))
    sums = told.where("block IS NULL").agg(*[F.sum(F.col("sums")[i]).alias(f"n{i}") for i in range(K + 4)]).first()
    *small, types, tokens = [int(x or 0) for x in sums]
    model = Model(Unigrams(tokens, types, small))
    texts, texts_at = stored(encoded(blocks, told, deal.buckets))
    remove(spark, blocks_at, told_at)
    parts, paths = [texts], [texts_at]

    def ask_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                yield Block(data, deal).pairs().asks(block)

    def ask_triples(key: tuple, t: pa.Table) -> pa.Table:
        rows = t.select(["level", "bucket", "data"]).to_pylist()
        b, m = Block(next(r["data"] for r in rows if r["level"] == 0), deal), shared.value
        c, bare, size, _ = b.pairs().read(rows, deal, m.sums[2], m.d[2])
        del rows
        trim()
        return pa.Table.from_batches([b.triples(c, bare, size).asks(key[0].as_py())])

    def together() -> DataFrame:
        out = parts[0].select("block", "level", "bucket", "data")
        for p in parts[1:]:
            out = out.unionByName(p.where("block IS NOT NULL").select(*out.columns))
        return out.groupBy("block")

    shared = spark.sparkContext.broadcast(model)
    if deal.begins:
        for level in (2, 3):
            asks = texts.select("block", "data").mapInArrow(ask_pairs, ASKS) if level == 2 else together().applyInArrow(ask_triples, ASKS)
            found, found_at = stored(count_grams(asks, level, shared, deal.buckets))
            paths.append(found_at)
            model.learn(level, found)
            shared = spark.sparkContext.broadcast(model)
            parts.append(found)

    def evaluate(key: tuple, t: pa.Table) -> pa.Table:
        rows, m = t.select(["level", "bucket", "data"]).to_pylist(), shared.value
        b = Block(next(r["data"] for r in rows if r["level"] == 0), deal)
        known, base, score = b.scores(rows, m)
        del rows
        trim()
        piece = pa.array(np.full(b.n, b.piece[0])) if len(b.piece) else pa.nulls(b.n, pa.int64())
        columns = [piece, pa.array(b.ids, mask=b.null), pa.array(b.train == 0), pa.array(b.size - b.lead), pa.array(known), pa.array(np.full(b.n, m.uni.N)), pa.array(base.astype(float)), pa.array(score.astype(float))]
        return pa.table(columns, names=[x.split()[0] for x in SCORES.split(", ")])

    out, _ = stored(together().applyInArrow(evaluate, SCORES))
    remove(spark, *paths)
    if total["pieces"]:
        whole = out.where("piece IS NOT NULL").groupBy("piece", "doc_id", "held_out", "train_tokens").agg(*[F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base_score", "score")])
        out = out.where("piece IS NULL").unionByName(whole)
    return out.drop("piece")
