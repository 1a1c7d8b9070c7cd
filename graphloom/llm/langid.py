"""Language identification by error-correcting output codes.

Every learnt language has a codeword of +1 and -1: all two-way splits of the languages while there are few, else random words
chosen for the largest least distance. One linear classifier a bit (logistic loss over hashed byte 1- to 3-grams of
the lower-cased letters) predicts the bit from whole texts. Decoding adds up, for each language, the loss of its codeword's bits at
the predicted margins, weighted by how well each bit did on training texts set aside, and takes the language with
the least; a text whose two best languages are closer than a margin learnt from the same texts is flagged as ambiguous.

Training uses about `per_language` texts of each language (those with the least hashes of their ids), fewer where that makes more than MAX_TEXTS of
all languages: documented bounds, outside the held-out fold. Long texts are read in runs. Defined results: null texts and texts without a letter are `und` with score 0; so is every text if nothing could be learnt; with
one language all others get it; a language is learnt from one text on; repeated rows have equal results; null languages teach nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import fold
from graphloom.llm.textbatch import CHUNK_BYTES, TextBatch, chunks

PER_LANGUAGE = 600
#: Texts of all languages together: bounds what reaches the driver.
MAX_TEXTS = 6000
SLOTS = 1 << 12
UNKNOWN = "und"
#: Bytes that part words: all ASCII but letters. Small letters stand for large ones.
_FOLDED = np.full(256, 32, np.uint8)
_FOLDED[97:123] = np.arange(97, 123)
_FOLDED[65:91] = np.arange(97, 123)
_FOLDED[128:] = np.arange(128, 256)
_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[[*range(65, 91), *range(97, 123)]] = True
_HIGH = np.arange(256) >= 128
_MIX = np.random.default_rng(5).integers(0, 2**31, (3, 256), dtype=np.int64)


def _grams(d: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray], ...]:
    """Slot of the 1-, 2- and 3-gram that begins at each byte, and whether it counts."""
    one = _MIX[0][d]
    two = one[1:] ^ _MIX[1][d[:-1]]
    three = two[1:] ^ _MIX[2][d[:-2]]
    keep = d != 32
    return (one % SLOTS, keep), (two % SLOTS, keep[1:] | keep[:-1]), (three % SLOTS, keep[1:-1])


def _long(d: np.ndarray, run: int) -> np.ndarray:
    """Grams of one text by slot, counted in runs."""
    total = np.zeros(SLOTS, np.int64)
    for at in range(0, len(d), run):
        for g, k in _grams(d[at : at + run + 2]):
            total += np.bincount(g[:run][k[:run]], minlength=SLOTS)
    return total


def counts(part: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(rows, SLOTS) square-rooted gram shares of length 1, and whether each text has a letter."""
    b = TextBatch(part)
    letters = b.count(_ASCII_LETTER) > 0
    for i in np.flatnonzero(~letters & (b.count(_HIGH) > 0)).tolist():
        letters[i] = any(c.isalpha() for c in b.data[b.begin[i] : b.end[i]].tobytes().decode())
    d = _FOLDED[b.data]
    out = np.zeros((b.n, SLOTS), np.float32)
    if b.n == 1 and len(d) > CHUNK_BYTES:
        out[0] = _long(d[:-1], CHUNK_BYTES)
    else:
        for n, (g, k) in enumerate(_grams(d)):
            for i in range(b.n):
                s = slice(int(b.begin[i]), max(int(b.begin[i]), int(b.end[i]) - n))
                out[i] += np.bincount(g[s][k[s]], minlength=SLOTS)
    np.sqrt(out, out=out)
    out /= np.maximum(np.sqrt((out * out).sum(1, keepdims=True)), 1e-9)
    return out, letters


def vectors(array: pa.Array, limit: int = 1 << 20) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, vectors, has a letter) of runs of rows, at most 1024 at once."""
    for row, part in chunks(array, limit):
        for i in range(0, len(part), 1024):
            yield row + i, *counts(part.slice(i, 1024))


def codewords(n: int, seed: int = 11) -> np.ndarray:
    """(n, bits) of +1 and -1."""
    if n <= 1:
        return np.ones((n, 1))
    if n <= 6:  # every split once: the first language is always +1
        return np.array([(1, *rest) for rest in product((1, -1), repeat=n - 1) if -1 in rest]).T
    rng = np.random.default_rng(seed)
    bits = int(np.ceil(10 * np.log2(n)))
    best, least = None, -1
    for _ in range(200):
        m = rng.choice((-1, 1), (n, bits))
        if (np.abs(m.sum(0)) == n).any():
            continue
        distance = ((bits - m @ m.T) // 2)[~np.eye(n, dtype=bool)].min()
        if distance > least:
            best, least = m, distance
    return best


def _loss(margin: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, -margin)


@dataclass
class Coded:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    bit_weight: np.ndarray
    ambiguous: float

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the language, its share of exp(-loss), and the gap to the next."""
        margin = x @ self.weights + self.bias
        loss = (_loss(margin[:, None, :] * self.code[None]) * self.bit_weight).sum(2)
        p = np.exp(loss.min(1, keepdims=True) - loss)
        p /= p.sum(1, keepdims=True)
        top = np.sort(p, axis=1)
        gap = top[:, -1] - top[:, -2] if p.shape[1] > 1 else np.ones(len(p))
        return p.argmax(1), top[:, -1], gap


def fit(x: np.ndarray, y: np.ndarray, languages: list[str], steps: int = 150, rate: float = 8.0, decay: float = 1e-5) -> Coded:
    """x: vectors; y: indexes of languages, ascending. Every fifth text of a language is set aside to weigh the bits."""
    code = codewords(len(languages)).astype(np.float32)
    aside = (np.arange(len(y)) - np.searchsorted(y, y)) % 5 == 4
    w, bias = np.zeros((x.shape[1], code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    xt, target = x[~aside], code[y[~aside]]
    share = np.bincount(y[~aside], minlength=len(languages)).astype(np.float32)
    weight = (1 / np.maximum(share, 1))[y[~aside]][:, None] / len(languages)
    for _ in range(steps):
        g = target * weight / (1 + np.exp(np.clip(target * (xt @ w + bias), -30, 30)))
        w += rate * (xt.T @ g - decay * w)
        bias += rate * 0.1 * g.sum(0)
    model = Coded(languages, code, w, bias, np.ones(code.shape[1]), 0.0)
    if aside.any():
        right = ((x[aside] @ w + bias) * code[y[aside]] > 0).mean(0)
        model.bit_weight = np.log((right + 0.01) / (1.01 - right)).clip(0.05)
        model.bit_weight /= model.bit_weight.mean()
        got, _, gap = model.decode(x[aside])
        wrong = np.sort(gap[got != y[aside]])
        model.ambiguous = float(wrong[int(0.9 * (len(wrong) - 1))]) if len(wrong) else 0.05
    return model


def train(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Coded | None:
    """Learns from a bounded sample of each language; only vectors reach the driver."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold("doc_id", 3) != 1)).select("doc_id", "lang", "text")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return None
    languages = sorted(sizes)
    per_language = min(per_language, max(1, MAX_TEXTS // len(languages)))
    # A share of the ids by hash that holds per_language of them on average; the limit below bounds what chance adds.
    ticket = F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1_000_000))
    share = F.lit(-1)
    for name in languages:
        share = F.when(F.col("lang") == name, F.lit(int(np.ceil(1_000_000 * min(1.0, per_language / sizes[name]))))).otherwise(share)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, x, letters in vectors(batch.column(1)):
                n = len(x)
                packed = [v.astype(np.float16).tobytes() for v in x]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, n), pa.array(packed, pa.binary()), pa.array(letters)], names=["lang", "x", "letters"])

    chosen = rows.where(ticket < share).select("lang", F.col("text").cast("binary").alias("text")).mapInArrow(run, "lang string, x binary, letters boolean")
    got = chosen.where("letters").limit(2 * per_language * len(languages)).select("lang", "x").toArrow()
    x = np.frombuffer(b"".join(got["x"].to_pylist()), np.float16).reshape(-1, SLOTS)
    y = np.array([languages.index(v) for v in got["lang"].to_pylist()], np.int64)
    order = np.lexsort((x[:, :64].astype(np.float32).sum(1), y))
    return fit(x[order].astype(np.float32), y[order], languages) if len(y) else None


def predict(docs: DataFrame, model: Coded | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score, ambiguous: one row per document, from its text alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, x, letters in vectors(batch.column(2)):
                n = len(x)
                names, score, near = [UNKNOWN] * n, np.zeros(n), np.zeros(n, bool)
                if model:
                    best, p, gap = model.decode(x)
                    names = [model.languages[b] if ok else UNKNOWN for b, ok in zip(best.tolist(), letters.tolist(), strict=True)]
                    score, near = np.where(letters, p, 0.0), letters & (gap < model.ambiguous)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, n), batch.column(1).slice(row, n), pa.array(names, pa.string()), pa.array(score, pa.float64()), pa.array(near)], names=["doc_id", "held_out", "lang_pred", "score", "ambiguous"])

    return docs.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), F.col("text").cast("binary").alias("text")).mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, ambiguous boolean")


def identify(docs: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    return predict(docs, train(docs, per_language))
