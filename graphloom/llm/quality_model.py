"""Quality classifier: a generalised additive model with pairwise interactions.

The score's logit is a sum of table entries: one per feature bin, and one per cell of chosen feature pairs. The tables are
learnt by cyclic boosting: in turn each feature gets a shallow tree (at most LEAVES leaves over its bins) fitted
to the gradient of the logistic loss and shrunk by RATE. Pairs are ranked by how much a two-level split of their
cells lowers the residual loss, and the best PAIRS are boosted in the same way with additive tables kept
fixed. Scoring is binning plus vectorised table additions.

Training uses at most `max_train` labelled rows (those with the smallest hash of the id), a documented bound; every
row is scored from its whole text. Defined results: null and empty texts are scored from all-zero counts;
labels that are null or whose id is null are ignored; repeated labels of an id count once (the lowest); with no usable label, or
one class only, the score is the smoothed share of label 1 (0.5 without any).
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm.common import cut, enter, fold, free_name, trim, with_ids
from graphloom.llm.textstats import text_stats

MAX_TRAIN = 20_000
CUTOFF = 0.7
BINS, PAIR_BINS, LEAVES, ROUNDS, RATE, PAIRS = 32, 8, 3, 120, 0.15, 6
FEATURES = ("log_words", "mean_word", "symbols", "dup_lines", "repeats", "capitals", "bangs", "stops", "pipes", "accents", "short_words", "long_words", "distinct", "digits", "line_words")


def features(text: pa.Array) -> np.ndarray:
    """(rows, FEATURES) from whole texts."""
    s = {k: v.astype(float) for k, v in text_stats(text).items()}
    words, chars, lines = np.maximum(s["n_words"], 1), np.maximum(s["word_chars"], 1), np.maximum(s["n_lines"], 1)
    columns = (np.log1p(s["n_words"]), s["word_chars"] / words, s["n_symbols"] / chars, s["n_dup_lines"] / lines, s["n_repeat_words"] / words, s["n_upper"] / np.maximum(s["n_upper"] + s["n_lower"], 1), s["n_bangs"] / words, s["n_stops"] / words, s["n_pipes"] / words, s["n_accents"] / chars, s["n_short"] / words, s["n_long"] / words, s["n_distinct"] / words, s["n_digits"] / chars, s["n_words"] / lines)
    return np.stack(columns, axis=1)


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def features_of(text: pa.Array) -> pa.Array:
    enter()
    x = features(text)
    trim()
    return pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1]), pa.int32()), pa.array(x.ravel()))


@dataclass
class Additive:
    """Edges and tables; `pairs` holds (feature, feature, table) with coarse edges of their own."""

    bias: float
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.bias)
        for j, (e, t) in enumerate(zip(self.edges, self.tables, strict=True)):
            z += t[np.searchsorted(e, x[:, j], "right")]
        for a, b, t in self.pairs:
            z += t[np.searchsorted(self.coarse[a], x[:, a], "right"), np.searchsorted(self.coarse[b], x[:, b], "right")]
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def _edges(values: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(values, np.arange(1, bins) / bins, method="higher"))


def _shallow(g: np.ndarray, h: np.ndarray, leaves: int) -> np.ndarray:
    """Best-first splits of ordered bins by Newton gain; the step of each bin's leaf."""
    spans = [(0, len(g))]
    cg, ch = np.concatenate([[0.0], np.cumsum(g)]), np.concatenate([[0.0], np.cumsum(h)])
    value = lambda a, b: (cg[b] - cg[a]) ** 2 / (ch[b] - ch[a] + 1)
    while len(spans) < leaves:
        best = (1e-9, None, 0)
        for s in spans:
            a, b = s
            if b - a > 1:
                k = np.arange(a + 1, b)
                gain = value(a, k) + value(k, b) - value(a, b)
                i = int(gain.argmax())
                if gain[i] > best[0]:
                    best = (gain[i], s, int(k[i]))
        if best[1] is None:
            break
        spans.remove(best[1])
        spans += [(best[1][0], best[2]), (best[2], best[1][1])]
    out = np.zeros(len(g))
    for a, b in spans:
        out[a:b] = (cg[b] - cg[a]) / (ch[b] - ch[a] + 1)
    return out


def _cells(g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, float]:
    """A tree of two levels over a grid: one cut of the first axis, and one cut of the second on either side."""
    total = lambda a: a.sum() ** 2
    best, out = -1.0, np.zeros_like(g)
    for k in range(1, g.shape[0]):
        step, gain = np.zeros_like(g), 0.0
        for rows in (slice(0, k), slice(k, None)):
            gg, hh = g[rows].sum(0), h[rows].sum(0)
            part = _shallow(gg, hh, 2)
            step[rows] = part
            gain += float((part * gg).sum())
        gain -= total(g) / (h.sum() + 1)
        if gain > best:
            best, out = gain, step
    return out, best


def fit(x: np.ndarray, y: np.ndarray) -> Additive:
    share = (y.sum() + 1) / (len(y) + 2)
    model = Additive(float(np.log(share / (1 - share))))
    if len(y) == 0 or y.min() == y.max():
        return model
    d = x.shape[1]
    model.edges = [_edges(x[:, j], BINS) for j in range(d)]
    bins = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(model.edges)]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    z = np.full(len(y), model.bias)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-z))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for j in range(d):
            g, h = slopes()
            n = len(model.tables[j])
            step = RATE * _shallow(np.bincount(bins[j], g, n), np.bincount(bins[j], h, n), LEAVES)
            model.tables[j] += step
            z += step[bins[j]]
    model.coarse = [_edges(x[:, j], PAIR_BINS) for j in range(d)]
    coarse = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(model.coarse)]
    g, h = slopes()

    def grid(a: int, b: int, v: np.ndarray) -> np.ndarray:
        m, n = len(model.coarse[a]) + 1, len(model.coarse[b]) + 1
        return np.bincount(coarse[a] * n + coarse[b], v, m * n).reshape(m, n)

    ranked = sorted(((-_cells(grid(a, b, g), grid(a, b, h))[1], a, b) for a in range(d) for b in range(a + 1, d)))
    chosen = [(a, b) for gain, a, b in ranked[:PAIRS] if gain < 0]
    tables = [np.zeros((len(model.coarse[a]) + 1, len(model.coarse[b]) + 1)) for a, b in chosen]
    for _ in range(ROUNDS // 4):
        for t, (a, b) in zip(tables, chosen, strict=True):
            g, h = slopes()
            step = RATE * _cells(grid(a, b, g), grid(a, b, h))[0]
            t += step
            z += step[coarse[a], coarse[b]]
    model.pairs = [(a, b, t) for (a, b), t in zip(chosen, tables, strict=True)]
    return model


def teachers(labels: DataFrame) -> DataFrame:
    """doc_id, y: one row a labelled id outside the held-out fold; the lowest label wins."""
    return labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & (fold("doc_id", 4) != 2)).groupBy("doc_id").agg(F.min("quality").alias("y"))


def train(measured: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> Additive:
    """measured: doc_id, x. Only ids outside the held-out fold teach; at most max_train rows reach the driver."""
    marks = teachers(labels)
    one = measured.join(marks, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)
    rows = one.select("x", "y").toArrow()
    y = np.array(rows["y"].to_pylist(), float)
    x = np.array(rows["x"].combine_chunks().flatten(), float).reshape(len(y), len(FEATURES)) if len(y) else np.zeros((0, len(FEATURES)))
    return fit(x, (y >= 1).astype(float))


def scorer(model: Additive):
    @F.arrow_udf(T.DoubleType())
    def score(x: pa.Array) -> pa.Array:
        flat = np.asarray(x.flatten(), float).reshape(len(x), len(FEATURES))
        return pa.array(model.score(flat))

    return score


def text_scorer(model: Additive):
    @F.arrow_udf(T.DoubleType())
    def score(text: pa.Array) -> pa.Array:
        enter()
        out = pa.array(model.score(features(text)))
        trim()
        return out

    return score


def predicted(score: Column) -> Column:
    return (score >= CUTOFF).cast("int")


def classify(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> DataFrame:
    """doc_id, held_out, score, predicted: one row per document."""
    measured = cut(docs.select("doc_id", features_of("text").alias("x")))
    model = train(measured, labels, max_train)
    return measured.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), scorer(model)("x").alias("score")).withColumn("predicted", predicted(F.col("score")))


def keep_good(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> DataFrame:
    """The rows of docs, with their columns, that score CUTOFF at least."""
    model = train(with_ids(docs.select("doc_id", "text"), teachers(labels)).select("doc_id", features_of("text").alias("x")), labels, max_train)
    score = free_name(docs, "__score")
    return docs.withColumn(score, text_scorer(model)("text")).where(F.col(score) >= CUTOFF).drop(score)
