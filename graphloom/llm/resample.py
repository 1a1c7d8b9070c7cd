"""Importance resampling towards a target distribution over hashed n-grams.

Features of a text are its word n-grams of 1 to `n_max` words, hashed into buckets by the CRC-32 of their bytes. Counts over all documents and over the target texts give each bucket a
gain, floor(1000 ln(target share / raw share)) with one added to each count; a document's weight is the sum over its features, and a score that
adds Gumbel noise seeded by its id draws without replacement: the highest scores are the sample.

N-gram strings are never made. Each distinct word's CRC is computed once a worker; appending text to X obeys crc(XY) = shift(crc(X), len(Y)) ^ crc(Y), where shift, the effect of len(Y)
zero bytes, is a 32x32 matrix over GF(2). Matrices for 1, 2, 4, ... bytes come by squaring, each kept as four tables of 256 values, and a length is composed from its binary digits; so an
n-gram's CRC follows from that of its first n - 1 words, the space and the last word's, for a whole batch at once.

Plan: texts are read twice, for the counts (summed by bucket in each task before they are dealt; one row a bucket reaches the driver) and for the weights. Scores are written, and
ranked by ranges of their order, so no task sees all of them.

Defined results: null and empty texts have no features and weight 0; documents of fewer than `min_words` words are never drawn; repeated rows count and are drawn each; null ids
seed as the empty text and come last among equal scores; without target texts gains compare with a flat distribution; an empty table gives no rows; other columns have no effect.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import cut, frugal, worker_cache
from graphloom.llm.textbatch import TextBatch, chunks
from graphloom.llm.wordtable import WordTable
from graphloom.plans.fixpoint import numbered

N_MAX, BUCKETS, MIN_WORDS, PERCENT, SEED = 1, 10_000, 20, 10, 2024
POLYNOMIAL = 0xEDB88320  # CRC-32, bits reversed

_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


# CRC algebra


def _times(matrix: list[int], vector: int) -> int:
    out = 0
    for column in matrix:
        if vector & 1:
            out ^= column
        vector >>= 1
    return out


def _tables(matrix: list[int]) -> np.ndarray:
    """Products of the matrix with each value of each of the four bytes of a vector."""
    out = np.zeros((4, 256), np.uint32)
    for byte in range(4):
        for bit in range(8):
            out[byte, 1 << bit : 2 << bit] = out[byte, : 1 << bit] ^ np.uint32(matrix[8 * byte + bit])
    return out


def shift_tables(digits: int = 40) -> list[np.ndarray]:
    """Tables of the matrices that append 1, 2, 4, ... zero bytes."""
    bit = [POLYNOMIAL, *[1 << k for k in range(31)]]  # appends one zero bit
    matrix = bit
    for _ in range(3):
        matrix = [_times(matrix, c) for c in matrix]
    out = []
    for _ in range(digits):
        out.append(_tables(matrix))
        matrix = [_times(matrix, c) for c in matrix]
    return out


_SHIFT = shift_tables()
_SPACE = np.uint32(zlib.crc32(b" "))


def _apply(tables: np.ndarray, crc: np.ndarray) -> np.ndarray:
    return tables[0][crc & 255] ^ tables[1][(crc >> 8) & 255] ^ tables[2][(crc >> 16) & 255] ^ tables[3][crc >> 24]


def shifted(crc: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The effect of `length` zero bytes on each crc."""
    out, k = crc.copy(), 0
    left = length.astype(np.int64)
    while left.any():
        odd = np.flatnonzero(left & 1)
        out[odd] = _apply(_SHIFT[k], out[odd])
        left, k = left >> 1, k + 1
    return out


def joined(left: np.ndarray, right: np.ndarray, right_length: np.ndarray) -> np.ndarray:
    """CRCs of left texts, a space and right texts."""
    return shifted(_apply(_SHIFT[0], left) ^ _SPACE, right_length) ^ right


def gram_crcs(crc: np.ndarray, length: np.ndarray, owner: np.ndarray, n_max: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(CRCs, owners) of the n-grams of n = 1, 2, ... n_max words. crc, length, owner: of each word."""
    yield crc, owner
    at, now = np.arange(len(crc)), crc
    for n in range(2, n_max + 1):
        inside = at + n - 1 < len(crc)
        at, now = at[inside], now[inside]
        inside = owner[at] == owner[at + n - 1]
        at, now = at[inside], now[inside]
        now = joined(now, crc[at + n - 1], length[at + n - 1])
        yield now, owner[at]


_tables_of: dict[str, WordTable] = worker_cache("resample")


def batches_of(texts: pa.Array) -> Iterator[tuple[int, TextBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, batch, crc, length and owner of each word) of runs of rows."""
    if "crc" not in _tables_of:
        _tables_of["crc"] = WordTable(np.uint32, slots_log2=21)
    for row, part in chunks(texts):
        b = TextBatch(part, lower=True)
        solid = np.zeros(len(b.data) + 2, np.int8)
        solid[1:-1] = _WORD[b.data]
        edge = np.diff(solid)
        start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        raw = b.data.tobytes()
        crc, _ = _tables_of["crc"].encode(b.hashes(start, end), lambda at: [(zlib.crc32(raw[i:j]),) for i, j in zip(start[at].tolist(), end[at].tolist())])
        yield row, b, crc, end - start, b.owner(start)


# Spark


def bucket_counts(texts: DataFrame, n_max: int = N_MAX, buckets: int = BUCKETS) -> np.ndarray:
    """Features of all rows (column text) by bucket."""

    @frugal("resample")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, crc, length, owner in batches_of(batch.column(0)):
                for grams, _ in gram_crcs(crc, length, owner, n_max):
                    counts += np.bincount(grams % np.uint32(buckets), minlength=buckets)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[used])], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in texts.select(F.col("text").cast("binary").alias("text")).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln(((t + 1) / (T + buckets)) / ((s + 1) / (S + buckets)))) of each bucket."""
    s_all, t_all = float(raw.sum() + len(raw)), float(target.sum() + len(raw))
    return np.array([math.floor(1000 * math.log((t + 1.0) * s_all / ((s + 1.0) * t_all))) for s, t in zip(raw.tolist(), target.tolist(), strict=True)], np.int64)


def weights(docs: DataFrame, gain: np.ndarray, n_max: int = N_MAX) -> DataFrame:
    """doc_id, n_words, n_features, weight of each row."""

    @frugal("resample")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, b, crc, length, owner in batches_of(batch.column(1)):
                n, total = np.zeros(b.n, np.int64), np.zeros(b.n, np.int64)
                for grams, own in gram_crcs(crc, length, owner, n_max):
                    n += np.bincount(own, minlength=b.n)
                    sums = np.concatenate([[0], np.cumsum(gain[grams % np.uint32(len(gain))])])
                    first = np.searchsorted(own, np.arange(b.n + 1))
                    total += sums[first[1:]] - sums[first[:-1]]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, b.n), pa.array(np.bincount(owner, minlength=b.n)), pa.array(n), pa.array(total)], names=["doc_id", "n_words", "n_features", "weight"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def draw(docs: DataFrame, target: DataFrame, n_max: int = N_MAX, buckets: int = BUCKETS, min_words: int = MIN_WORDS, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score, rank: one row per document; rank is null where it isn't drawn."""
    gain = gains(bucket_counts(docs, n_max, buckets), bucket_counts(target, n_max, buckets))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))
    scored = cut(weights(docs, gain, n_max).withColumn("score", F.col("weight") + noise))
    fit = F.col("n_words") >= min_words
    drawn = percent * scored.where(fit).count() // 100
    ranked = numbered(scored.where(fit), F.col("score").desc(), F.col("doc_id").asc_nulls_last(), "n_features", "weight", "n_words")
    columns = ["doc_id", "n_features", "weight", "score"]
    return ranked.select(*columns, F.when(F.col("seq") < drawn, F.col("seq") + 1).alias("rank")).unionByName(scored.where(~fit).select(*columns, F.lit(None).cast("long").alias("rank")))


def sample(docs: DataFrame, target: DataFrame, **how: int) -> DataFrame:
    """The drawn rows of docs, with their columns. Ids must be unique, or all rows of a drawn id are kept."""
    ids = draw(docs, target, **how).where("rank is not null").select("doc_id").distinct()
    return docs.join(ids, "doc_id", "left_semi")
