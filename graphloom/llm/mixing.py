"""Mixing sources to target weights.

Words are counted for each source, repetition rates follow from the targets, and each document is emitted floor(rate) times and once more with a
probability that equals the rate's fraction; the coin is a hash of the seed and the document's id, so runs agree.

Targets. Sources stand in order of code points (null last) and weigh `weights` in turn. Together they share `share` times all words by weight. A source gets `cap` times its
own words at most; what it can't take is shared again by weight among the others until none is above. Each such round is one aggregate over the sources.

Plan: texts are read once for their sizes; sizes and sources only are kept. Sources are summed in each task before they are dealt. The table of sources reaches the documents by
broadcast where its counted size is small, else large sources are broadcast (their number is bounded) and the others meet their documents by shuffle; rows of a hot source are never gathered.

Defined results: null and empty texts have no words, and are emitted like the others of their source; a null source is a source of its own, the last; repeated rows count
each, with one coin an id; null ids toss the coin of the empty text; a source without words has target 0 and rate 0; an empty table gives no rows; other columns have no effect on the
counts and are kept by `mix`.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm.common import cut, enter, free_name, spread_join, trim
from graphloom.llm.textbatch import IS_SPACE, TextBatch, chunks
from graphloom.plans.fixpoint import numbered

WEIGHTS = (5, 2, 1)
SHARE, CAP = 1.5, 2
SEED = 2024
#: Bytes of the table of sources up to which it is broadcast whole.
SMALL_BYTES = 1 << 23


@F.arrow_udf(T.LongType())
def n_words(text: pa.Array) -> pa.Array:
    enter()
    out = [np.zeros(0, np.int64)]
    for _, part in chunks(text):
        b = TextBatch(part)
        space = IS_SPACE[b.data]
        first = np.flatnonzero(~space[:-1] & np.concatenate([[True], space[:-2]])) if len(space) else np.zeros(0, np.int64)
        out.append(np.bincount(b.owner(first), minlength=b.n))
    trim()
    return pa.array(np.concatenate(out).astype(np.int64))


def coin(doc_id: Column, seed: int) -> Column:
    """A number in [0, 1) from seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("long") / F.lit(float(1 << 48))


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """sizes: source, size. One row a source: source, source_size, n_docs, weight, target."""
    sums = numbered(sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs")), F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("seq") % len(weights) + 1).cast("int"))
    sums = cut(sums.select("source", "source_size", "n_docs", weight.alias("weight")))
    limit = F.lit(cap) * F.col("source_size")
    r = sums.agg(F.sum("source_size").alias("words"), F.sum("weight").alias("weight")).first()
    total, taken, left, at_limit = share * (r["words"] or 0), 0, r["weight"] or 0, 0
    while True:
        above = (limit < F.col("weight") * F.lit((total - taken) / left)) if left else F.lit(True)
        r = sums.agg(F.count_if(above).alias("n"), F.sum(F.when(above, limit)).alias("taken"), F.sum(F.when(~above, F.col("weight"))).alias("left")).first()
        if not r["n"] or r["n"] == at_limit:
            break
        taken, left, at_limit = r["taken"], r["left"] or 0, r["n"]
    shared = F.col("weight") * F.lit(float(total - taken)) / F.lit(left) if left else limit
    return sums.withColumn("target", F.when(above, limit).otherwise(shared).cast("double"))


def with_copies(sized: DataFrame, about: DataFrame, seed: int = SEED) -> DataFrame:
    """sized (doc_id, source, size, and others) with source_size, target and copies, the times that the mix holds the row. about: result of targets."""
    key = free_name(sized, "__source")
    named = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))
    about = about.select(named.alias(key), "source_size", "n_docs", "target")
    bulk = about.agg(F.sum(F.octet_length(key) + 64).alias("b")).first()["b"] or 0
    rows = sized.withColumn(key, named)
    joined = rows.join(F.broadcast(about), key) if bulk <= SMALL_BYTES else spread_join(rows, about, key, "n_docs")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    return joined.drop(key, "n_docs").withColumn("copies", F.floor(rate) + (coin(F.col("doc_id"), seed) < rate - F.floor(rate)).cast("long"))


def shares(docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, cap: int = CAP, seed: int = SEED) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies: one row per document; taken are its words in the mix."""
    sized = cut(docs.select("doc_id", "source", n_words("text").alias("size")))
    out = with_copies(sized, targets(sized, weights, share, cap), seed)
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, cap: int = CAP, seed: int = SEED) -> DataFrame:
    """The mix itself: the rows of docs, each as often as it is emitted, and a column `copy` (or like it) that counts from 1."""
    about = targets(docs.select("source", n_words("text").alias("size")), weights, share, cap)
    keep = {c: f"__c{i}" for i, c in enumerate(docs.columns)}
    rows = docs.select("doc_id", "source", F.lit(0).alias("size"), *[F.col(c).alias(k) for c, k in keep.items()])
    copy = free_name(docs, "copy")
    return with_copies(rows, about, seed).where("copies > 0").select(*[F.col(k).alias(c) for c, k in keep.items()], F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias(copy))
