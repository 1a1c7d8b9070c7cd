"""Similarity join of documents by the Jaccard similarity of their sets of word 5-grams.

1. Each text becomes its sorted set of 64-bit gram hashes, a 128-bit fingerprint of the set, and MinHash bands. Texts with equal
   sets are one class of copies; everything below handles one representative per fingerprint, weighted by its copies.
2. Bands and rows are chosen for a target recall at the threshold. Representatives are shuffled on band
   hashes; those that share a band hash are linked to the bucket's least member, and the linked ones form candidate groups.
3. Inside a candidate group every pair that shares a band is verified on the full sets. A group of at most BLOCK is one task (with others). A larger one is
   verified whole, by pairs of blocks, or bucket by bucket, a pair in the first band that it shares: whichever sends fewer gram sets (buckets
   where texts form chains, the whole where most are alike). Large buckets are split into pairs of blocks too. Tasks are of bounded size; they return sums of links and
   a spanning forest of the verified links, so no list of all pairs of a group ever exists, and no pair is dropped.
4. The components of the verified links are the classes.

Defined results: a text of 1 to 4 words has one gram, all its words; a text without words (or null) links to nothing and is a class of
its own; copies link to each other; repeated rows are copies; a class is named by its least non-null id; an empty table gives
an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import cut, free_name, frugal, spread_join, trim
from graphloom.llm.textbatch import TextBatch, chunks, mix, windows
from graphloom.plans.fixpoint import star_components

WORDS, THRESHOLD, RECALL = 5, 0.8, 0.999
#: Representatives in a block of a large group; a task verifies two blocks against each other.
BLOCK = 1024
U = np.uint64


def bands_for(threshold: float = THRESHOLD, recall: float = RECALL, most: int = 192) -> tuple[int, int]:
    """(bands, rows): the most rows, thus the fewest false candidates, that reach the recall at the threshold with at most `most` hashes."""
    best = (most, 1)
    for rows in range(1, 33):
        p = threshold**rows
        bands = 1 if p >= 1 else math.ceil(math.log(1 - recall) / math.log(1 - p))
        if bands * rows <= most:
            best = (bands, rows)
    return best


def gram_sets(array: pa.Array, k: int = WORDS) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, sorted distinct gram hashes of all rows joined, grams of each row)."""
    for row, part in chunks(array):
        b = TextBatch(part)
        start, end = b.words()
        own = b.owner(start)
        h = b.hashes(start, end)
        grams, at = windows(h, own, k)
        owners = own[at]
        n_words = np.bincount(own, minlength=b.n)
        short = np.flatnonzero((n_words > 0) & (n_words < k))
        if len(short):
            first = np.cumsum(n_words) - n_words
            extra = np.array([int(mix(np.bitwise_xor.reduce(mix(h[first[i] : first[i] + n_words[i]] + np.arange(1, n_words[i] + 1, dtype=np.uint64)))[None])[0]) for i in short], np.uint64)
            grams, owners = np.concatenate([grams, extra]), np.concatenate([owners, short])
            order = np.argsort(owners, kind="stable")
            grams, owners = grams[order], owners[order]
        counts = np.bincount(owners, minlength=b.n)
        ends = np.cumsum(counts)
        out, sizes = [], np.zeros(b.n, np.int64)
        for i in np.flatnonzero(counts):
            g = np.unique(grams[ends[i] - counts[i] : ends[i]])
            out.append(g)
            sizes[i] = len(g)
        yield row, np.concatenate(out) if out else np.zeros(0, np.uint64), sizes


def fingerprints(grams: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """(rows, 16) bytes: two independent sums over each set."""
    ends = np.cumsum(sizes)
    out = np.zeros((len(sizes), 2), np.uint64)
    for j, salt in enumerate((0x5851F42D4C957F2D, 0x14057B7EF767814F)):
        c = np.zeros(len(grams) + 1, np.uint64)
        np.cumsum(mix(grams ^ U(salt)), out=c[1:])
        out[:, j] = mix(c[ends] - c[ends - sizes] + sizes.astype(np.uint64))
    return out.view(np.uint8)


def band_hashes(grams: np.ndarray, sizes: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """(non-empty rows, bands) hashes of `rows` minima each."""
    full = sizes > 0
    first = (np.cumsum(sizes) - sizes)[full]
    rng = np.random.default_rng(77)
    out = np.zeros((int(full.sum()), bands), np.uint64)
    if not len(out):
        return out
    g = mix(grams)
    low, high = (g & U(0xFFFFFFFF)).astype(np.uint32), (g >> U(32)).astype(np.uint32)
    for b in range(bands):
        h = np.full(len(out), b + 1, np.uint64)
        for _ in range(rows):
            x, y = rng.integers(1, 2**31, 2, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
            v = low * x + high * y
            v ^= v >> np.uint32(15)
            v *= np.uint32(0x2C1B3C6D)
            v ^= v >> np.uint32(13)
            least = np.minimum.reduceat(v, first)
            h = mix(h * U(0x9E3779B97F4A7C15) + least.astype(np.uint64))
        out[:, b] = h
    return out


def _binary(rows: np.ndarray) -> pa.Array:
    """Fixed-width rows of bytes as binary."""
    n, w = rows.shape
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(0, (n + 1) * w, w, dtype=np.int32)), pa.py_buffer(np.ascontiguousarray(rows))])


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key"), F.col("text").cast("binary").alias("text"))


def sketch(docs: DataFrame, bands: int, rows: int) -> DataFrame:
    """doc_id, text_key, fp (null without words), bands: one row per document."""

    @frugal()
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, grams, sizes in gram_sets(batch.column(2)):
                n = len(sizes)
                full = sizes > 0
                place = np.cumsum(full) - 1
                take = pa.array(np.where(full, place, 0), mask=~full)
                fp = _binary(fingerprints(grams, sizes)[full]).take(take)
                h = band_hashes(grams, sizes, bands, rows).view(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, h.size + 1, bands), pa.int32()), pa.array(h.ravel())).take(take)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, n), batch.column(1).slice(row, n), fp, lists], names=["doc_id", "text_key", "fp", "bands"])

    return _keyed(docs).mapInArrow(run, "doc_id long, text_key long, fp binary, bands array<long>")


def _positions(fp: np.ndarray, bits: int) -> np.ndarray:
    return (fp[:, :8].copy().view(np.uint64)[:, 0] % U(bits)).astype(np.int64)


def sets_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """fp, grams (packed 64-bit) of wanted fingerprints, read from the texts again; each task returns a fingerprint once.

    A bitmap of at most 8 MB keeps most other texts from the shuffle; the join decides."""
    bits = int(min(1 << 26, max(1 << 16, 16 * wanted.count())))
    slots = wanted.select(_slot(bits)("fp").alias("p")).select(F.floor(F.col("p") / 32).alias("w"), F.expr("shiftleft(1L, cast(p % 32 AS int)) AS b")).groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    field = np.zeros(-(-bits // 32), np.uint32)
    field[slots["w"].to_numpy()] = slots["b"].to_numpy().astype(np.uint32)
    shared = docs.sparkSession.sparkContext.broadcast(field)

    @frugal()
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have, seen = shared.value, set()
        for batch in batches:
            for _, grams, sizes in gram_sets(batch.column(0)):
                fp = fingerprints(grams, sizes)
                p = _positions(fp, bits)
                hit = np.flatnonzero((sizes > 0) & ((have[p // 32] >> (p % 32).astype(np.uint32)) & 1 == 1))
                ends = np.cumsum(sizes)
                out = []
                for i in hit.tolist():
                    key = fp[i].tobytes()
                    if key not in seen:
                        seen.add(key)
                        out.append((key, grams[ends[i] - sizes[i] : ends[i]].tobytes()))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in out], pa.binary()) for j in range(2)], names=["fp", "grams"])

    found = docs.select(F.col("text").cast("binary").alias("text")).mapInArrow(run, "fp binary, grams binary")
    return found.dropDuplicates(["fp"])


def _slot(bits: int):
    @F.arrow_udf("long")
    def slot(fp: pa.Array) -> pa.Array:
        if not len(fp):
            return pa.array([], pa.int64())
        return pa.array(_positions(np.frombuffer(b"".join(fp.to_pylist()), np.uint8).reshape(-1, 16), bits))

    return slot


def verify(sets: list[np.ndarray], bands: np.ndarray, left: np.ndarray, right: np.ndarray, threshold: float, only: int = -1) -> np.ndarray:
    """(len(left), len(right)) booleans: the pairs that share a band (with `only`, this one first) and are similar on their full sets."""
    share = np.zeros((len(left), len(right)), bool)
    for b in range(bands.shape[1] if only < 0 else only):
        share |= bands[left, b][:, None] == bands[right, b][None, :]
    if only >= 0:
        share = (bands[left, only][:, None] == bands[right, only][None, :]) & ~share
    size = np.array([len(s) for s in sets])
    low, high = np.minimum.outer(size[left], size[right]), np.maximum.outer(size[left], size[right])
    share &= low >= threshold * high - 1e-9
    if np.array_equal(left, right):
        share &= np.triu(np.ones_like(share), 1)
    pairs = np.argwhere(share)
    if len(pairs) * 20 <= share.size or len(pairs) <= 64:
        for i, j in pairs.tolist():
            a, b = sets[left[i]], sets[right[j]]
            both = len(np.intersect1d(a, b, assume_unique=True))
            share[i, j] = both >= threshold * (len(a) + len(b) - both) - 1e-9
        return share
    ids, counts = np.unique(np.concatenate([sets[i] for i in np.union1d(left, right)]), return_counts=True)
    ids = ids[counts > 1]
    at = [ids.searchsorted(s) for s in sets]
    at = [p[(p < len(ids)) & (ids[np.minimum(p, len(ids) - 1)] == s)] for p, s in zip(at, sets, strict=True)]
    both = np.zeros(share.shape, np.float32)
    for lo in range(0, len(ids), 4096):
        hi = min(len(ids), lo + 4096)
        tiles = []
        for side in (left, right):
            m = np.zeros((len(side), hi - lo), np.float32)
            for r, i in enumerate(side.tolist()):
                a, b = np.searchsorted(at[i], (lo, hi))
                m[r, at[i][a:b] - lo] = 1
            tiles.append(m)
        both += tiles[0] @ tiles[1].T
    return share & (both >= threshold * (size[left][:, None] + size[right][None, :] - both) - 1e-6)


def forest(hit: np.ndarray, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """(member, least member) of the components of the given pairs."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    todo = np.argwhere(hit)
    label = np.arange(max(left.max(), right.max()) + 1)
    while len(todo):  # hooks labels in bulk; the loop below ends what bulk steps leave
        a, b = label[left[todo[:, 0]]], label[right[todo[:, 1]]]
        rest = a != b
        if not rest.any():
            break
        todo, a, b = todo[rest], a[rest], b[rest]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (label[label] != label).any():
            label = label[label]
    for x in np.union1d(left[np.flatnonzero(hit.any(1))], right[np.flatnonzero(hit.any(0))]).tolist():
        root[x] = int(label[x])
    return [(x, r) for x, r in root.items() if x != r]


def classes(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """doc_id, text_key, class_id, n_links, class_key: one row per document. n_links counts the other documents whose sets are similar enough."""
    n_bands, n_rows = bands_for(threshold, recall)
    rows = cut(sketch(docs, n_bands, n_rows))
    reps = rows.where("fp IS NOT NULL").groupBy("fp").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("least_id"), F.first("bands").alias("bands"))
    reps = cut(reps)
    exploded = reps.select("fp", F.explode("bands").alias("band"))
    buckets = cut(exploded.groupBy("band").agg(F.min("fp").alias("v"), F.count(F.lit(1)).alias("n")).where("n > 1"))
    groups = cut(star_components(spread_join(exploded, buckets, "band", "n").select(F.col("fp").alias("u"), "v")))
    sizes = cut(groups.groupBy("root").agg(F.count(F.lit(1)).alias("size")))
    about = reps.select("fp", "copies", "bands").join(sets_of(docs, groups.select(F.col("node").alias("fp"))), "fp")
    members = groups.select(F.col("node").alias("fp"), "root")
    n_blocks = lambda c: F.ceil(F.col(c) / BLOCK)
    large = sizes.where(F.col("size") > BLOCK)
    if large.isEmpty():
        whole, by_bucket = members.select("fp", F.col("root").alias("group"), F.lit(1).alias("parts"), F.lit(-1).alias("only")), None
    else:
        homes = groups.select(F.col("node").alias("v"), "root")
        sent = buckets.join(homes, "v").groupBy("root").agg(F.sum(F.col("n") * n_blocks("n")).alias("sent"))
        sizes = cut(sizes.join(sent, "root", "left").withColumn("split", (F.col("size") > BLOCK) & (F.col("sent") < F.col("size") * n_blocks("size"))))
        placed = cut(spread_join(members, sizes, "root", "size"))
        whole = placed.where("NOT split").select("fp", F.col("root").alias("group"), n_blocks("size").cast("int").alias("parts"), F.lit(-1).alias("only"))
        split = placed.where("split").select("fp").join(reps.select("fp", "bands"), "fp").select("fp", F.posexplode("bands").alias("only", "band"))
        by_bucket = spread_join(split, buckets.select("band", "n"), "band", "n").select("fp", F.col("band").cast("string").cast("binary").alias("group"), n_blocks("n").cast("int").alias("parts"), "only")
    placed = whole if by_bucket is None else whole.unionByName(by_bucket)
    bins = max(16, -(-groups.count() // BLOCK))
    full = placed.withColumn("part", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")).join(about, "fp")
    spread = full.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    bin_ = F.when((F.col("parts") == 1) & (F.col("only") < 0), F.pmod(F.xxhash64("group"), F.lit(bins)).cast("string").cast("binary")).otherwise(F.col("group"))
    tasks = spread.select("fp", F.col("group").alias("root"), "only", "copies", "bands", "grams", "part", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), bin_.alias("bin"))

    def run(t: pa.Table) -> pa.Table:
        root = t["root"].to_pylist()
        fp, copies, part = t["fp"].to_pylist(), t["copies"].to_numpy(), t["part"].to_numpy()
        i, j, only = t["i"][0].as_py(), t["j"][0].as_py(), t["only"][0].as_py()
        sets = [np.frombuffer(x, np.uint64) for x in t["grams"].to_pylist()]
        bands = np.array(t["bands"].combine_chunks().flatten()).reshape(len(sets), -1)
        by: dict[bytes, list[int]] = {}
        for k, r in enumerate(root):
            by.setdefault(r, []).append(k)
        links, edges = np.zeros(len(sets), np.int64), []
        for own in by.values():
            own = np.array(own)
            left, right = own[part[own] == i], own[part[own] == j]
            if not len(left) or not len(right):
                continue
            hit = verify(sets, bands, left, right, threshold, only)
            links[left] += hit @ copies[right]
            links[right] += copies[left] @ hit
            edges += forest(hit, left, right) if hit.any() else []
        n = np.flatnonzero(links)
        trim()
        return pa.table({"u": pa.array([fp[k] for k in n] + [fp[a] for a, _ in edges], pa.binary()), "v": pa.array([None] * len(n) + [fp[b] for _, b in edges], pa.binary()), "links": pa.array(np.concatenate([links[n], np.zeros(len(edges), np.int64)]))})

    found = cut(tasks.groupBy("bin", "only", "i", "j").applyInArrow(run, "u binary, v binary, links long"))
    joined = star_components(found.where("v IS NOT NULL").select("u", "v"))
    links = found.where("v IS NULL").groupBy(F.col("u").alias("fp")).agg(F.sum("links").alias("links"))
    named = reps.select("fp", "copies", "least_id").join(joined.withColumnRenamed("node", "fp"), "fp", "left").join(links, "fp", "left")
    named = cut(named.select("fp", "copies", "least_id", F.coalesce("root", "fp").alias("root"), F.coalesce("links", F.lit(0)).alias("links")))
    ids = cut(named.groupBy("root").agg(F.min("least_id").alias("class_id"), F.sum("copies").alias("members"), F.count(F.lit(1)).alias("size")))
    about = cut(spread_join(named, ids, "root", "size").where("members > 1").select("fp", "copies", "class_id", F.col("root").alias("class_key"), (F.col("links") + F.col("copies") - 1).alias("n_links")))
    return spread_join(rows.select("doc_id", "text_key", "fp"), about, "fp", "copies", "left").select("doc_id", "text_key", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), "class_key")


def keep_one(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """The rows of docs, with their columns, but of each class only the row with the least id."""
    found = cut(classes(docs, threshold, recall))
    linked = found.where("class_key IS NOT NULL")
    kept = cut(linked.groupBy("class_key").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_key")).alias("k"), F.count(F.lit(1)).alias("n")))
    gone = spread_join(linked, kept, "class_key", "n").where(~(F.col("doc_id").eqNullSafe(F.col("k.doc_id")) & (F.col("text_key") == F.col("k.text_key")))).select("doc_id", "text_key").distinct()
    key, id_, text = (free_name(docs, x) for x in ("__key", "__id", "__gone"))
    keyed = docs.withColumn(key, F.xxhash64(F.coalesce("text", F.lit(""))))
    gone = gone.select(F.col("doc_id").alias(id_), F.col("text_key").alias(text))
    rest = keyed.join(gone, (keyed[key] == gone[text]) & keyed["doc_id"].eqNullSafe(gone[id_]), "left_anti")
    twice = cut(linked.groupBy("doc_id", "text_key").count().where("count > 1").select(F.col("doc_id").alias(id_), F.col("text_key").alias(text)))
    if not twice.isEmpty():
        again = (keyed[key] == twice[text]) & keyed["doc_id"].eqNullSafe(twice[id_])
        once = rest.join(twice, again, "left_semi").dropDuplicates(["doc_id", key])
        rest = rest.join(twice, again, "left_anti").unionByName(once)
    return rest.drop(key)
