import collections
import hashlib
import math
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from graphloom.llm import mixing, resample
from tests.llm.test_text import EDGE, WORD, docs

FEATURE = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return FEATURE.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def grams(text, n_max):
    w = words(text)
    return [" ".join(w[i : i + n]) for n in range(1, n_max + 1) for i in range(len(w) - n + 1)]


def test_shifts():
    r = random.Random(1)
    for _ in range(50):
        x, y = r.randbytes(r.randrange(20)), r.randbytes(r.choice([0, 1, 2, 3, 100, 70_000]))
        got = resample.shifted(np.array([zlib.crc32(x)], np.uint32), np.array([len(y)]))[0] ^ np.uint32(zlib.crc32(y))
        assert got == zlib.crc32(x + y)


@pytest.mark.parametrize("n_max", [1, 3])
def test_draw_by_brute_force(spark, n_max):
    r = random.Random(4)
    texts = EDGE + ["É ÉA-b_c 1a ŒŒ", "Z" * 9000 + " b " * 30] + [" ".join(r.choices(["the", "Cat", "sat,", "naïve", "12", "日本", "mat."], k=r.randrange(60))) for _ in range(200)]
    d = docs(spark, texts)
    target = spark.createDataFrame([(1, "the cat sat on the mat"), (2, None), (3, "naïve naïve")], "item_id long, text string")
    buckets = 97
    rows = d.select("doc_id", "text").collect()
    count = lambda all_texts: collections.Counter(zlib.crc32(g.encode()) % buckets for t in all_texts for g in grams(t, n_max))
    s, t = count(x["text"] for x in rows), count(x["text"] for x in target.collect())
    s_all, t_all = sum(s.values()) + buckets, sum(t.values()) + buckets
    gain = [math.floor(1000 * math.log((t[b] + 1) * s_all / ((s[b] + 1) * t_all))) for b in range(buckets)]
    want = []
    for x in rows:
        g = grams(x["text"], n_max)
        h = int(hashlib.sha256(f"7:{'' if x['doc_id'] is None else x['doc_id']}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[zlib.crc32(y.encode()) % buckets] for y in g)
        want.append((x["doc_id"], len(g), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), len(words(x["text"])) >= 5))
    fit = sorted((w for w in want if w[4]), key=lambda w: (-w[3], w[0] is None, w[0] or 0))
    got = resample.draw(d, target, n_max, buckets, min_words=5, percent=30, seed=7).collect()
    assert collections.Counter(tuple(x)[:4] for x in got) == collections.Counter(w[:4] for w in want)
    drawn = sorted((x for x in got if x["rank"]), key=lambda x: x["rank"])
    k = 30 * len(fit) // 100
    assert [x["rank"] for x in drawn] == list(range(1, k + 1)) and [(x["doc_id"], x["score"]) for x in drawn] == [(w[0], w[3]) for w in fit[:k]]
    assert resample.draw(d.limit(0), target).count() == 0 and resample.draw(d, target.limit(0)).count() == len(rows)
    kept = resample.sample(d, target, n_max=n_max, min_words=5, percent=30)
    assert kept.columns == d.columns and 0 < kept.count() < len(rows)


def level(sizes, weights, share, cap):
    """Targets with fractions: the excess of capped sources is shared again until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, capped = Fraction(share) * sum(sizes.values()), {}
    while True:
        rest = [s for s in order if s not in capped]
        left = total - sum(capped.values())
        above = [s for s in rest if left * w[s] / sum(w[x] for x in rest) > cap * sizes[s]]
        if not above:
            return {s: float(capped[s]) if s in capped else float(left * w[s] / sum(w[x] for x in rest)) for s in order}
        capped |= {s: Fraction(cap * sizes[s]) for s in above}


def test_targets_by_brute_force(spark):
    r = random.Random(8)
    for _ in range(4):
        sizes = {s: r.choice([0, 1, 10, 100, 1000, 50_000]) + r.randrange(5) for s in [None, "", "Z", "a", "é", "\U0001f600", "￮", *(f"s{i}" for i in range(r.randrange(20)))]}
        rows = spark.createDataFrame([(s, x) for s, n in sizes.items() for x in (n // 2, n - n // 2)], "source string, size long")
        got = {x["source"]: x["target"] for x in mixing.targets(rows).collect()}
        assert got == pytest.approx(level(sizes, mixing.WEIGHTS, "3/2", 2), rel=1e-12)


def test_mix(spark):
    d = docs(spark, EDGE + ["one two three"] * 3)
    from pyspark.sql import functions as F

    d = d.withColumn("source", F.when(F.col("doc_id") % 3 == 0, F.lit(None)).otherwise(F.concat(F.lit("s"), F.col("doc_id") % 5)))
    rows = [r.asDict() for r in d.collect()]
    count = [len(WORD.findall(r["text"] or "")) for r in rows]
    sizes = collections.Counter()
    for r, n in zip(rows, count):
        sizes[r["source"]] += n
    want = level(dict(sizes), mixing.WEIGHTS, "3/2", 2)
    expected = collections.Counter()
    for r, n in zip(rows, count):
        rate = want[r["source"]] / sizes[r["source"]] if sizes[r["source"]] else 0.0
        u = int(hashlib.sha256(f"2024:{'' if r['doc_id'] is None else r['doc_id']}".encode()).hexdigest()[:12], 16) / 2**48
        copies = math.floor(rate) + (u < rate - math.floor(rate))
        expected[(r["doc_id"], n, sizes[r["source"]], n * copies, copies)] += 1
    got = mixing.shares(d)
    assert collections.Counter((x["doc_id"], x["size"], x["source_size"], x["taken"], x["copies"]) for x in got.collect()) == expected
    mixed = mixing.mix(d)
    assert mixed.columns == [*d.columns, "copy"]
    held = collections.Counter(x["doc_id"] for x in mixed.collect())
    assert held == {i: n for i, n in ((i, sum(k[4] * c for k, c in expected.items() if k[0] == i)) for i in {k[0] for k in expected}) if n}
    assert mixing.mix(d.withColumn("copy", F.lit(1))).columns[-1] == "copy_"
    assert mixing.shares(d.limit(0)).count() == mixing.mix(d.limit(0)).count() == 0
    mixing.SMALL_BYTES, before = 0, mixing.SMALL_BYTES  # the way of many sources
    try:
        assert collections.Counter(map(tuple, mixing.shares(d).collect())) == collections.Counter(map(tuple, got.collect()))
    finally:
        mixing.SMALL_BYTES = before
