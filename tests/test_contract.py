"""Contracted loops against the one-task solvers, and their rounds on long graphs."""

import random

import pytest
from pyspark.sql import functions as F

from graphloom.operators import recursion
from graphloom.plans import local
from graphloom.plans.fixpoint import bounded, few_broadcasts
from graphloom.plans.contract import Rounds, chains, weighted


def edges_of(spark, pairs):
    return spark.createDataFrame([(int(a), int(b)) for a, b in pairs], "src long, dst long")


#: A chain, a ring with a way in, a loop, a small cycle on the chain, a tree, and a node apart.
PAIRS = [(i, i + 1) for i in range(8)] + [(10 + i, 10 + (i + 1) % 5) for i in range(5)] + [(5, 11), (3, 16), (16, 3), (17, 18), (17, 19), (19, 20), (2, 19), (21, 21), (22, 23), (23, 24), (24, 22)]


def test_contracted_loops(spark):
    n, pairs = 26, PAIRS
    edges, plain = edges_of(spark, pairs), [(a, b) for a, b in pairs if a != b]
    seeds = [0, n // 2, n + 5]
    got = recursion.reachable(edges, spark.createDataFrame([(s,) for s in seeds], "id long"), small=False).collect()
    assert sorted(r["id"] for r in got) == sorted(x for (x,) in local.reach({"edges": pairs, "seeds": [(s, s) for s in seeds]}))
    assert sorted(map(tuple, recursion.strong_components(edges, small=False).collect())) == sorted(local.strong({"edges": plain}))
    levels = recursion._levels(edges_of(spark, set(plain)), spark.range(n).withColumnRenamed("id", "node"), Rounds()).collect()
    assert sorted(map(tuple, levels)) == sorted((a, x) for a, x in local.layered({"edges": plain, "nodes": [(i, i) for i in range(n)]}) if x >= 0)


def test_rounds_on_long_graphs(spark):
    """A chain of 10,000 nodes, and a ring with tails, in at most 40 rounds."""
    n = 10_000
    names = list(range(n))
    random.Random(3).shuffle(names)
    chain = [(names[i], names[i + 1]) for i in range(n - 1)]
    edges, rounds = edges_of(spark, chain).cache(), Rounds()
    assert recursion.reachable(edges, spark.createDataFrame([(names[0],)], "id long"), small=False, rounds=rounds).count() == n and rounds.n <= 40
    rounds = Rounds()
    levels = recursion._levels(edges, spark.range(n).withColumnRenamed("id", "node"), rounds)
    assert {r["node"]: r["level"] for r in levels.collect()} == {x: i for i, x in enumerate(names)} and rounds.n <= 40
    ring = [*chain[:7999], (names[7999], names[0]), (names[50], names[8000]), *chain[8000:9000], (names[9999], names[4000]), *chain[9001:]]
    rounds = Rounds()
    got = recursion.strong_components(edges_of(spark, ring), small=False, rounds=rounds).collect()
    assert {r["node"] for r in got} == set(names[:8000]) and {r["root"] for r in got} == {min(names[:8000])} and rounds.n <= 40


def test_chains(spark):
    """Chains by their firsts, heads, lengths and tails; a ring apart is told by its least node."""
    c = chains(weighted(edges_of(spark, [(1, 5), (5, 4), (4, 2), (1, 2), (2, 3), (2, 6), (9, 8), (8, 7), (7, 9)])), Rounds())
    assert sorted((r["node"], r["first"], r["head"], r["w"]) for r in c.inner.collect()) == [(4, 5, 1, 2), (5, 5, 1, 1)]
    assert [tuple(r) for r in c.tails.collect()] == [(5, 2)] and sorted(map(tuple, c.rings.collect())) == [(7, 7), (8, 7), (9, 7)]
    assert sorted((r["src"], r["dst"], r["w"]) for r in c.edges.collect()) == [(1, 2, 3), (2, 3, 1), (2, 6, 1)]
    assert chains(weighted(edges_of(spark, [(1, 2)])), Rounds()) is None


def test_few_broadcasts(spark):
    """Inside closures tables of more than BROADCAST bytes aren't broadcast; nested ones are cut once, and the session's limit comes back, also after errors."""
    plans, limit = [], spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    table = spark.range(100_000).withColumn("x", F.rand(1))

    def joined(df):
        out = df.join(df.select("id", F.col("x").alias("y")), "id")
        plans.append(out._jdf.queryExecution().executedPlan().toString())
        return out

    assert "BroadcastHashJoin" in (joined(table) and plans.pop())
    assert bounded(joined)(table).count() == 100_000 and "BroadcastHashJoin" not in plans.pop()
    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") == limit
    with pytest.raises(ZeroDivisionError), few_broadcasts(spark) as outermost:
        with few_broadcasts(spark) as inner:
            assert outermost and not inner
        1 / 0  # noqa: B018
    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") == limit


def _sent(spark, run) -> int:
    """Bytes of task results that the driver is sent while run runs."""
    context = spark.sparkContext
    store, java = context._jsc.sc().statusStore(), context._jvm.java.util

    def stages():
        found = store.stageList(java.ArrayList(), False, False, context._gateway.new_array(context._jvm.double, 0), java.ArrayList())
        return {(s.stageId(), s.attemptId()): s.resultSize() for s in (found.apply(i) for i in range(found.size()))}

    before = stages()
    run()
    return sum(size for k, size in stages().items() if k not in before)


def test_sent_to_the_driver(spark, monkeypatch):
    """A loop's tables stay away from the driver, also those that the session would broadcast."""
    edges = spark.range(1, 200_001).select(F.lit(0).cast("long").alias("src"), F.xxhash64("id").alias("dst"))
    seeds = spark.range(1)
    rows = []

    def run():
        rows.append(recursion.reachable(edges, seeds, small=False).count())

    few = _sent(spark, run)
    monkeypatch.setattr("graphloom.plans.fixpoint.BROADCAST", 10 << 20)
    many = _sent(spark, run)
    assert rows == [200_001, 200_001]
    assert few < many / 3, (few, many)
