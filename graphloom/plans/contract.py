"""Contraction of directed graphs, so that loops over them need few rounds.

A chain is a run of nodes with one way in and one way out each. Its nodes find its first by pointer doubling, in a number of rounds that grows with the logarithm of the longest chain, and the chain becomes
one edge. Together with taking off nodes that nothing leads to or from, long paths, trees and rings collapse in few rounds, whatever their depth.

An edge (src, dst, w, c) says that dst's value is at least max(value of src + w, c): what longest paths need; such edges follow one another, and lie beside one another, as one edge of the
same kind. Other uses leave w and c alone."""

from __future__ import annotations

import math
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.plans.fixpoint import shared_folder

#: Less than any value.
NEVER = -(1 << 60)


@dataclass
class Rounds:
    """The rounds of a loop, each a table in the shared folder, so that nothing grows from round to round: neither lineage nor the sizes that plans are chosen by (a checkpoint hands on estimates, which
    each join multiplies), and small tables are broadcast by their real size. `last` removes all of them but the result."""

    paths: list[str] = field(default_factory=list)
    n: int = 0

    def __call__(self, df: DataFrame) -> DataFrame:
        spark = df.sparkSession
        self.n += 1
        self.paths.append(f"{shared_folder(spark)}/round-{uuid.uuid4().hex}")
        df.write.parquet(self.paths[-1])
        return spark.read.schema(df.schema).parquet(self.paths[-1])

    def last(self, df: DataFrame) -> DataFrame:
        out = self(df)
        jvm, conf = df.sparkSession.sparkContext._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration()
        for path in self.paths[:-1]:
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(conf).delete(p, True)
        del self.paths[:]
        return out


def weighted(edges: DataFrame) -> DataFrame:
    """Edges (src, dst) as (src, dst, w, c) of length 1."""
    return edges.select("src", "dst", F.lit(1).cast("long").alias("w"), F.lit(NEVER).cast("long").alias("c"))


def merged(edges: DataFrame) -> DataFrame:
    """One edge a pair."""
    return edges.groupBy("src", "dst").agg(F.max("w").alias("w"), F.max("c").alias("c"))


def degrees(edges: DataFrame) -> DataFrame:
    """node, i, o and its last way in: pred, w, c (the only one where i is 1). One shuffle, added up before it."""
    no = lambda c: F.lit(None).cast(edges.schema[c].dataType)
    out = edges.select(F.col("src").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o"), no("src").alias("pred"), no("w").alias("w"), no("c").alias("c"))
    into = edges.select(F.col("dst").alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o"), F.col("src").alias("pred"), "w", "c")
    return out.unionAll(into).groupBy("node").agg(F.sum("i").alias("i"), F.sum("o").alias("o"), *[F.max(x).alias(x) for x in ("pred", "w", "c")])


@dataclass
class Chains:
    inner: DataFrame  # node, first (of its chain), head (before the first), w, c (from head to node)
    tails: DataFrame  # first, tail (after the last)
    rings: DataFrame  # node, root (the least) of rings that nothing leads into or out of
    edges: DataFrame  # src, dst, w, c without the chains' and rings' nodes
    removed: int


def chains(edges: DataFrame, done: Rounds, keep: DataFrame | None = None, base: DataFrame | None = None) -> Chains | None:
    """edges: one a pair. keep (node): never inside a chain; base (node, base): a node's least value."""
    d = degrees(edges).where("i = 1 AND o = 1 AND pred <> node").select("node", "pred", "w", "c")
    if keep is not None:
        d = d.join(keep, "node", "left_anti")
    if base is not None:
        d = d.join(base, "node", "left").select("node", "pred", "w", F.greatest("c", F.coalesce("base", F.lit(NEVER))).alias("c"))
    inner = done(d)
    n = inner.count()
    if not n:
        return None
    known = inner.join(inner.select(F.col("node").alias("pred"), F.lit(True).alias("more")), "pred", "left")
    known = known.select("node", "pred", "w", "c", F.coalesce("more", F.lit(False)).alias("more"))
    first = done(known.where("NOT more").select("node", "pred", "w", "c"))
    # each node points at an earlier one of its chain, the first at itself; w and c lead from there to the node, m is the least on the way
    step = lambda x, last, name: F.when(F.col("more"), F.col(x)).otherwise(F.lit(last)).alias(name)
    p = F.when(F.col("more"), F.col("pred")).otherwise(F.col("node"))
    state = done(known.select("node", p.alias("p"), step("w", 0, "far"), step("c", NEVER, "least"), F.least("node", p).alias("m")))
    for _ in range(math.ceil(math.log2(n)) + 1):
        before = state.select(F.col("node").alias("p"), F.col("p").alias("p2"), F.col("far").alias("far2"), F.col("least").alias("least2"), F.col("m").alias("m2"))
        new = state.join(before, "p").select("node", F.col("p2").alias("p"), (F.col("far") + F.col("far2")).alias("far"), F.greatest("least", F.col("least2") + F.col("far")).alias("least"), F.least("m", "m2").alias("m"), (F.col("p2") != F.col("p")).alias("moved"))
        new = done(new)
        state = new.drop("moved")
        if new.where("moved").isEmpty():
            break
    firsts = first.select(F.col("node").alias("p"), F.col("pred").alias("head"), "w", "c")
    inside = done(state.join(firsts, "p").select("node", F.col("p").alias("first"), "head", (F.col("far") + F.col("w")).alias("w"), F.greatest("least", F.col("c") + F.col("far")).alias("c")))
    rings = state.join(firsts, "p", "left_anti").select("node", F.col("m").alias("root"))
    ids = inner.select("node")
    outer = edges.join(ids.withColumnRenamed("node", "dst"), "dst", "left_anti")
    plain = outer.join(ids.withColumnRenamed("node", "src"), "src", "left_anti").select("src", "dst", "w", "c")
    leaving = outer.join(inside.select(F.col("node").alias("src"), "first", "head", F.col("w").alias("far"), F.col("c").alias("least")), "src")
    tails = leaving.select("first", F.col("dst").alias("tail"))
    passing = leaving.select(F.col("head").alias("src"), "dst", (F.col("far") + F.col("w")).alias("w"), F.greatest("c", F.col("least") + F.col("w")).alias("c"))
    return Chains(inside, done(tails), done(rings), done(merged(plain.unionAll(passing))), n)
