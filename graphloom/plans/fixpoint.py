"""Fixpoint loops over DataFrames, with lineage cut by reliable checkpoints."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROWS_A_TASK = 50_000
#: Bytes up to which a table is broadcast inside closures.
BROADCAST = 256 << 10
_THRESHOLDS = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Where it is unset, one process may use a temporary folder; a cluster must name one that all can reach."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    context = spark.sparkContext
    if not context.getCheckpointDir():
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoint-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


@contextmanager
def few_broadcasts(spark: SparkSession) -> Iterator[bool]:
    """Joins that are run inside broadcast tables of at most BROADCAST bytes; a session that broadcasts less, or nothing, is left as it is. Gives whether no other such block is around.

    Every broadcast goes through the driver. A loop that may broadcast up to the session's limit in each of its rounds sends more with every doubling of its tables, and well compressed tables are many times
    what Spark takes them for."""
    given = {k: spark.conf.get(k, None) for k in _THRESHOLDS}  # None: not set, so that the default holds
    now = {k: spark.conf.get(k) if v is None and k == _THRESHOLDS[0] else v for k, v in given.items()}
    lower = [k for k, v in now.items() if v is not None and _bytes(v) > BROADCAST]
    try:
        for k in lower:
            spark.conf.set(k, str(BROADCAST))
        yield bool(lower)
    finally:
        for k in lower:
            if given[k] is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, given[k])


def _bytes(size: str) -> int:
    """Bytes of a setting such as 10485760b, 10MB or -1."""
    number, unit = re.fullmatch(r"(-?\d+)\s*([kmgtp]?)i?b?", size.strip().lower()).groups()
    return int(number) << 10 * " kmgtp".index(unit or " ")


def bounded(closure):
    """The closure (DataFrames to a DataFrame) with few broadcasts; the outermost one's result is cut, so that its last joins are run that way too."""

    @wraps(closure)
    def run(first: DataFrame, *more, **named) -> DataFrame:
        with few_broadcasts(first.sparkSession) as outermost:
            out = closure(first, *more, **named)
            return cut(out) if outermost else out

    return run


def numbered(df: DataFrame, *order: str | Column) -> DataFrame:
    """df with seq: 0, 1, ... in the given order, which must be total. Sorted by ranges; only one count a partition reaches the driver."""
    s = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id())
    s = cut(s)
    part = F.shiftrightunsigned("__id", 33)
    offsets, total = {}, 0
    for r in s.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).orderBy("p").collect():
        offsets[r["p"]], total = total, total + r["n"]
    base = F.element_at(F.create_map(*[F.lit(x) for kv in offsets.items() for x in kv]), part) if offsets else F.lit(0)
    return s.withColumn("seq", (base + F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))).cast("long")).drop("__id")


def star_components(edges: DataFrame) -> DataFrame:
    """Connected components of undirected edges (u, v) of any orderable type: (node, root), root the least node of the component.

    Alternates large-star and small-star steps, which need a number of rounds that grows with the logarithm of the number of nodes;
    every step is a partially aggregated minimum and one join. Tasks are as many as the edges call for, not as the session shuffles: the
    edges shrink from round to round, and empty tasks would leave more files than rows.
    Nodes without an edge, or with a self-loop only, do not appear."""

    def directed(e: DataFrame) -> DataFrame:
        return e.select("u", "v").unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))

    def large(e: DataFrame) -> DataFrame:
        both = directed(e)
        least = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))
        return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))

    def small(e: DataFrame) -> DataFrame:
        down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        return moved.unionAll(least.select("u", F.col("m").alias("v"))).distinct()

    def mark(e: DataFrame) -> tuple:
        r = e.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        return r["n"], r["s"]

    def fitting(e: DataFrame) -> DataFrame:
        return e.coalesce(max(8, rows // ROWS_A_TASK))

    state = cut(edges.where("u <> v").select("u", "v").distinct())
    seen = mark(state)
    rows = seen[0]
    if not seen[0]:
        return state.select(F.col("u").alias("node"), F.col("v").alias("root"))
    while True:
        state = cut(fitting(small(fitting(large(fitting(state))))))
        now = mark(state)
        rows = now[0]
        if now == seen:
            break
        seen = now
    return state.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(state.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
