"""Recursive operators: reachability, cycles, components, layers, call paths, neighbourhoods.

Each closure has two ways with one result: a loop of joins over DataFrames, its lineage cut by reliable checkpoints, and, for graphs of at most
`local.SMALL` rows, one task. `small` forces either. Loops first contract the graph (plans/contract.py), as long as that takes off a part of it: rounds grow with the logarithm of long chains, of trees' sizes and of rings,
and with the depth only of what can't be contracted. Inside all of them only small tables are broadcast (`bounded`), so that what the driver is sent doesn't grow with the graph."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.functions.scalars import is_test_path
from graphloom.operators.degree import fan_metrics
from graphloom.plans import local
from graphloom.plans.contract import NEVER, Chains, Rounds, chains, degrees, merged, weighted
from graphloom.plans.fixpoint import bounded, cut, numbered, star_components

PATHS, PATH_NODES, CYCLE_IDS = 25, 10, 10
#: The share of the edges that contracting must take off to go on.
WORTH = 1 / 8
#: Open paths that are advanced at once; frontiers that are kept as parts before they are joined.
BATCH, PARTS = 2000, 8


def _type(df: DataFrame, column: str) -> str:
    return df.select(column).schema[0].dataType.simpleString()


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionAll, parts)


def _compact(parts: list[DataFrame], write=cut) -> list[DataFrame]:
    """Parts are written once; only now and then are they written again, as one."""
    return parts if len(parts) <= PARTS else [write(_union(parts).coalesce(max(1, parts[0].rdd.getNumPartitions())))]


@bounded
def reachable(edges: DataFrame, seeds: DataFrame, small: bool | None = None, rounds: Rounds | None = None) -> DataFrame:
    """id of everything reached from the seeds (id) along edges of all kinds; unknown ids are reached and followed too."""
    steps = edges.select("src", "dst").distinct()
    if local.is_small(steps, seeds) if small is None else small:
        kind = _type(seeds, "id")
        return local.solve({"edges": steps, "seeds": seeds.select("id", F.col("id").alias("__v"))}, local.reach, f"node {kind}").withColumnRenamed("node", "id")
    done = rounds or Rounds()
    start = done(seeds.select("id").distinct())
    kept = start.withColumnRenamed("id", "node")
    e, shed = done(weighted(steps.where("src <> dst"))), []  # shed: (from, to) of nodes taken off, reached where `from` is
    n = e.count()
    while n:
        c = chains(e, done, kept)
        if c:
            shed.append(c.inner.select(F.col("head").alias("from"), F.col("node").alias("to")))
            e = c.edges.where("src <> dst")
        d = done(degrees(e).where("i = 0 OR o = 0").join(kept, "node", "left_anti").select("node", "i", "o"))
        ends = e.join(d.where("o = 0").select(F.col("node").alias("dst")), "dst", "left_semi").select(F.col("src").alias("from"), F.col("dst").alias("to"))
        shed.append(done(ends))
        # nothing leads to a source that is no seed
        e = done(e.join(d.where("o = 0").select(F.col("node").alias("dst")), "dst", "left_anti").join(d.where("i = 0").select(F.col("node").alias("src")), "src", "left_anti").select("src", "dst", "w", "c"))
        left = e.count()
        if left > (1 - WORTH) * n:
            break
        n = left
    frontier, seen = start, [start]
    while not e.isEmpty():
        new = e.join(frontier.withColumnRenamed("id", "src"), "src", "left_semi").select(F.col("dst").alias("id")).distinct()
        frontier = done(new.join(_union(seen), "id", "left_anti"))
        if frontier.isEmpty():
            break
        seen = _compact([*seen, frontier], done)
    for off in reversed(shed):
        more = off.join(_union(seen).withColumnRenamed("id", "from"), "from", "left_semi").select(F.col("to").alias("id")).distinct()
        seen = _compact([*seen, done(more)], done)
    return done.last(_union(seen))


@bounded
def dead_code(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, small: bool | None = None) -> DataFrame:
    """id, kind, name, file_path, reason of nodes that are no modules, no tests and not reached. With a column is_exported, a function that isn't exported gets a suffix."""
    left = nodes.where((F.col("kind") != "module") & ~is_test_path(F.col("file_path"))).join(reachable(edges, seeds, small), "id", "left_anti")
    reason = F.when(F.col("fan_in") == 0, "unreferenced").otherwise("referenced by dead code only")
    if "is_exported" in nodes.columns:
        reason = F.when((F.col("kind") == "function") & ~F.coalesce("is_exported", F.lit(False)), F.concat(reason, F.lit("; not exported"))).otherwise(reason)
    return left.join(fan_metrics(nodes, edges), "id").select("id", "kind", "name", "file_path", reason.alias("reason"))


def ordered_dead_code(dead: DataFrame) -> DataFrame:
    """By file, then name, in Unicode's collation."""
    return dead.orderBy(F.collate("file_path", "UNICODE"), F.collate("name", "UNICODE"))


@bounded
def strong_components(edges: DataFrame, small: bool | None = None, rounds: Rounds | None = None) -> DataFrame:
    """node, root (the least node) of strongly connected components of two nodes or more."""
    e = edges.select("src", "dst").where("src <> dst").distinct()
    kind = _type(e, "src")
    if local.is_small(e) if small is None else small:
        return local.solve({"edges": e}, local.strong, f"node {kind}, root {kind}")
    done = rounds or Rounds()
    e, records, found = done(weighted(e)), [], [e.select(F.col("src").alias("node"), F.col("dst").alias("label")).limit(0)]
    while True:
        e = _contracted_for_components(e, done, records, found)
        if e.isEmpty():
            break
        # every node's colour: the greatest node that reaches it
        colour = done(e.select(F.explode(F.array("src", "dst")).alias("node")).distinct().withColumn("colour", F.col("node")))
        while True:
            seen = e.join(colour.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")).agg(F.max("colour").alias("c"))
            new = done(colour.join(seen, "node", "left").select("node", F.greatest("colour", "c").alias("new"), "colour"))
            changed = not new.where("new <> colour").isEmpty()
            colour = new.select("node", F.col("new").alias("colour"))
            if not changed:
                break
        # what reaches the node that gives the colour, within the colour, is its component; no component spans two colours
        inside = e.join(colour.select(F.col("node").alias("src"), F.col("colour").alias("a")), "src").join(colour.select(F.col("node").alias("dst"), F.col("colour").alias("b")), "dst").where("a = b").select("src", "dst", "w", "c")
        inside = done(inside)
        own = frontier = done(colour.where("node = colour"))
        while True:
            back = inside.join(frontier.select(F.col("node").alias("dst"), "colour"), "dst").select(F.col("src").alias("node"), "colour").distinct()
            frontier = done(back.join(own, "node", "left_anti"))
            if frontier.isEmpty():
                break
            own = done(own.unionAll(frontier))
        found.append(own.select("node", F.col("colour").alias("label")))
        e = done(inside.join(own.select(F.col("node").alias("src")), "src", "left_anti").join(own.select(F.col("node").alias("dst")), "dst", "left_anti"))
    labels = done(_union(found))
    for c in reversed(records):  # a chain belongs to the component of both its ends; one that comes back to its head makes one with it
        ends = c.inner.join(c.tails, "first").select("node", "head", "tail").join(labels.select(F.col("node").alias("head"), F.col("label").alias("a")), "head", "left").join(labels.select(F.col("node").alias("tail"), F.col("label").alias("b")), "tail", "left")
        ends = done(ends.withColumn("label", F.when(F.col("head") == F.col("tail"), F.coalesce("a", "head")).when(F.col("a") == F.col("b"), F.col("a"))).where("label IS NOT NULL"))
        heads = ends.where("head = tail AND a IS NULL").select(F.col("head").alias("node"), "label").distinct()
        labels = done(labels.unionAll(ends.select("node", "label")).unionAll(heads))
    least = labels.groupBy("label").agg(F.min("node").alias("root"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return done.last(labels.join(least, "label").select("node", "root"))


def _contracted_for_components(e: DataFrame, done: Rounds, records: list[Chains], found: list[DataFrame]) -> DataFrame:
    """e without chains (kept in records), rings (in found), loops, and nodes without a way in or out, which are in no cycle."""
    n = e.count()
    while n:
        c = chains(e, done)
        if c:
            records.append(c)
            found.append(c.rings.select("node", F.col("root").alias("label")))
            e = c.edges.where("src <> dst")
        d = degrees(e).where("i > 0 AND o > 0").select("node")
        e = done(e.join(d.withColumnRenamed("node", "src"), "src", "left_semi").join(d.withColumnRenamed("node", "dst"), "dst", "left_semi").select("src", "dst", "w", "c"))
        left = e.count()
        if left > (1 - WORTH) * n:
            break
        n = left
    return e


@bounded
def cycles(nodes: DataFrame, edges: DataFrame, kind: str, least: int = 2, small: bool | None = None) -> DataFrame:
    """root, length, ids, names, files of the cycles of one kind of edge: the first 10 members by node_seq, and the distinct files of those."""
    m = strong_components(edges.where(F.col("kind") == kind), small).join(nodes.select(F.col("id").alias("node"), "name", "file_path", "node_seq"), "node", "left")
    order = W.partitionBy("root").orderBy(F.col("node_seq").asc_nulls_last(), "node")
    m = m.withColumn("k", F.row_number().over(order))
    n = m.groupBy("root").agg(F.count(F.lit(1)).alias("length")).where(F.col("length") >= least)
    top = m.where(F.col("k") <= CYCLE_IDS).groupBy("root").agg(F.array_sort(F.collect_list(F.struct("k", "node", "name", "file_path"))).alias("x"))
    text = lambda f: F.array_join(F.transform("x", f), ",")
    files = F.array_join(F.array_distinct(F.filter(F.transform("x", lambda x: x["file_path"]), lambda p: p.isNotNull() & (p != ""))), ",")
    return n.join(top, "root").select("root", "length", text(lambda x: x["node"].cast("string")).alias("ids"), text(lambda x: F.coalesce(x["name"], x["node"].cast("string"))).alias("names"), files.alias("files"))


@bounded
def components(nodes: DataFrame, edges: DataFrame, small: bool | None = None) -> DataFrame:
    """id, root of every node: the connected component's least node by id among known nodes; null for nodes that no edge touches.

    Edges to unknown nodes touch a node but connect nothing."""
    known = nodes.select("id")
    pairs = edges.select(F.col("src").alias("u"), F.col("dst").alias("v")).distinct()
    real = pairs.join(known.withColumnRenamed("id", "u"), "u", "left_semi").join(known.withColumnRenamed("id", "v"), "v", "left_semi").select("u", "v").where("u <> v")
    kind = _type(known, "id")
    found = local.solve({"edges": real}, local.components, f"node {kind}, root {kind}") if (local.is_small(real) if small is None else small) else star_components(real)
    touched = pairs.select(F.explode(F.array("u", "v")).alias("id")).distinct().withColumn("touched", F.lit(True))
    return known.join(found.withColumnRenamed("node", "id"), "id", "left").join(touched, "id", "left").select("id", F.coalesce("root", F.when(F.col("touched"), F.col("id"))).alias("root"))


@bounded
def clusters(nodes: DataFrame, edges: DataFrame, entry_ids: DataFrame, small: bool | None = None) -> DataFrame:
    """id, cluster_id, label, has_entrypoint, is_orphan: components with entrypoints first, then by size, then by first node; untouched nodes last."""
    small = local.is_small(nodes, edges) if small is None else small
    member = components(nodes, edges, small).join(nodes.select("id", "node_seq"), "id").join(entry_ids.select("id").distinct().withColumn("entry", F.lit(True)), "id", "left")
    about = member.where("root IS NOT NULL").groupBy("root").agg(F.count(F.lit(1)).alias("size"), F.min("node_seq").alias("first"), F.coalesce(F.bool_or("entry"), F.lit(False)).alias("has_entrypoint"))
    if small:
        about = about.withColumn("k", F.row_number().over(W.partitionBy("has_entrypoint").orderBy(F.desc("size"), "first")))
    else:
        about = numbered(about, F.desc("has_entrypoint"), F.desc("size"), "first")
        n = about.where("has_entrypoint").count()
        about = about.withColumn("k", F.col("seq") + 1 - F.when(F.col("has_entrypoint"), 0).otherwise(n))
    name = F.when(F.col("has_entrypoint"), F.concat(F.lit("ep_"), (F.col("k") - 1).cast("string"))).otherwise(F.concat(F.lit("cmp_"), (F.col("k") - 1).cast("string")))
    label = F.when(F.col("has_entrypoint") & (F.col("k") == 1), F.lit("Entrypoint")).when(F.col("has_entrypoint"), F.concat(F.lit("Entrypoint "), F.col("k").cast("string"))).otherwise(F.concat(F.lit("Component "), F.col("k").cast("string")))
    about = about.select("root", name.alias("cluster_id"), label.alias("label"), "has_entrypoint")
    out = member.join(about, "root", "left")
    return out.select("id", F.coalesce("cluster_id", F.lit("orphans")).alias("cluster_id"), F.coalesce("label", F.lit("Orphaned")).alias("label"), F.coalesce("has_entrypoint", F.lit(False)).alias("has_entrypoint"), F.col("root").isNull().alias("is_orphan"))


def _levels(edges: DataFrame, nodes: DataFrame, done: Rounds) -> DataFrame:
    """node, level: the longest path to each node that is neither in nor behind a cycle.

    Round by round sources are given their level and taken off, sinks put aside with their ways in, and chains made edges; what is left in the end lies in or behind cycles. Then chains and sinks, in the opposite order,
    get theirs, if all that leads to them has one."""
    e = done(weighted(edges))
    base = nodes.select("node", F.lit(0).cast("long").alias("base"))
    level, aside = [nodes.join(e.select(F.explode(F.array("src", "dst")).alias("node")), "node", "left_anti").select("node", F.lit(0).cast("long").alias("level"))], []
    base = done(base)
    n = e.count()
    while n:
        c = chains(e, done, base=base)
        if c:
            aside.append(c.inner.select(F.col("head").alias("src"), F.col("node").alias("dst"), "w", "c"))
            e = c.edges
        d = done(degrees(e).select("node", "i", "o"))
        sources = done(d.where("i = 0").join(base, "node").select("node", F.col("base").alias("level")))
        told = e.join(sources.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")).agg(F.max(F.greatest(F.col("level") + F.col("w"), "c")).alias("more"))
        base = done(base.join(told, "node", "left").select("node", F.greatest("base", "more").alias("base")))
        e = e.join(sources.select(F.col("node").alias("src")), "src", "left_anti")
        sinks = d.where("o = 0").select(F.col("node").alias("dst"))
        last = e.join(sinks, "dst", "left_semi").join(base.withColumnRenamed("node", "dst"), "dst").select("src", "dst", "w", F.greatest("c", "base").alias("c"))
        aside.append(done(last))
        e = done(e.join(sinks, "dst", "left_anti").select("src", "dst", "w", "c"))
        # what only sources led to, and nothing but sinks followed, is known as well
        held = e.select(F.explode(F.array("src", "dst")).alias("node")).unionAll(aside[-1].select("dst"))
        alone = d.where("i > 0").join(held, "node", "left_anti").join(base, "node").select("node", F.col("base").alias("level"))
        level = _compact([*level, sources, done(alone)], done)
        before, n = n, e.count()
        if n == before:
            break
    for off in reversed(aside):
        known = _union(level)
        ways = off.join(known.withColumnRenamed("node", "src"), "src", "left").groupBy(F.col("dst").alias("node")).agg(F.bool_and(F.col("level").isNotNull()).alias("free"), F.max(F.greatest(F.col("level") + F.col("w"), "c")).alias("level"))
        level = _compact([*level, done(ways.where("free").select("node", "level"))], done)
    return done.last(_union(level))


@bounded
def layers(nodes: DataFrame, edges: DataFrame, membership: DataFrame, small: bool | None = None, rounds: Rounds | None = None) -> DataFrame:
    """id, layer of the nodes of clusters (membership: id, cluster_id; orphans excluded): longest path from the sources inside the cluster.

    A node inside or behind a cycle stands one layer below its lowest free predecessor, or, if it has none, one below the cluster's last layer."""
    m = cut(membership.where("NOT is_orphan").select("id", "cluster_id") if "is_orphan" in membership.columns else membership.select("id", "cluster_id"))
    e = edges.where("src <> dst").select("src", "dst").distinct()
    inside = e.join(m.select(F.col("id").alias("src"), F.col("cluster_id").alias("a")), "src").join(m.select(F.col("id").alias("dst"), F.col("cluster_id").alias("b")), "dst").where("a = b").select("src", "dst")
    inside = cut(inside)
    kind = _type(m, "id")
    if local.is_small(inside, m) if small is None else small:
        free = local.solve({"edges": inside, "nodes": m.select("id", F.col("id").alias("__v"))}, local.layered, f"node {kind}, layer long").where("layer >= 0").withColumnRenamed("node", "id")
        free = cut(free)
    else:
        free = _levels(inside, m.select(F.col("id").alias("node")), rounds or Rounds()).select(F.col("node").alias("id"), F.col("level").alias("layer"))
    bound = m.join(free.select("id"), "id", "left_anti")
    behind = inside.join(free.select(F.col("id").alias("src"), "layer"), "src").groupBy(F.col("dst").alias("id")).agg((F.max("layer") + 1).alias("layer")).join(bound.select("id"), "id", "left_semi")
    known = free.select("id", "layer").unionByName(behind)
    last = m.join(known, "id").groupBy("cluster_id").agg(F.max("layer").alias("last"))
    return m.join(known, "id", "left").join(last, "cluster_id", "left").select("id", "cluster_id", F.coalesce("layer", F.coalesce("last", F.lit(0)) + 1).alias("layer"))


def call_paths(edges: DataFrame, target, most: int = PATHS, longest: int = PATH_NODES, batch: int = BATCH) -> DataFrame:
    """place, path (ids from the outermost caller to the target, joined by '>'), truncated: simple paths backwards along calls, in depth-first order of edge_seq.

    A path ends where every caller is already on it; one that would need more than `longest` nodes is dropped. The first `most` are kept. Without any, the target alone.
    Only the first `batch` open paths in depth-first order are advanced at once, so what is held grows with the callers of a batch, not with the number of paths; the search ends
    when more than `most` paths have ended before all open ones."""
    calls = cut(edges.where("kind = 'call'").select("edge_seq", "src", "dst"))
    spark, kind = calls.sparkSession, _type(calls, "src")
    schema = f"path array<{kind}>, ord array<long>"
    open_, n_open, ends, dropped = spark.createDataFrame([([target], [])], schema), 1, [], False
    while n_open:
        now = [(list(r["path"]), list(r["ord"])) for r in open_.orderBy("ord").limit(batch).collect()]
        if len(ends) > most and ends[most][0] < now[0][1]:
            break
        first = spark.createDataFrame(now, schema)
        later = open_.join(F.broadcast(first.select("ord")), "ord", "left_anti") if n_open > len(now) else None
        tips = F.broadcast(first.select(F.element_at("path", 1).alias("dst"), "path", F.col("ord").alias("before")))
        more = calls.join(tips, "dst").where(~F.array_contains("path", F.col("src")))
        more = cut(more.select("before", F.concat(F.array("src"), "path").alias("path"), F.concat("before", F.array("edge_seq")).alias("ord")))
        fits = F.size("path") <= longest
        about = {tuple(r["before"]): r for r in more.groupBy("before").agg(F.count_if(fits).alias("open"), F.count_if(~fits).alias("dropped")).collect()}  # a batch at most
        ends = sorted([*ends, *((o, path) for path, o in now if tuple(o) not in about)])[: most + 1]
        dropped = dropped or any(r["dropped"] for r in about.values())
        n_open += sum(r["open"] for r in about.values()) - len(now)
        open_ = more.where(fits).select("path", "ord")
        open_ = open_ if later is None else cut(open_.unionByName(later))
    total = len(ends)
    rows = [(k + 1, ">".join(str(x) for x in path)) for k, (_, path) in enumerate(ends[:most])] or [(1, str(target))]
    return spark.createDataFrame(rows, "place int, path string").withColumn("truncated", F.lit(bool(total > most or dropped)))


@bounded
def k_hop(edges: DataFrame, start, k: int) -> DataFrame:
    """id, direction, depth of what lies within k steps out of or into a node (depth 1 to k, the least counts; the node itself excluded). Each round is cut."""
    k = max(1, min(10, int(k)))
    out = []
    for direction, a, b in (("out", "src", "dst"), ("in", "dst", "src")):
        steps = edges.select(F.col(a).alias("a"), F.col(b).alias("b"))
        frontier = steps.sparkSession.range(1).select(F.lit(start).cast(_type(steps, "a")).alias("id"), F.lit(0).alias("depth"))
        seen = [frontier]
        for d in range(1, k + 1):
            new = steps.join(frontier.select(F.col("id").alias("a")), "a", "left_semi").select(F.col("b").alias("id")).distinct()
            frontier = cut(new.join(_union(seen), "id", "left_anti").select("id", F.lit(d).alias("depth")))
            if frontier.isEmpty():
                break
            seen = _compact([*seen, frontier])
        out.append(_union(seen).where("depth > 0").select("id", F.lit(direction).alias("direction"), "depth"))
    return out[0].unionAll(out[1])
