"""Counts over nodes and edges: degrees, metrics, parallel edges, coupling, hot spots and hubs.

Counts are partially aggregated before their one shuffle. Edges whose ends are unknown nodes take part as each operator says."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from graphloom.functions.scalars import is_test_path, round2

FAN_OUT, FAN_IN, HUB_IMPORTERS, HUBS = 10, 12, 4, 15


def fan_metrics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, fan_in, fan_out of every node: edges of all kinds, parallel ones and self-loops included (a self-loop counts on both sides)."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("dst").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")), F.struct(F.col("src").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")))).alias("x")).select("x.*")
    counted = ends.groupBy("id").agg(F.sum("i").alias("fan_in"), F.sum("o").alias("fan_out"))
    return nodes.select("id").join(counted, "id", "left").select("id", F.coalesce("fan_in", F.lit(0)).alias("fan_in"), F.coalesce("fan_out", F.lit(0)).alias("fan_out"))


def page_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: node_count, edge_count, function_count, class_count, interface_count."""
    n = nodes.agg(F.count(F.lit(1)).alias("node_count"), *[F.count_if(F.col("kind") == k).alias(f"{k}_count") for k in ("function", "class", "interface")])
    return n.join(edges.agg(F.count(F.lit(1)).alias("edge_count")))


def overview(nodes: DataFrame, edges: DataFrame, entrypoint_count: int, reachable: DataFrame) -> DataFrame:
    """One row of metrics; reachable (id) may hold ids that are no nodes."""
    kinds = {"function_count": ["function"], "class_count": ["class"], "type_count": ["typeAlias", "interface"], "module_count": ["module"]}
    n = nodes.agg(F.count(F.lit(1)).alias("total_nodes"), *[F.count_if(F.col("kind").isin(k)).alias(c) for c, k in kinds.items()])
    e = edges.agg(F.count(F.lit(1)).alias("total_edges"), F.count_if(F.col("kind") == "call").alias("call_edges"), F.count_if(F.col("kind") == "import").alias("import_edges"))
    r = reachable.agg(F.count(F.lit(1)).alias("reachable_count"))
    ratio = F.when(F.col("total_nodes") > 0, round2(F.col("reachable_count") / F.col("total_nodes"))).otherwise(F.lit(0.0))
    return n.join(e).join(r).withColumn("entrypoint_count", F.lit(entrypoint_count).cast("long")).withColumn("reachable_ratio", ratio)


def edge_groups(edges: DataFrame) -> DataFrame:
    """src, dst, edge_count, dominant_kind (the most frequent; of equals the first seen), first_seq."""
    by_kind = edges.groupBy("src", "dst", "kind").agg(F.count(F.lit(1)).alias("n"), F.min("edge_seq").alias("seq"))
    return by_kind.groupBy("src", "dst").agg(F.sum("n").alias("edge_count"), F.max_by("kind", F.struct("n", -F.col("seq"))).alias("dominant_kind"), F.min("seq").alias("first_seq"))


def first_names(rows: DataFrame, key: str, order: str, name: str, most: int, out: str) -> DataFrame:
    """key, out: the first `most` names of each key by order, joined by commas. Ranked before they are gathered, so no list outgrows `most`."""
    w = W.partitionBy(key).orderBy(order)
    top = rows.withColumn("__k", F.row_number().over(w)).where(F.col("__k") <= most)
    return top.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__k", name))), lambda x: x[name]), ",").alias(out))


def _named(edges: DataFrame, nodes: DataFrame, end: str) -> DataFrame:
    """Edges with the name of one end; the id stands for a node that is unknown."""
    names = nodes.select(F.col("id").alias(end), "name")
    return edges.join(names, end, "left").withColumn("name", F.coalesce("name", F.col(end).cast("string")))


def module_coupling(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Modules with import neighbours: module_id, name, file_path, ca, ce, instability, verdict, dependents, dependencies (8 first-seen names each).

    A file's module is its first module node; the modules of a file share its figures."""
    modules = nodes.where("kind = 'module'")
    by_file = modules.groupBy("file_path").agg(F.min_by("id", "node_seq").alias("module_id"))
    at = nodes.select("id", "file_path").join(by_file, "file_path").select("id", "module_id")
    pairs = edges.where("kind = 'import'").join(at.select(F.col("id").alias("src"), F.col("module_id").alias("a")), "src").join(at.select(F.col("id").alias("dst"), F.col("module_id").alias("b")), "dst")
    pairs = pairs.where("a <> b").groupBy("a", "b").agg(F.min("edge_seq").alias("seq"))
    names = modules.select("id", "name")
    sides = []
    for me, other, count, names_out in (("b", "a", "ca", "dependents"), ("a", "b", "ce", "dependencies")):
        rows = pairs.select(F.col(me).alias("module_id"), F.col(other).alias("id"), "seq").join(names, "id")
        sides.append(rows.groupBy("module_id").agg(F.count(F.lit(1)).alias(count)).join(first_names(rows, "module_id", "seq", "name", 8, names_out), "module_id"))
    shape = nodes.groupBy("file_path").agg((F.count_if(F.col("kind").isin("interface", "typeAlias")) / F.count(F.lit(1))).alias("abstract"))
    both = sides[0].join(sides[1], "module_id", "full").join(modules.select(F.col("id").alias("module_id"), "name", "file_path", "node_seq"), "module_id").join(shape, "file_path")
    ca, ce = F.coalesce("ca", F.lit(0)), F.coalesce("ce", F.lit(0))
    both = both.select("module_id", "name", "file_path", "node_seq", ca.alias("ca"), ce.alias("ce"), round2(ce / (ca + ce)).alias("instability"), "abstract", F.coalesce("dependents", F.lit("")).alias("dependents"), F.coalesce("dependencies", F.lit("")).alias("dependencies"))
    stable = F.when(F.col("abstract") >= 0.6, "stable-abstract").otherwise("stable-concrete")
    verdict = F.when(F.col("instability") <= 0.2, stable).when(F.col("instability") >= 0.75, "unstable").otherwise("balanced")
    return both.withColumn("verdict", verdict).drop("abstract")


def _joined(nodes: DataFrame, edges: DataFrame, hits: DataFrame, me: str, other: str, kinds: tuple[str, ...], out: str) -> DataFrame:
    rows = edges.where(F.col("kind").isin(*kinds)).join(hits.select(F.col("id").alias(me)), me, "left_semi")
    return first_names(_named(rows, nodes, other), me, "edge_seq", "name", 10, out).withColumnRenamed(me, "id")


def god_nodes(nodes: DataFrame, edges: DataFrame, fan_out: int = FAN_OUT, fan_in: int = FAN_IN) -> DataFrame:
    """Nodes other than modules and tests at or over a threshold, with severity and the first 10 callers and callees."""
    hot = (F.col("fan_out") >= fan_out) | (F.col("fan_in") >= fan_in)
    hits = fan_metrics(nodes, edges).where(hot).join(nodes, "id").where((F.col("kind") != "module") & ~is_test_path(F.col("file_path")))
    high = (F.col("fan_out") >= 1.5 * fan_out) | (F.col("fan_in") >= 1.5 * fan_in)
    out = hits.withColumn("severity", F.when(high, "high").otherwise("medium"))
    out = out.join(_joined(nodes, edges, hits, "dst", "src", ("call", "import"), "callers"), "id", "left").join(_joined(nodes, edges, hits, "src", "dst", ("call", "import"), "callees"), "id", "left")
    return out.fillna("", ["callers", "callees"])


def hub_nodes(nodes: DataFrame, edges: DataFrame, importers: int = HUB_IMPORTERS, most: int = HUBS) -> DataFrame:
    """The `most` nodes other than modules with the most edges in, of those with `importers` import edges at least."""
    imports = edges.where("kind = 'import'").groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("imports")).where(F.col("imports") >= importers)
    hits = fan_metrics(nodes, edges).where(F.col("fan_in") >= importers).join(imports, "id").join(nodes, "id").where("kind <> 'module'")
    top = hits.orderBy(F.desc("fan_in"), "node_seq").limit(most)
    return top.join(_joined(nodes, edges, top, "dst", "src", ("import",), "importers"), "id")


def cluster_summary(clusters: DataFrame) -> DataFrame:
    """cluster_id, label, has_entrypoint, is_orphan, node_count."""
    return clusters.groupBy("cluster_id", "label", "has_entrypoint", "is_orphan").agg(F.count(F.lit(1)).alias("node_count"))


def by_file(rows: DataFrame, order: list[Column], most: int = 40) -> DataFrame:
    """The first `most` rows by order, counted by file: file_path, entries, names."""
    top = rows.orderBy(*order).limit(most).withColumn("__k", F.row_number().over(W.orderBy(*order)))
    return top.groupBy("file_path").agg(F.count(F.lit(1)).alias("entries"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__k", "name"))), lambda x: x["name"]), ",").alias("names"))
