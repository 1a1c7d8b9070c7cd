"""Filters, look-ups and source windows."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.scalars import absolute, file_category, pad_start


def source_files(files: DataFrame, root: str, excluded: tuple[str, ...] = ("node_modules", "dist", ".git", "coverage")) -> DataFrame:
    """Rows whose path is a TypeScript source inside root, in no excluded folder, and no declaration file."""
    path = F.col("path")
    inside = path.startswith(root.rstrip("/") + "/")
    segments = F.split(path, "/")
    return files.where(inside & path.rlike(r"\.tsx?$") & ~path.endswith(".d.ts") & ~F.arrays_overlap(segments, F.lit(list(excluded))))


def subgraph(nodes: DataFrame, edges: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The nodes with these ids, and the edges between them."""
    kept = nodes.join(ids.select("id").distinct(), "id", "left_semi")
    among = kept.select("id")
    e = edges.join(among.withColumnRenamed("id", "src"), "src", "left_semi").join(among.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return kept, e


def visible(nodes: DataFrame, edges: DataFrame, hidden_categories: tuple[str, ...] = ("tests", "fixtures", "mocks"), hidden_kinds: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Nodes of no hidden category or kind, and the edges that touch no hidden node."""
    hide = F.coalesce(file_category(F.col("file_path")).isin(*hidden_categories), F.lit(False)) | F.col("kind").isin(*hidden_kinds) if hidden_kinds else F.coalesce(file_category(F.col("file_path")).isin(*hidden_categories), F.lit(False))
    gone = nodes.where(hide).select("id")
    e = edges.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti")
    return nodes.where(~hide), e


def effective_orphans(nodes: DataFrame, groups: DataFrame, shown_nodes: DataFrame) -> DataFrame:
    """Shown nodes that have edge groups, none of which leads to a shown node at its other end."""
    shown = shown_nodes.select("id").withColumn("shown", F.lit(1))
    ends = groups.select("src", "dst").join(shown.select(F.col("id").alias("src"), F.col("shown").alias("s")), "src", "left").join(shown.select(F.col("id").alias("dst"), F.col("shown").alias("d")), "dst", "left")
    open_ = (F.col("s").isNotNull() & F.col("d").isNotNull()).cast("int")
    each = ends.select(F.explode(F.array_distinct(F.array("src", "dst"))).alias("id"), open_.alias("open"))
    alone = each.groupBy("id").agg(F.sum("open").alias("open")).where("open = 0")
    return shown_nodes.join(alone, "id", "left_semi")


def summaries(nodes: DataFrame) -> DataFrame:
    return nodes.select("id", "kind", "name", "file_path")


def node_edges(edges: DataFrame, node) -> DataFrame:
    """Edges out of and into a node, with direction; a self-loop is in both."""
    out = edges.where(F.col("src") == node).withColumn("direction", F.lit("out"))
    return out.unionByName(edges.where(F.col("dst") == node).withColumn("direction", F.lit("in")))


def edges_between(edges: DataFrame, src, dst) -> DataFrame:
    return edges.where((F.col("src") == src) & (F.col("dst") == dst))


def entrypoint_nodes(nodes: DataFrame, entrypoints: DataFrame, root: str) -> DataFrame:
    """Nodes whose file is an entrypoint, both made absolute and normal."""
    files = entrypoints.select(absolute(F.col("path"), root).alias("__file")).distinct()
    return nodes.withColumn("__file", absolute(F.col("file_path"), root)).join(files, "__file", "left_semi").drop("__file")


def source_window(files: DataFrame, wanted: DataFrame, radius: int) -> DataFrame:
    """files: file_path, text. wanted: file_path, line (from 1). Lines within the radius: file_path, target, line, content."""
    w = wanted.select("file_path", F.col("line").alias("target"))
    first = F.greatest(F.col("target") - radius, F.lit(1))
    near = F.slice(F.split("text", "\n"), first, F.greatest(F.col("target") + radius + 1 - first, F.lit(0)))  # only these lines are made rows
    lines = files.join(w, "file_path").select("file_path", "target", first.cast("int").alias("first"), F.posexplode(near).alias("pos", "content"))
    return lines.select("file_path", "target", (F.col("pos") + F.col("first")).alias("line"), "content")


def source_text(window: DataFrame) -> DataFrame:
    """A numbered listing of each window: file_path, target, listing; the target line is marked."""
    mark = F.when(F.col("line") == F.col("target"), "→").otherwise(" ")
    row = F.concat(mark, F.lit(" "), pad_start(F.col("line").cast("string"), 4), F.lit(" | "), F.col("content"))
    return window.groupBy("file_path", "target").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", row.alias("row")))), lambda x: x["row"]), "\n").alias("listing"))


def confined(path: str, root: str) -> str:
    """The path, if it lies inside root; else PermissionError."""
    full, top = os.path.realpath(os.path.join(root, path)), os.path.realpath(root)
    if full != top and not full.startswith(top + os.sep):
        raise PermissionError(f"{path} is outside {root}")
    return full


def selected_clusters(clusters: DataFrame, ids: str) -> DataFrame:
    """Nodes of the clusters named in a comma-separated list; ValueError if it names none that exists."""
    wanted = [x.strip() for x in ids.split(",") if x.strip()]
    known = {r["cluster_id"] for r in clusters.where(F.col("cluster_id").isin(*wanted)).select("cluster_id").distinct().collect()} if wanted else set()
    if not known:
        raise ValueError("no known cluster is named")
    return clusters.where(F.col("cluster_id").isin(*known))


def initial_scope(clusters: DataFrame) -> DataFrame:
    """Nodes of the clusters that hold an entrypoint, or of all clusters if none does."""
    some = clusters.where("has_entrypoint").limit(1).agg(F.count(F.lit(1)).alias("__some"))
    return clusters.join(some).where((F.col("__some") == 0) | F.col("has_entrypoint")).drop("__some")
