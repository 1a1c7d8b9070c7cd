"""One graph with everything that can be asked of it."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import types as Y
from graphloom.operators import degree, extract, filters, recursion
from graphloom.plans import report
from graphloom.sources import files as sources
from graphloom.sources import graph_json


class GraphSession:
    """nodes: id, node_seq, name, kind, file_path (and doc, line, ...). edges: edge_seq, kind, src, dst. entrypoints: path. files: file_path, text."""

    def __init__(self, nodes: DataFrame, edges: DataFrame, entrypoints: DataFrame, root: str = "/", files: DataFrame | None = None):
        self.nodes, self.edges, self.entrypoints, self.root, self.files = nodes.persist(), edges.persist(), entrypoints, root, files
        self._entries: DataFrame | None = None

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> GraphSession:
        """A stored graph; sources are read from its root, where that is there."""
        g = graph_json.read_graph(spark, path)
        root = g.meta.first()["project_root"]
        return cls(g.nodes, g.edges, g.entrypoints.select("path"), root, cls._sources(spark, root).persist() if os.path.isdir(root) else None)

    @staticmethod
    def _sources(spark: SparkSession, root: str) -> DataFrame:
        found = filters.source_files(sources.scan(spark, root, (".ts", ".tsx")), root)
        return found.select(F.substr("path", F.lit(len(root.rstrip("/")) + 2)).alias("file_path"), "text")

    @classmethod
    def scan(cls, spark: SparkSession, root: str, explicit: list[str] | None = None, config: str | None = None) -> GraphSession:
        """Extracts the graph of the sources below root. Entrypoints: explicit ones, else those of the project's configuration, which must be there."""
        root = os.path.abspath(root)
        holds = sources.configured(sources.config_path(root, config))
        files = cls._sources(spark, root).persist()
        nodes, edges = extract.graph(files)
        names = [r["file_path"] for r in files.select("file_path").orderBy("file_path").toLocalIterator()]
        entries = extract.entrypoints(names, explicit, [f for f in names if holds(os.path.join(root, f))])
        return cls(nodes, edges, spark.createDataFrame([(p,) for p in entries], "path string"), root, files)

    def close(self) -> None:
        """Releases what is kept in memory."""
        for df in (self.nodes, self.edges, self.files):
            if df is not None:
                df.unpersist()

    def __enter__(self) -> GraphSession:
        return self

    def __exit__(self, *error) -> None:
        self.close()

    def functions(self) -> DataFrame:
        """id, name, file_path, node_seq, signature (canonical parameter types), body (structural hash; null without sources): what duplicates are found by."""
        f = self.nodes.where("kind = 'function'")
        parameters = F.get_json_object("doc", "$.parameters")
        f = f.withColumn("signature", F.when(parameters != "[]", Y.parameter_signature(parameters)))
        if "body" not in f.columns:
            f = f.join(extract.bodies(self.files), "id", "left") if self.files is not None else f.withColumn("body", F.lit(None).cast("string"))
        return f.select("id", "name", "file_path", "node_seq", "signature", "body")

    def problems(self) -> DataFrame:
        """Statements of the sources that end before they are complete."""
        if self.files is None:
            raise LookupError("the sources aren't there")
        return extract.problems(self.files)

    def entry_ids(self) -> DataFrame:
        """Written once: every closure starts from them."""
        if self._entries is None:
            self._entries = recursion.cut(filters.entrypoint_nodes(self.nodes, self.entrypoints, self.root).select("id"))
        return self._entries

    def stats(self) -> DataFrame:
        return degree.page_stats(self.nodes, self.edges)

    def summaries(self) -> DataFrame:
        return filters.summaries(self.nodes)

    def clusters(self) -> DataFrame:
        return degree.cluster_summary(recursion.clusters(self.nodes, self.edges, self.entry_ids()))

    def node(self, node: str) -> DataFrame:
        return self.nodes.where(F.col("id") == node)

    def _with_context(self, found: DataFrame, radius: int = 3) -> DataFrame:
        """Edges with what there is to see of them: imported names, and the lines around a call (context, by line)."""
        if self.files is None or "line" not in found.columns:
            return found.withColumn("context", F.lit(None).cast("array<struct<line:int,content:string>>"))
        at = self.nodes.select(F.col("id").alias("src"), "file_path")
        calls = found.where("kind = 'call'").select("src", "line").distinct().join(at, "src")
        lines = filters.source_window(self.files, calls.select("file_path", "line").distinct(), radius)
        around = lines.groupBy("file_path", "target").agg(F.array_sort(F.collect_list(F.struct("line", "content"))).alias("context"))
        shown = calls.join(around.withColumnRenamed("target", "line"), ["file_path", "line"]).select("src", "line", F.lit("call").alias("kind"), "context")
        return found.join(shown, ["src", "line", "kind"], "left").select(*found.columns, "context")

    def _known(self, node: str) -> None:
        if self.node(node).isEmpty():
            raise LookupError(f"no node {node}")

    def node_edges(self, node: str) -> DataFrame:
        self._known(node)
        return self._with_context(filters.node_edges(self.edges, node))

    def edges_between(self, src: str, dst: str) -> DataFrame:
        found = filters.edges_between(self.edges, src, dst)
        if found.isEmpty():
            raise LookupError(f"no edge from {src} to {dst}")
        return self._with_context(found)

    def call_paths(self, node: str) -> DataFrame:
        return recursion.call_paths(self.edges, node)

    def k_hop(self, node: str, k: int) -> DataFrame:
        return recursion.k_hop(self.edges, node, k)

    def form(self, node: str) -> dict:
        """The form for a function of a graph that keeps documents."""
        row = self.node(node).where("kind = 'function'").first()
        if row is None:
            raise LookupError(f"{node} is no function")
        doc = json.loads(row["doc"])
        return Y.form(doc["id"], doc["name"], doc["parameters"])

    def source(self, path: str, line: int, radius: int = 3) -> DataFrame:
        """Lines around one line (radius at most 20) of a file inside the root."""
        if line < 1:
            raise ValueError("lines count from 1")
        full = filters.confined(path, self.root)
        spark = self.nodes.sparkSession
        files = spark.createDataFrame([(path, sources.read_text(full))], "file_path string, text string")
        return filters.source_window(files, spark.createDataFrame([(path, line)], "file_path string, line int"), min(radius, 20))

    def scope(self, cluster_ids: str | None = None) -> tuple[DataFrame, DataFrame]:
        """Nodes and edges of the named clusters, or of the initial ones."""
        all_ = recursion.cut(recursion.clusters(self.nodes, self.edges, self.entry_ids()))
        chosen = filters.selected_clusters(all_, cluster_ids) if cluster_ids else filters.initial_scope(all_)
        nodes, edges = filters.subgraph(self.nodes, self.edges, chosen)
        return recursion.cut(nodes), recursion.cut(edges)

    def dot(self, cluster_ids: str | None = None) -> str:
        nodes, edges = self.scope(cluster_ids)
        return report.dot(report.dot_lines(nodes, edges, self.entry_ids()))

    def report(self, **options) -> dict[str, DataFrame]:
        functions = recursion.cut(self.functions()) if options.get("copies", True) else self.functions()
        return report.findings(self.nodes, self.edges, self.entry_ids(), functions, **options)

    def snippets(self, nodes: DataFrame, radius: int) -> DataFrame:
        """file_path, target, listing: the source around nodes (file_path, line)."""
        wanted = nodes.where("line IS NOT NULL").select("file_path", "line").distinct()
        return filters.source_text(filters.source_window(self.files, wanted, radius))

    def markdown(self, context_lines: int = 0, caps: dict[str, int] | None = None, **options) -> str:
        """The report; with context_lines, and sources, the source around the most connected nodes that it names."""
        found = {name: recursion.cut(table) for name, table in self.report(**options).items()}  # sections are read more than once
        shown = None
        if context_lines and self.files is not None:
            top = found["god"].orderBy(F.desc(F.col("fan_in") + F.col("fan_out")), "node_seq").limit((report.CAPS | (caps or {}))["god"])
            shown = self.snippets(top.select("id").join(self.nodes, "id"), context_lines)
        return report.markdown(found, caps, shown)
