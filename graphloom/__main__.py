"""analyze: sources to a graph file; architect: graph file to a report; investigate: one look-up in a graph file."""

from __future__ import annotations

import argparse
import datetime
import logging
import sys

log = logging.getLogger("graphloom")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="graphloom", description=__doc__)
    p.add_argument("--verbose", action="store_true")
    sub = p.add_subparsers(dest="command", required=True)
    a = sub.add_parser("analyze")
    a.add_argument("root")
    a.add_argument("--output", default="graph.json")
    a.add_argument("--entrypoint", action="append")
    a.add_argument("--tsconfig")
    r = sub.add_parser("architect")
    r.add_argument("graph")
    r.add_argument("--output")
    for name, default in (("fan-out", 10), ("fan-in", 12), ("min-cycle", 2), ("context-lines", 4)):
        r.add_argument(f"--{name}", type=int, default=default)
    for name in ("dead", "god", "coupling", "cycles", "duplicates"):
        r.add_argument(f"--no-{name}", action="store_true")
    i = sub.add_parser("investigate")
    i.add_argument("graph")
    i.add_argument("--paths")
    i.add_argument("--dot", action="store_true")
    i.add_argument("--clusters")
    return p


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    logging.basicConfig(level=logging.DEBUG if args.verbose else logging.INFO)
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from graphloom.session import GraphSession
    from graphloom.sources import files, graph_json

    spark = SparkSession.builder.appName("graphloom").getOrCreate()
    try:
        if args.command == "analyze":
            s = GraphSession.scan(spark, args.root, args.entrypoint, args.tsconfig)
            now = datetime.datetime.now(datetime.timezone.utc).isoformat()
            meta = spark.createDataFrame([(graph_json.VERSION, now, s.root)], "version string, generated_at string, project_root string")
            fields = F.create_map(F.lit("kind"), "kind", F.lit("from"), "src", F.lit("to"), "dst")
            call = F.to_json(F.struct("kind", F.col("src").alias("from"), F.col("dst").alias("to"), "line", F.col("imported_names").alias("importedNames"), F.col("is_type_only").alias("isTypeOnly")))
            edges = s.edges.withColumn("doc", F.when(F.col("kind").isin("call", "import"), call).otherwise(F.to_json(fields)))
            entries = s.entrypoints.select(F.monotonically_increasing_id().alias("seq"), "path")
            graph_json.write_graph(graph_json.Graph(meta, entries, s.nodes, edges, spark.createDataFrame([], "problem string")), args.output)
        elif args.command == "architect":
            s = GraphSession.read(spark, args.graph)
            text = s.markdown(args.context_lines, cycles=not args.no_cycles, copies=not args.no_duplicates, fan_out=args.fan_out, fan_in=args.fan_in, least_cycle=args.min_cycle, dead=not args.no_dead, god=not args.no_god, coupling=not args.no_coupling)
            files.write_text(args.output, text) if args.output else print(text)
        else:
            s = GraphSession.read(spark, args.graph)
            if args.paths:
                s.call_paths(args.paths).show(truncate=False)
            elif args.dot:
                print(s.dot(args.clusters))
            else:
                s.clusters().show(truncate=False)
    except (graph_json.GraphError, files.FileError, files.ConfigError, LookupError, ValueError) as e:
        log.error("%s", e)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
