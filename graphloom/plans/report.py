"""Reports: all findings as lazy tables, a Markdown summary, and DOT text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions import scalars as S
from graphloom.operators import degree, duplicates, recursion
from graphloom.plans.fixpoint import bounded

CAPS = {"dead": 40, "cycles": 12, "call_cycles": 6, "god": 8, "duplicates": 12, "coupling": 20}
#: Weight and line style of edges by kind.
WEIGHTS = {"call": 4, "inherits": 3, "import": 2, "references": 1}
STYLES = {"call": "solid", "inherits": "bold", "import": "dashed", "references": "dotted"}


def findings(nodes: DataFrame, edges: DataFrame, entry_ids: DataFrame, functions: DataFrame | None = None, dead: bool = True, god: bool = True, copies: bool = True, coupling: bool = True, cycles: bool = True, fan_out: int = degree.FAN_OUT, fan_in: int = degree.FAN_IN, least_cycle: int = 2) -> dict[str, DataFrame]:
    """Every section as a table; sections that aren't asked for are empty. Nothing runs until a table is read, but for the closures' loops."""
    reached = recursion.reachable(edges, entry_ids)
    out = {
        "overview": degree.overview(nodes, edges, entry_ids.count(), reached),
        "import_cycles": recursion.cycles(nodes, edges, "import", least_cycle),
        "call_cycles": recursion.cycles(nodes, edges, "call", least_cycle),
        "hubs": degree.hub_nodes(nodes, edges),
        "dead": recursion.dead_code(nodes, edges, entry_ids),
        "god": degree.god_nodes(nodes, edges, fan_out, fan_in),
        "coupling": degree.module_coupling(nodes, edges),
    }
    if functions is not None:
        out["duplicates"] = duplicates.duplicates(functions)
    for name, wanted in (("dead", dead), ("god", god), ("coupling", coupling), ("duplicates", copies), ("import_cycles", cycles), ("call_cycles", cycles)):
        if not wanted and name in out:
            out[name] = out[name].limit(0)
    return out


def _table(df: DataFrame, columns: list[str], order: list, most: int) -> list[str]:
    rows = df.orderBy(*order).limit(most + 1).select(*columns).collect()
    if not rows:
        return ["none", ""]
    out = ["| " + " | ".join(columns) + " |", "|" + " - |" * len(columns)]
    out += ["| " + " | ".join("" if v is None else str(v).replace("|", "\\|") for v in r) + " |" for r in rows[:most]]
    return [*out, *(["", f"(the first {most})"] if len(rows) > most else []), ""]


def markdown(found: dict[str, DataFrame], caps: dict[str, int] | None = None, snippets: DataFrame | None = None) -> str:
    """A summary of the findings; only the rows shown reach the driver. snippets: file_path, target, listing."""
    caps = CAPS | (caps or {})
    o = found["overview"].first().asDict()
    lines = ["# Graph report", "", "## Overview", "", *[f"- {k}: {v}" for k, v in o.items()], ""]
    if o["total_nodes"] and o["reachable_ratio"] < 0.9:
        lines += [f"More than a tenth of the nodes are not reached from an entrypoint ({o['reachable_ratio']}).", ""]
    size = F.col("members").desc() if "duplicates" in found else None
    sections = [
        ("Import cycles", "import_cycles", ["length", "names", "files"], [F.desc("length"), "root"], caps["cycles"]),
        ("Call cycles", "call_cycles", ["length", "names", "files"], [F.desc("length"), "root"], caps["call_cycles"]),
        ("Unreached code", "dead", ["file_path", "name", "kind", "reason"], [F.collate("file_path", "UNICODE"), F.collate("name", "UNICODE")], caps["dead"]),
        ("Most connected", "god", ["name", "file_path", "fan_in", "fan_out", "severity"], [F.desc(F.col("fan_in") + F.col("fan_out")), "node_seq"], caps["god"]),
        ("Coupling", "coupling", ["name", "ca", "ce", "instability", "verdict"], [F.desc(F.col("ca") + F.col("ce")), "node_seq"], caps["coupling"]),
        ("Hubs", "hubs", ["name", "file_path", "fan_in"], [F.desc("fan_in"), "node_seq"], degree.HUBS),
    ]
    if size is not None:
        sections.append(("Copies", "duplicates", ["match_type", "signature", "members", "files"], [size, "pass", "first_seq"], caps["duplicates"]))
    for title, name, columns, order, most in sections:
        lines += [f"## {title}", "", *_table(found[name], columns, order, most)]
    rigid = found["coupling"].where("verdict = 'stable-concrete' AND ca >= 3").orderBy(F.desc("ca"), "node_seq").limit(5).collect()
    if rigid:
        lines += ["## Depended upon, but concrete", "", *[f"- {r['name']} ({r['ca']} dependents)" for r in rigid], ""]
    if snippets is not None:
        for r in snippets.orderBy("file_path", "target").collect():
            lines += [f"### {r['file_path']}:{r['target']}", "", "```", r["listing"], "```", ""]
    questions = [q for q, there in (("Which edge of each import cycle could be turned around?", not found["import_cycles"].isEmpty()), ("Which unreached code can go?", not found["dead"].isEmpty()), ("Which of the most connected nodes should be split?", not found["god"].isEmpty())) if there]
    return "\n".join([*lines, *(["## Questions", "", *[f"- {q}" for q in questions], ""] if questions else [])])


@bounded
def dot_lines(nodes: DataFrame, edges: DataFrame, entry_ids: DataFrame, small: bool | None = None) -> DataFrame:
    """section, a, b, line: the DOT text in order of section (cluster heads 1..3, edges 4), a and b."""
    clusters = recursion.clusters(nodes, edges, entry_ids, small)
    clusters = recursion.cut(clusters)
    layer = recursion.layers(nodes, edges, clusters, small)
    rank = clusters.select("cluster_id", "label", "has_entrypoint", "is_orphan").distinct()
    number = F.when(F.col("has_entrypoint"), 0).when(F.col("is_orphan"), 2_000_000_000).otherwise(1_000_000_000) + F.coalesce(F.try_to_number(F.regexp_extract("cluster_id", r"(\d+)$", 1), F.lit("9999999999")).cast("long"), F.lit(0))
    rank = rank.withColumn("a", number.cast("long"))
    q = lambda c: F.concat(F.lit('"'), S.escape_dot(c.cast("string")), F.lit('"'))
    head = rank.select(F.lit(1).alias("section"), "a", F.lit(-2).cast("long").alias("b"), F.concat(F.lit("  subgraph cluster_"), "cluster_id", F.lit(" { label="), q(F.col("label")), F.when(F.col("is_orphan"), "; style=dashed").otherwise(""), F.lit(";")).alias("line"))
    tail = rank.select(F.lit(1).alias("section"), "a", F.lit(1 << 60).cast("long").alias("b"), F.lit("  }").alias("line"))
    placed = clusters.join(rank.select("cluster_id", "a"), "cluster_id").join(nodes.select("id", "name", "kind", "node_seq"), "id").join(layer.select("id", "layer"), "id", "left").join(entry_ids.withColumn("entry", F.lit(True)), "id", "left")
    b = F.coalesce("layer", F.lit(0)) * 4_000_000_000 + F.col("node_seq") + 1
    item = placed.select(F.lit(1).alias("section"), "a", b.cast("long").alias("b"), F.concat(F.lit("    "), q(F.col("id")), F.lit(" [label="), q(F.col("name")), F.lit(", class="), q(F.col("kind")), F.when(F.col("entry"), ", penwidth=3").otherwise(""), F.lit("];")).alias("line"))
    same = placed.where("NOT is_orphan").groupBy("a", "layer").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("node_seq", q(F.col("id")).alias("q")))), lambda x: x["q"]), "; ").alias("ids")).where("n > 1")
    same = same.select(F.lit(1).alias("section"), "a", (F.coalesce("layer", F.lit(0)) * 4_000_000_000).cast("long").alias("b"), F.concat(F.lit("    { rank=same; "), "ids", F.lit("; }")).alias("line"))
    return head.unionAll(tail).unionAll(item).unionAll(same).unionAll(dot_edges(edges))


def dot_edges(edges: DataFrame) -> DataFrame:
    """section 4 of dot_lines: one line for each pair; several edges give a count, one import its first three names."""
    g = degree.edge_groups(edges)
    label = F.when(F.col("edge_count") > 1, F.concat(F.lit(', label="×'), F.col("edge_count").cast("string"), F.lit('"'))).otherwise("")
    if "imported_names" in edges.columns:
        names = edges.groupBy("src", "dst").agg(F.first("imported_names", ignorenulls=True).alias("names"))
        g = g.join(names, ["src", "dst"])
        some = F.concat(F.array_join(F.slice("names", 1, 3), ", "), F.when(F.size("names") > 3, "…").otherwise(""))
        label = F.when((F.col("edge_count") == 1) & (F.size("names") > 0), F.concat(F.lit(', label="'), S.escape_dot(some), F.lit('"'))).otherwise(label)
    of_kind = lambda values: F.element_at(F.create_map(*[F.lit(x) for p in values.items() for x in p]), F.col("dominant_kind"))
    q = lambda c: F.concat(F.lit('"'), S.escape_dot(F.col(c).cast("string")), F.lit('"'))
    line = F.concat(F.lit("  "), q("src"), F.lit(" -> "), q("dst"), F.lit(' [id="'), S.edge_id(F.col("src"), F.col("dst")), F.lit('", weight='), of_kind(WEIGHTS).cast("string"), F.lit(", style="), of_kind(STYLES), label, F.lit("];"))
    return g.select(F.lit(4).alias("section"), F.col("first_seq").cast("long").alias("a"), F.lit(0).cast("long").alias("b"), line.alias("line"))


def dot(lines: DataFrame) -> str:
    body = [r["line"] for r in lines.orderBy("section", "a", "b").toLocalIterator()]
    return "\n".join(["digraph G {", "  rankdir=TB;", "  compound=true;", *body, "}"])
