"""Graphs as JSON documents: validated import to tables, export from tables.

Tables keep each node and edge both as columns and as its own JSON text (`doc`), so nothing is lost on the way back; what the model doesn't know is stripped on
import. Errors carry a code: IO_ERROR, SERIALIZE_ERROR or VALIDATION_FAILED."""

from __future__ import annotations

import json
import os
from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.plans.fixpoint import numbered

VERSION = "1.0"
PRIMITIVES = ("string", "number", "boolean", "null", "undefined", "void", "any", "never", "unknown")


class GraphError(Exception):
    def __init__(self, code: str, message: str, problems: list[str] | None = None):
        super().__init__(message)
        self.code, self.problems = code, problems or []


# shapes: field -> check(value, path, problems) -> kept value; a trailing ? marks what may be absent


def _is(kind: type, name: str) -> Callable:
    def check(v, path, problems):
        if not isinstance(v, kind) or kind is not bool and isinstance(v, bool):
            problems.append(f"{path}: {name} expected")
        return v

    return check


_string, _boolean = _is(str, "text"), _is(bool, "true or false")


def _count(v, path, problems):
    if isinstance(v, bool) or not isinstance(v, (int, float)) or v < 0 or v != int(v):
        problems.append(f"{path}: a whole number from 0 expected")
        return v
    return int(v)


def _list(check: Callable) -> Callable:
    def run(v, path, problems):
        if not isinstance(v, list):
            problems.append(f"{path}: a list expected")
            return v
        return [check(x, f"{path}[{i}]", problems) for i, x in enumerate(v)]

    return run


def _one_of(*values) -> Callable:
    def run(v, path, problems):
        if v not in values:
            problems.append(f"{path}: one of {', '.join(values)} expected")
        return v

    return run


def _value(v, path, problems):
    if not isinstance(v, (str, int, float, bool)):
        problems.append(f"{path}: text, number or boolean expected")
    return v


def _shape(fields: dict[str, Callable]) -> Callable:
    def run(v, path, problems):
        if not isinstance(v, dict):
            problems.append(f"{path}: an object expected")
            return v
        out = {}
        for name, check in fields.items():
            plain = name.rstrip("?")
            if plain in v:
                out[plain] = check(v[plain], f"{path}.{plain}", problems)
            elif name == plain:
                problems.append(f"{path}.{plain}: missing")
        return out

    return run


def _tagged(variants: dict[str, dict]) -> Callable:
    shapes = {k: _shape({"kind": _one_of(k), **f}) for k, f in variants.items()}

    def run(v, path, problems):
        kind = v.get("kind") if isinstance(v, dict) else None
        if not isinstance(kind, str) or kind not in shapes:
            problems.append(f"{path}.kind: one of {', '.join(shapes)} expected")
            return v
        return shapes[kind](v, path, problems)

    return run


def type_expression(v, path, problems):
    return _TYPE(v, path, problems)


_PARAMETER = _shape({"name": _string, "typeInfo": type_expression, "isOptional": _boolean, "isRest": _boolean, "defaultValue?": _string})
_PROPERTY = _shape({"name": _string, "typeInfo": type_expression, "isOptional": _boolean, "isReadonly": _boolean, "jsdoc?": _string})
_TYPE = _tagged({
    "primitive": {"name": _one_of(*PRIMITIVES)}, "literal": {"value": _value}, "array": {"elementType": type_expression}, "tuple": {"elements": _list(type_expression)},
    "union": {"members": _list(type_expression)}, "intersection": {"members": _list(type_expression)}, "object": {"properties": _list(_PROPERTY)},
    "reference": {"name": _string, "typeArguments": _list(type_expression)}, "function": {"parameters": _list(_PARAMETER), "returnType": type_expression}, "unknown": {"raw": _string},
})
_PLACE = {"id": _string, "name": _string, "filePath": _string}
_AT = {**_PLACE, "line": _count, "column": _count, "isExported": _boolean}
_FUNCTION = {**_AT, "isAsync": _boolean, "parameters": _list(_PARAMETER), "returnType": type_expression, "jsdoc?": _string}
NODE = _tagged({
    "function": _FUNCTION, "class": {**_AT, "superClass?": _string, "interfaces": _list(_string), "methods": _list(_tagged({"function": _FUNCTION})), "properties": _list(_PROPERTY)},
    "interface": {**_AT, "extends": _list(_string), "properties": _list(_PROPERTY)}, "typeAlias": {**_AT, "typeInfo": type_expression}, "module": {**_PLACE, "exports": _list(_string)},
})
_ENDS = {"from": _string, "to": _string}
EDGE = _tagged({"call": {**_ENDS, "line": _count}, "import": {**_ENDS, "importedNames": _list(_string), "isTypeOnly": _boolean}, "inherits": _ENDS, "references": _ENDS})

_TOP = T.StructType([T.StructField("version", T.StringType()), T.StructField("generatedAt", T.StringType()), T.StructField("projectRoot", T.StringType()), T.StructField("entrypoints", T.ArrayType(T.StringType())), T.StructField("nodes", T.MapType(T.StringType(), T.StringType())), T.StructField("edges", T.ArrayType(T.StringType()))])
_CHECKED = "doc string, problems array<string>"
NODE_COLUMNS = "kind string, id string, name string, file_path string, line int, col int, is_exported boolean, is_async boolean, parameters_json string, type_json string, jsdoc string, super_class string, names array<string>"
EDGE_COLUMNS = "kind string, src string, dst string, line int, imported_names array<string>, is_type_only boolean"


def _checker(check: Callable):
    @F.arrow_udf(_CHECKED)
    def run(docs: pa.Array, paths: pa.Array) -> pa.Array:
        rows = []
        for d, p in zip(docs.to_pylist(), paths.to_pylist(), strict=True):
            problems: list[str] = []
            try:
                kept = check(json.loads(d) if d is not None else None, p, problems)
            except ValueError:
                kept, problems = None, [f"{p}: not JSON"]
            rows.append({"doc": json.dumps(kept, ensure_ascii=False), "problems": problems})
        return pa.array(rows, pa.struct([("doc", pa.string()), ("problems", pa.list_(pa.string()))]))

    return run


@dataclass
class Graph:
    meta: DataFrame  # version, generated_at, project_root
    entrypoints: DataFrame  # seq, path
    nodes: DataFrame  # node_key, node_seq, doc and NODE_COLUMNS
    edges: DataFrame  # edge_seq, doc and EDGE_COLUMNS
    problems: DataFrame  # problem


def _get(path: str, kind: str = "string"):
    return F.get_json_object("doc", f"$.{path}").cast(kind)


def tables(texts: DataFrame) -> Graph:
    """texts: one row, `value` the document. Bad rows stand in problems; a key seen twice keeps its last value, as its parser does."""
    top = texts.select(F.from_json("value", _TOP, {"mode": "PERMISSIVE"}).alias("g"), "value")
    meta = top.select("g.version", F.col("g.generatedAt").alias("generated_at"), F.col("g.projectRoot").alias("project_root"))
    entrypoints = top.select(F.posexplode("g.entrypoints").alias("seq", "path"))
    raw_nodes = top.select(F.posexplode(F.map_entries("g.nodes")).alias("node_seq", "x")).select(F.col("node_seq").cast("long"), F.col("x.key").alias("node_key"), F.col("x.value").alias("raw"))
    raw_edges = top.select(F.posexplode("g.edges").alias("edge_seq", "raw")).select(F.col("edge_seq").cast("long"), "raw")
    missing = F.filter(F.array(*[F.when(F.col(f"g.{f.name}").isNull(), F.lit(f"{f.name}: missing or of another type")) for f in _TOP]), lambda x: x.isNotNull())
    return _graph(meta, entrypoints, raw_nodes, raw_edges, top.select(F.explode(missing).alias("problem")))


def _graph(meta: DataFrame, entrypoints: DataFrame, raw_nodes: DataFrame, raw_edges: DataFrame, problems: DataFrame) -> Graph:
    """raw_nodes: node_key, node_seq, raw; raw_edges: edge_seq, raw; problems (problem) of the rest."""
    n = raw_nodes.withColumn("c", _checker(NODE)("raw", F.concat(F.lit("nodes."), "node_key"))).select("node_key", "node_seq", "c.doc", "c.problems")
    e = raw_edges.withColumn("c", _checker(EDGE)("raw", F.concat(F.lit("edges["), F.col("edge_seq").cast("string"), F.lit("]")))).select("edge_seq", "c.doc", "c.problems")
    problems = problems.unionAll(n.select(F.explode("problems"))).unionAll(e.select(F.explode("problems")))
    names = F.coalesce(*[F.from_json(F.get_json_object("doc", f"$.{k}"), "array<string>") for k in ("interfaces", "extends", "exports")])
    nodes = n.where(F.size("problems") == 0).select(
        "node_key", "node_seq", "doc", _get("kind").alias("kind"), _get("id").alias("id"), _get("name").alias("name"), _get("filePath").alias("file_path"), _get("line", "int").alias("line"), _get("column", "int").alias("col"), _get("isExported", "boolean").alias("is_exported"),
        _get("isAsync", "boolean").alias("is_async"), _get("parameters").alias("parameters_json"), F.coalesce(_get("returnType"), _get("typeInfo")).alias("type_json"), _get("jsdoc").alias("jsdoc"), _get("superClass").alias("super_class"), names.alias("names"),
    )
    edges = e.where(F.size("problems") == 0).select("edge_seq", "doc", _get("kind").alias("kind"), _get("from").alias("src"), _get("to").alias("dst"), _get("line", "int").alias("line"), F.from_json(_get("importedNames"), "array<string>").alias("imported_names"), _get("isTypeOnly", "boolean").alias("is_type_only"))
    return Graph(meta, entrypoints, nodes, edges, problems)


def _valid(graph: Graph) -> Graph:
    found = [r[0] for r in graph.problems.limit(20).collect()]
    if found:
        raise GraphError("VALIDATION_FAILED", f"{len(found)} problems at least; the first: {found[0]}", found)
    return graph


def _parsed(text: str, code: str) -> None:
    try:
        json.loads(text)
    except ValueError as e:
        raise GraphError(code, f"not JSON: {e}") from e


def read_graph(spark: SparkSession, path: str) -> Graph:
    try:
        rows = spark.read.text(path, wholetext=True)
        text = rows.first()
    except Exception as e:
        raise GraphError("IO_ERROR", f"{path} can't be read") from e
    if text is None:
        raise GraphError("IO_ERROR", f"{path} is empty")
    _parsed(text["value"], "IO_ERROR")
    return _valid(tables(rows))


def from_text(spark: SparkSession, text: str) -> Graph:
    _parsed(text, "SERIALIZE_ERROR")
    return _valid(tables(spark.createDataFrame([(text,)], "value string")))


def to_text(graph: Graph) -> str:
    """The document, indented by two spaces, nodes and edges in their order."""
    meta = graph.meta.first()
    doc = {"version": meta["version"], "generatedAt": meta["generated_at"], "projectRoot": meta["project_root"], "entrypoints": [r["path"] for r in graph.entrypoints.orderBy("seq").collect()]}
    doc["nodes"] = {r["node_key"]: json.loads(r["doc"]) for r in graph.nodes.select("node_key", "node_seq", "doc").orderBy("node_seq").toLocalIterator()}
    doc["edges"] = [json.loads(r["doc"]) for r in graph.edges.select("edge_seq", "doc").orderBy("edge_seq").toLocalIterator()]
    return json.dumps(doc, indent=2, ensure_ascii=False)


def write_graph(graph: Graph, path: str) -> None:
    try:
        os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
        with open(path, "w", encoding="utf-8") as f:
            f.write(to_text(graph))
    except OSError as e:
        raise GraphError("IO_ERROR", f"{path} can't be written") from e


def write_parts(graph: Graph, folder: str) -> None:
    """The document as text files in a folder: put together in order of their names they are one JSON document, a node or an edge a line. Nothing of it but the entrypoints goes through the driver."""
    spark, meta = graph.meta.sparkSession, graph.meta.first()
    head = {"version": meta["version"], "generatedAt": meta["generated_at"], "projectRoot": meta["project_root"], "entrypoints": [r["path"] for r in graph.entrypoints.orderBy("seq").collect()]}
    marks = [(0, json.dumps(head, ensure_ascii=False)[:-1] + ', "nodes": {'), (2, '}, "edges": ['), (4, "]}")]
    lines = spark.createDataFrame(marks, "section int, line string").select("section", F.lit(0).cast("long").alias("seq"), "line")
    key = F.to_json(F.array("node_key"))
    for section, rows, seq, text in (
        (1, graph.nodes, "node_seq", F.concat(F.substring(key, F.lit(2), F.length(key) - 2), F.lit(": "), "doc")),
        (3, graph.edges, "edge_seq", F.col("doc")),
    ):
        first = rows.agg(F.min(seq)).first()[0]
        lines = lines.unionAll(rows.select(F.lit(section).alias("section"), F.col(seq).cast("long").alias("seq"), F.concat(F.when(F.col(seq) == first, " ").otherwise(","), F.regexp_replace(text, r"[\r\n]", " ")).alias("line")))
    lines.repartitionByRange("section", "seq").sortWithinPartitions("section", "seq").select("line").write.text(folder)


def read_parts(spark: SparkSession, folder: str) -> Graph:
    """What write_parts wrote. A line begins with { (the head), with a blank or comma (a node or an edge), or closes one of these."""
    at = F.struct(F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("row"))
    try:
        lines = spark.read.text(folder).select(at.alias("at"), "value")
    except Exception as e:
        raise GraphError("IO_ERROR", f"{folder} can't be read") from e
    head = lines.where(F.col("value").startswith("{")).select(F.concat("value", F.lit('}, "edges": []}')).alias("value"))
    top = tables(head)
    items = lines.where(F.substring("value", 1, 1).isin(" ", ",")).select("at", F.substring("value", F.lit(2), F.length("value")).alias("item"))
    pair = F.from_json(F.concat(F.lit("{"), "item", F.lit("}")), "map<string,string>")
    given = numbered(items.where(F.col("item").startswith('"')).select("at", F.explode(pair).alias("node_key", "raw")), "at").select("node_key", F.col("seq").alias("node_seq"), "raw")
    nodes = given.groupBy("node_key").agg(F.min("node_seq").alias("node_seq"), F.max_by("raw", "node_seq").alias("raw"))
    edges = numbered(items.where(~F.col("item").startswith('"')), "at").select(F.col("seq").alias("edge_seq"), F.col("item").alias("raw"))
    return _valid(_graph(top.meta, top.entrypoints, nodes, edges, top.problems))


def save_tables(graph: Graph, folder: str) -> None:
    """The tables as Parquet; edges by kind, so a query on one kind reads its files only."""
    for name in ("meta", "entrypoints", "nodes"):
        getattr(graph, name).write.mode("overwrite").parquet(f"{folder}/{name}")
    graph.edges.write.mode("overwrite").partitionBy("kind").parquet(f"{folder}/edges")


def load_tables(spark: SparkSession, folder: str) -> Graph:
    t = {name: spark.read.parquet(f"{folder}/{name}") for name in ("meta", "entrypoints", "nodes", "edges")}
    return Graph(**t, problems=spark.createDataFrame([], "problem string"))
