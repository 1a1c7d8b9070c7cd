"""Names and types over all files, by joins.

Scopes. A use carries the scopes around it; the innermost of them that declares its name wins (an equi-join on file, scope and name, ranked by place), so a shadowed name is
never taken for what it hides, and the work grows with uses times nesting.

Exports. What a file exports stands in one table; `export *` is closed over its chains, and aliases (imports and re-exports) point at each other until doubling has led
every one to a declaration: rounds grow with the logarithm of a chain's length. An explicit export hides one that comes by a star, a nearer star a farther one.

Types. An expression is a base and steps. All expressions advance together, each round one look-up: a member of a class or interface (inherited ones by distance), what a function returns,
what a module exports, what a type's name stands for, or the expression that a variable was given. Nobody is followed for more than ROUNDS steps. Look-ups have one row a key; where a
third of all uses ask for one key, adaptive execution splits the side of the uses.

Aliases are written out up to DEEPEST levels, then unknown(raw); classes and interfaces are references by their own names. Generic aliases stay references."""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.functions.scopes import present, total, union, widened
from graphloom.functions.tokens import DEEPEST
from graphloom.plans.fixpoint import cut

#: Look-ups that one expression may take.
ROUNDS = 24
#: How often an expression inside an expression's type is written out.
NESTED = 3
_ADVANCED = T.StructType([T.StructField("info", T.StringType()), T.StructField("steps", T.ArrayType(T.StringType())), *[T.StructField(c, T.StringType()) for c in ("space", "owner", "name")]])


def symbol(key: Column) -> Column:
    return F.to_json(F.struct(F.lit("symbol").alias("kind"), key.alias("id")))


def _advance(info: str | None, steps: list[str], context: str) -> tuple:
    """(type, steps left, look-up that the next step needs)."""
    none = (None, [], None, None, None)
    if info is None:
        return none
    t = json.loads(info)
    while True:
        kind = t["kind"]
        if kind == "path":
            return json.dumps(t), steps, "base", t["key"], ""
        if not steps:
            return json.dumps(t, ensure_ascii=False), [], None, None, None
        op, _, name = steps[0].partition(":")
        if kind == "union":
            rest = present(t)
            if len(rest) != 1:
                return none
            t = rest[0]
        elif kind == "either":
            t = t["left"]
        elif op == "await":
            promise = kind == "reference" and t["name"] in ("Promise", "PromiseLike") and t["typeArguments"]
            t, steps = t["typeArguments"][0] if promise else t, steps[1:]
        elif kind == "reference":
            if op == "index" and t["name"] in ("Array", "ReadonlyArray") and t["typeArguments"]:
                t, steps = t["typeArguments"][0], steps[1:]
            else:
                return json.dumps(t), steps, "type", context, t["name"]
        elif op == "index" and kind == "array":
            t, steps = t["elementType"], steps[1:]
        elif op == "call" and kind == "function":
            t, steps = t["returnType"], steps[1:]
        elif op == "call" and kind == "symbol":
            return json.dumps(t), steps, "return", t["id"], ""
        elif op == "member" and kind == "object":
            found = [p["typeInfo"] for p in t["properties"] if p["name"] == name]
            if not found:
                return none
            t, steps = found[0], steps[1:]
        elif op == "member" and kind in ("symbol", "instance"):
            return json.dumps(t), steps, "static" if kind == "symbol" else "member", t["id"], name
        else:
            return none


@F.arrow_udf(_ADVANCED)
def advance(info: pa.Array, steps: pa.Array, context: pa.Array) -> pa.Array:
    rows = [_advance(*x) for x in zip(info.to_pylist(), steps.to_pylist(), context.to_pylist(), strict=True)]
    columns = list(zip(*rows, strict=True)) or [()] * 5
    return pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.list_(pa.string()), *[pa.string()] * 3), strict=True)], names=["info", "steps", "space", "owner", "name"])


def closed(pairs: DataFrame, rank: str) -> DataFrame:
    """a, b, and the least rank (an array, which adds up along a way) of the transitive closure of pairs (a, b, rank), by doubling."""

    def least(df: DataFrame) -> DataFrame:
        return df.groupBy("a", "b").agg(F.min(rank).alias(rank))

    now = cut(least(pairs.where("a <> b")))
    n = now.count()
    while n:
        # ranks begin with the length, so that of two ways the shorter is least
        further = now.join(now.select(F.col("a").alias("b"), F.col("b").alias("c"), F.col(rank).alias("then")), "b").where("a <> c")
        joined = F.concat(F.array(F.get(rank, F.lit(0)) + F.get("then", F.lit(0))), F.slice(rank, F.lit(2), F.size(rank)), F.slice("then", F.lit(2), F.size("then")))
        now = cut(least(now.unionByName(further.select("a", F.col("c").alias("b"), joined.alias(rank)))))
        n, before = now.count(), n
        if n == before:
            break
    return now


@dataclass
class Names:
    """tops: file_path, name, info, context of what a file's module scope names; exports: the same of what a file exports."""

    tops: DataFrame
    exports: DataFrame


def alias(file: Column, name: Column) -> Column:
    return F.to_json(F.struct(F.lit("alias").alias("kind"), file.alias("file"), name.alias("name")))


def declared(rows: DataFrame) -> DataFrame:
    """file_path, scope, name, info, n of declarations; what is known of a plain variable or parameter is its type."""
    d = rows.where("what = 'declaration'")
    info = F.when(F.col("owner") != "", symbol(F.col("owner"))).otherwise(F.coalesce("doc", F.lit('{"kind": "unknown", "raw": ""}')))
    order = W.partitionBy("file_path", "scope", "name").orderBy((F.col("owner") == ""), "n")
    d = d.select("file_path", F.col("line").alias("scope"), "name", "owner", "n", info.alias("info")).withColumn("k", F.row_number().over(order))
    return d.where("k = 1").select("file_path", "scope", "name", "info")


def names(rows: DataFrame, homes: DataFrame) -> Names:
    """homes: stem, module_id, module_file."""
    spec = F.get_json_object("doc", "$.spec")
    bound = rows.where("what = 'binding'").select("file_path", "name", F.col("target").alias("origin"), spec.alias("stem")).join(homes, "stem")
    bound = bound.select("file_path", "name", F.when(F.col("origin") == "*", symbol(F.col("module_id"))).otherwise(alias(F.col("module_file"), F.col("origin"))).alias("info"))
    own = declared(rows).where("scope = 0").select("file_path", "name", "info")
    tops = cut(own.unionByName(bound.join(own, ["file_path", "name"], "left_anti")).dropDuplicates(["file_path", "name"]))
    out = rows.where("what = 'export'").select("file_path", "n", "name", "target", spec.alias("stem"))
    local = out.where("stem IS NULL").join(tops.select("file_path", F.col("name").alias("target"), "info"), ["file_path", "target"]).select("file_path", "name", "n", "info")
    away = out.where("stem IS NOT NULL").join(homes, "stem")
    through = away.where("name <> '*'").select("file_path", "name", "n", F.when(F.col("target") == "*", symbol(F.col("module_id"))).otherwise(alias(F.col("module_file"), F.col("target"))).alias("info"))
    first = W.partitionBy("file_path", "name").orderBy("n")
    direct = cut(local.unionByName(through).withColumn("k", F.row_number().over(first)).where("k = 1").select("file_path", "name", "info"))
    stars = closed(away.where("name = '*'").select(F.col("file_path").alias("a"), F.col("module_file").alias("b"), F.array(F.lit(1), "n").alias("rank")), "rank")
    by_star = stars.join(direct.where("name <> 'default'").select(F.col("file_path").alias("b"), "name", "info"), "b").select(F.col("a").alias("file_path"), "name", "info", F.col("b").alias("context"), "rank")
    everything = direct.select("file_path", "name", "info", F.col("file_path").alias("context"), F.array(F.lit(0)).alias("rank")).unionByName(by_star)
    nearest = W.partitionBy("file_path", "name").orderBy("rank", "context")
    everything = cut(everything.withColumn("k", F.row_number().over(nearest)).where("k = 1").select("file_path", "name", "info", "context"))
    exports = cut(_followed(everything))
    to = lambda c: F.get_json_object("info", f"$.{c}")
    plain = tops.where(to("kind") != "alias").withColumn("context", F.col("file_path"))
    aliases = tops.where(to("kind") == "alias").select("file_path", "name", to("file").alias("f"), to("name").alias("m"))
    led = aliases.join(exports.select(F.col("file_path").alias("f"), F.col("name").alias("m"), "info", "context"), ["f", "m"]).select("file_path", "name", "info", "context")
    return Names(cut(plain.select("file_path", "name", "info", "context").unionByName(led)), exports)


def _followed(table: DataFrame) -> DataFrame:
    """The table (file_path, name, info, context) with every alias replaced by what it leads to; aliases that lead nowhere or round in a circle are left out."""
    to = lambda c: F.get_json_object("info", f"$.{c}")
    plain = table.where(to("kind") != "alias")
    links = cut(table.where(to("kind") == "alias").select("file_path", "name", to("file").alias("f"), to("name").alias("m")))
    n = links.count()
    for _ in range(math.ceil(math.log2(n + 1)) if n else 0):
        ahead = links.select(F.col("file_path").alias("f"), F.col("name").alias("m"), F.col("f").alias("f2"), F.col("m").alias("m2"))
        moved = cut(links.join(ahead, ["f", "m"], "left").select("file_path", "name", F.coalesce("f2", "f").alias("f"), F.coalesce("m2", "m").alias("m"), F.col("f2").isNotNull().alias("moved")))
        links = moved.drop("moved")
        if moved.where("moved").isEmpty():
            break
    ends = plain.select(F.col("file_path").alias("f"), F.col("name").alias("m"), "info", "context")
    return plain.unionByName(links.join(ends, ["f", "m"]).select("file_path", "name", "info", "context"))


def bound(uses: DataFrame, rows: DataFrame, found: Names) -> DataFrame:
    """uses (key, file_path, name, scopes) with info and context of what the name stands for at its place; null where nothing declares it."""
    inner = declared(rows).where("scope <> 0").withColumn("context", F.col("file_path"))
    every = inner.unionByName(found.tops.withColumn("scope", F.lit(0)))
    places = uses.select("key", "file_path", "name", F.posexplode("scopes").alias("place", "scope"))
    best = places.join(every, ["file_path", "scope", "name"]).groupBy("key").agg(F.min_by(F.struct("info", "context"), "place").alias("x"))
    return uses.join(best, "key", "left").select(*uses.columns, "x.info", "x.context")


@dataclass
class Lookups:
    table: DataFrame  # space, owner, name, info, context

    def follow(self, paths: DataFrame) -> DataFrame:
        """paths (key, info, context, steps) with what they lead to: key, info, context; info is null where that isn't known."""
        state, ends = cut(paths.select("key", "info", "context", "steps")), []
        table = self.table.select("space", "owner", "name", F.col("info").alias("next"), F.col("context").alias("there"), F.col("steps").alias("first"))
        for _ in range(ROUNDS):
            now = cut(state.select("key", "context", advance("info", "steps", "context").alias("a")).select("key", "context", "a.*"))
            ends.append(now.where("space IS NULL").select("key", "info", "context"))
            asks = now.where("space IS NOT NULL")
            if asks.isEmpty():
                break
            told = asks.join(table, ["space", "owner", "name"], "left")
            # what a type's name stands for takes no step; all others take one, but an expression goes on with its own steps first
            left = F.when(F.col("space") == "base", F.concat(F.coalesce("first", F.array().cast("array<string>")), "steps")).when(F.col("space") == "type", F.col("steps")).otherwise(F.slice("steps", F.lit(2), F.size("steps")))
            state = told.select("key", F.col("next").alias("info"), F.coalesce("there", "context").alias("context"), left.alias("steps"))
        else:
            ends.append(state.select("key", F.lit(None).cast("string").alias("info"), "context"))
        out = ends[0]
        for e in ends[1:]:
            out = out.unionByName(e)
        return cut(out)


def lookups(rows: DataFrame, found: Names, modules: DataFrame, inherits: DataFrame, nodes: DataFrame) -> tuple[Lookups, DataFrame]:
    """All look-ups, and the bases of all paths (key, info, context, steps). inherits: owner, base, k of classes and interfaces that extend; nodes: id, kind, name, file_path."""
    none = F.array().cast("array<string>")
    entry = lambda df, space, owner, name, info, context: df.select(F.lit(space).alias("space"), owner.alias("owner"), name.alias("name"), info.alias("info"), context.alias("context"), none.alias("steps"))
    c, empty = F.col, F.lit("")
    members = rows.where("what = 'member'").select("file_path", "owner", "name", F.when(c("target") != "", symbol(c("target"))).otherwise(c("doc")).alias("info"), "n")
    members = cut(members.withColumn("k", F.row_number().over(W.partitionBy("owner", "name").orderBy("n"))).where("k = 1").select("file_path", "owner", "name", "info"))
    up = closed(inherits.select(c("owner").alias("a"), c("base").alias("b"), F.array(F.lit(1), c("k")).alias("rank")), "rank")
    inherited = up.join(members.withColumnRenamed("owner", "b"), "b").select("file_path", c("a").alias("owner"), "name", "info", "rank")
    every = members.withColumn("rank", F.array(F.lit(0))).unionByName(inherited)
    every = cut(every.withColumn("k", F.row_number().over(W.partitionBy("owner", "name").orderBy("rank"))).where("k = 1"))
    returns = rows.where("what = 'return'").groupBy("owner").agg(F.max_by(F.struct("file_path", "doc"), "n").alias("x")).select("owner", "x.*")
    exported = found.exports.join(modules.select(c("module_file").alias("file_path"), "module_id"), "file_path")
    aliases = rows.where("what = 'alias' AND NOT flag").groupBy("owner").agg(F.max_by(F.struct("file_path", "doc"), "n").alias("x")).select("owner", "x.*")
    ids = nodes.select("id", "kind", c("name").alias("own"))
    typed = found.tops.withColumn("id", F.get_json_object("info", "$.id")).join(ids.where("kind IN ('class', 'interface')"), "id").select("file_path", "name", F.to_json(F.struct(F.lit("instance").alias("kind"), "id", c("own").alias("name"))).alias("info"))
    written = found.tops.withColumn("owner", F.get_json_object("info", "$.id")).join(aliases.select("owner", c("doc").alias("body"), c("file_path").alias("there")), "owner")
    table = entry(every, "member", c("owner"), c("name"), c("info"), c("file_path"))
    for part in (
        entry(every.where(F.get_json_object("info", "$.kind") == "symbol"), "static", c("owner"), c("name"), c("info"), c("file_path")),
        entry(exported, "static", c("module_id"), c("name"), c("info"), c("context")),
        entry(returns, "return", c("owner"), empty, c("doc"), c("file_path")),
        entry(typed, "type", c("file_path"), c("name"), c("info"), c("file_path")),
        entry(written, "type", c("file_path"), c("name"), c("body"), c("there")),
    ):
        table = table.unionByName(part)
    bases = cut(_bases(rows, found, up, ids))
    table = table.unionByName(bases.select(F.lit("base").alias("space"), c("key").alias("owner"), empty.alias("name"), "info", "context", "steps"))
    return Lookups(cut(table.where("info IS NOT NULL"))), bases


def _bases(rows: DataFrame, found: Names, up: DataFrame, ids: DataFrame) -> DataFrame:
    """key, info, context, steps of every path and call: what its base stands for, and the steps after it."""
    c = F.col
    steps = F.from_json(F.get_json_object("doc", "$.steps"), "array<string>")
    scopes = F.from_json(F.get_json_object("doc", "$.scopes"), "array<int>")
    p = rows.where("what = 'path' OR what = 'call'").select(F.when(c("what") == "call", F.concat("file_path", F.lit("!"), c("n").cast("string"))).otherwise(c("name")).alias("key"), "file_path", steps.alias("all"), scopes.alias("scopes")).where(F.size("all") > 0)
    head = F.get("all", F.lit(0))
    p = p.select("key", "file_path", "scopes", F.substring_index(head, ":", 1).alias("op"), F.regexp_replace(head, "^[a-z]+:", "").alias("name"), F.slice("all", F.lit(2), F.size("all")).alias("steps"))
    named = bound(p.where("op IN ('name', 'new')"), rows, found)
    made = named.where("op = 'new'").withColumn("id", F.get_json_object("info", "$.id")).join(ids.where("kind = 'class'"), "id", "left")
    made = made.select("key", F.coalesce(F.when(c("own").isNotNull(), F.to_json(F.struct(F.lit("instance").alias("kind"), "id", c("own").alias("name")))), F.to_json(F.struct(F.lit("reference").alias("kind"), "name", F.array().cast("array<string>").alias("typeArguments")))).alias("info"), F.coalesce("context", "file_path").alias("context"), "steps")
    key = F.concat("file_path", F.lit("#class:"), "name")
    own = p.where("op = 'this'").withColumn("id", key).join(ids, "id").select("key", F.to_json(F.struct(F.lit("instance").alias("kind"), "id", c("own").alias("name"))).alias("info"), c("file_path").alias("context"), "steps")
    above = up.where(F.get("rank", F.lit(0)) == 1).select(c("a").alias("of"), c("b").alias("id")).join(ids, "id").select("of", "id", "own")
    parent = p.where("op = 'super'").withColumn("of", key).join(above, "of").select("key", F.to_json(F.struct(F.lit("instance").alias("kind"), "id", c("own").alias("name"))).alias("info"), c("file_path").alias("context"), "steps")
    given = p.where("op = 'type'").select("key", c("name").alias("info"), c("file_path").alias("context"), "steps")
    return named.where("op = 'name'").select("key", "info", "context", "steps").unionByName(made).unionByName(own).unionByName(parent).unionByName(given)


# types written out


def _inside(t, out: set[str], keys: set[str]) -> None:
    """Names of references and keys of paths in a type or a node's document."""
    if isinstance(t, dict):
        if t.get("kind") == "reference" and "typeArguments" in t:
            out.add(t["name"])
        elif t.get("kind") == "path":
            keys.add(t["key"])
        for v in t.values():
            _inside(v, out, keys)
    elif isinstance(t, list):
        for v in t:
            _inside(v, out, keys)


@F.arrow_udf(T.StructType([T.StructField("names", T.ArrayType(T.StringType())), T.StructField("keys", T.ArrayType(T.StringType()))]))
def inside(info: pa.Array) -> pa.Array:
    a, b = [], []
    for x in info.to_pylist():
        names_, keys = set(), set()
        if x is not None:
            _inside(json.loads(x), names_, keys)
        a.append(sorted(names_))
        b.append(sorted(keys))
    return pa.StructArray.from_arrays([pa.array(a, pa.list_(pa.string())), pa.array(b, pa.list_(pa.string()))], names=["names", "keys"])


class Writer:
    """Writes types out: paths by what they lead to, aliases by what they stand for, the rest by own names."""

    def __init__(self, env: dict[str, str], paths: dict[str, str], keep: bool = False):
        self.env, self.paths, self.keep = env, paths, keep  # keep: paths that aren't told stay

    def type(self, t: dict, file: str, depth: int = 0, hops: int = 0) -> dict:
        kind = t["kind"]
        if kind == "instance":
            return {"kind": "reference", "name": t["name"], "typeArguments": []}
        if kind == "path":
            found = self.paths.get(t["key"])
            if not found and self.keep:
                return t
            return self.type(json.loads(found), file, depth, hops + 1) if found and hops < DEEPEST else {"kind": "unknown", "raw": t["raw"]}
        if depth >= DEEPEST or kind == "symbol":
            return {"kind": "unknown", "raw": t.get("raw") or t.get("name") or ""}
        inner = lambda x: self.type(x, file, depth + 1, hops)
        if kind == "reference":
            found = self.env.get(f"{file}\0{t['name']}")
            if found and not t["typeArguments"]:
                told = json.loads(found)
                if told["info"]["kind"] == "instance":
                    return {**t, "name": told["info"]["name"]}
                if hops < DEEPEST:
                    return self.type(told["info"], told["file"], depth, hops + 1)
                return {"kind": "unknown", "raw": t["name"]}
            name = json.loads(found)["info"]["name"] if found and json.loads(found)["info"]["kind"] == "instance" else t["name"]
            return {**t, "name": name, "typeArguments": [inner(x) for x in t["typeArguments"]]}
        if kind == "union":
            return union([inner(x) for x in t["members"]])
        if kind in ("sum", "either"):
            same = lambda x: self.type(x, file, depth, hops)
            if kind == "either":
                left, right = same(t["left"]), same(t["right"])
                return {**t, "left": left, "right": right} if self.keep and self._open(left, right) else widened(union([*present(left), right]))
            members = [same(x) for x in t["members"]]
            return {**t, "members": members} if self.keep and self._open(*members) else total(members, t["raw"])
        if kind in ("intersection", "tuple"):
            part = "members" if kind == "intersection" else "elements"
            return {**t, part: [inner(x) for x in t[part]]}
        if kind == "array":
            return {**t, "elementType": inner(t["elementType"])}
        if kind == "function":
            return {**t, "parameters": [{**p, "typeInfo": inner(p["typeInfo"])} for p in t["parameters"]], "returnType": inner(t["returnType"])}
        if kind == "object":
            return {**t, "properties": [{**p, "typeInfo": inner(p["typeInfo"])} for p in t["properties"]]}
        return t

    @staticmethod
    def _open(*types: dict) -> bool:
        """Whether paths are left in the types."""
        keys: set[str] = set()
        _inside(list(types), set(), keys)
        return bool(keys)

    def node(self, doc: dict, file: str) -> dict:
        out = dict(doc)
        for part in ("parameters", "properties"):
            if part in out:
                out[part] = [{**p, "typeInfo": self.type(p["typeInfo"], file)} for p in out[part]]
        for part in ("returnType", "typeInfo"):
            if part in out:
                out[part] = self.type(out[part], file)
        if "methods" in out:
            out["methods"] = [self.node(m, file) for m in out["methods"]]
        return out


def _writing(one, keep: bool = False):
    def run(info: pa.Array, file: pa.Array, env: pa.Array, paths: pa.Array) -> pa.Array:
        out = []
        for x, f, e, p in zip(info.to_pylist(), file.to_pylist(), env.to_pylist(), paths.to_pylist(), strict=True):
            out.append(None if x is None else json.dumps(one(Writer(dict(e or ()), dict(p or ()), keep), json.loads(x), f), ensure_ascii=False))
        return pa.array(out, pa.string())

    return F.arrow_udf(run, T.StringType())


written_type = _writing(lambda w, t, f: w.type(t, f))
filled_type = _writing(lambda w, t, f: w.type(t, f), keep=True)
written_node = _writing(lambda w, d, f: w.node(d, f))


def _map(df: DataFrame, by: str, key: Column, value: Column, name: str) -> DataFrame:
    return df.groupBy(by).agg(F.map_from_entries(F.collect_list(F.struct(key, value))).alias(name))


def environments(used: DataFrame, look: Lookups) -> DataFrame:
    """root, env: for each file (root) what the names in used (root, file, name) stand for, and the names in those aliases, DEEPEST levels down; `file, zero, name` -> {info, file}."""
    types = look.table.where("space = 'type'").select(F.col("owner").alias("file"), "name", "info", "context")
    asked = seen = used.distinct()
    parts = []
    for _ in range(DEEPEST):
        told = cut(asked.join(types, ["file", "name"]))
        parts.append(told)
        asked = told.where(F.get_json_object("info", "$.kind") != "instance").select("root", F.col("context").alias("file"), F.explode(inside("info")["names"]).alias("name")).distinct()
        asked = cut(asked.join(seen, ["root", "file", "name"], "left_anti"))
        if asked.isEmpty():
            break
        seen = cut(seen.unionByName(asked))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    value = F.concat(F.lit('{"info": '), F.col("info"), F.lit(', "file": '), F.to_json(F.array("context")).substr(F.lit(2), F.length(F.to_json(F.array("context"))) - 2), F.lit("}"))
    return _map(every, "root", F.concat("file", F.lit("\0"), "name"), value, "env")


def written(nodes: DataFrame, look: Lookups, paths: DataFrame) -> DataFrame:
    """nodes (id, file_path, doc and others) with types written out. paths: key, info, context of followed paths."""
    # a function's name as a value has the function's type; what else only names something has none
    form = F.concat(F.lit('{"kind": "function", "parameters": '), F.get_json_object("doc", "$.parameters"), F.lit(', "returnType": '), F.get_json_object("doc", "$.returnType"), F.lit("}"))
    functions = nodes.where("kind = 'function'").select(F.col("id").alias("of"), form.alias("form"), F.col("file_path").alias("there"))
    names_it = F.get_json_object("info", "$.kind") == "symbol"
    values = paths.where(names_it).withColumn("of", F.get_json_object("info", "$.id")).join(functions, "of").select("key", F.col("form").alias("info"), F.col("there").alias("context"))
    paths = cut(paths.where(~names_it).select("key", "info", "context").unionByName(values))
    used = paths.select(F.col("context").alias("root"), F.col("context").alias("file"), F.explode(inside("info")["names"]).alias("name"))
    used = used.unionByName(nodes.select(F.col("file_path").alias("root"), F.col("file_path").alias("file"), F.explode(inside("doc")["names"]).alias("name")))
    env = cut(environments(used, look))
    told = paths.join(env.withColumnRenamed("root", "context"), "context", "left")
    none = F.lit(None).cast("map<string,string>")
    # the names of an inner path's type are read in that path's own file, before it is put in its place
    for last in (False,) * NESTED + (True,):
        told = cut(told.select("key", "context", "info", "env", inside("info")["keys"].alias("keys")))
        if last or told.where(F.size("keys") > 0).isEmpty():
            break
        ready = told.where(F.size("keys") == 0).select(F.col("key").alias("of"), written_type(F.col("info"), F.col("context"), F.col("env"), none).alias("value"))
        more = _map(told.select("key", F.explode("keys").alias("of")).join(ready, "of"), "key", F.col("of"), F.col("value"), "more")
        told = told.join(more, "key", "left").select("key", "context", "env", F.when(F.col("more").isNotNull(), filled_type("info", "context", "env", "more")).otherwise(F.col("info")).alias("info"))
    told = told.select("key", written_type(F.col("info"), F.col("context"), F.col("env"), none).alias("info"))
    asked = nodes.select("id", F.explode(inside("doc")["keys"]).alias("key")).join(told, "key")
    by_node = _map(asked, "id", F.col("key"), F.col("info"), "paths")
    out = nodes.join(env.withColumnRenamed("root", "file_path"), "file_path", "left").join(by_node, "id", "left")
    doc = F.when(F.col("kind") == "module", F.col("doc")).otherwise(written_node("doc", "file_path", "env", "paths"))
    return out.select(*[doc.alias("doc") if c == "doc" else F.col(c) for c in nodes.columns])
