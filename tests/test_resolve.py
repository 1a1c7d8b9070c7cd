"""Scopes, re-exports, receivers and inferred types over a small subject of its own: a workshop that repairs clocks."""

import json

import pytest
from pyspark.sql import functions as F

from graphloom.functions.scopes import ScopeReader, union
from graphloom.functions.tokens import TypeReader, tokens
from graphloom.operators import extract, resolve

FILES = {
    "lib/gear.ts": """
export type Size = 'small' | 'large';
export type Teeth = number;
export type Pair<T> = [T, T];
export interface Shape { teeth: Teeth; size?: Size; next: Shape | null; spin(by: number): Size }
export interface Wheel extends Shape { spokes: number }
export abstract class Part {
  protected label = 'part';
  describe() { return this.label; }
  weigh(scale = 2) { return scale * 3; }
  static count() { return 0; }
}
export class Gear extends Part implements Shape {
  teeth: Teeth = 12;
  readonly axis = 'steel';
  next = null;
  constructor(private maker: Maker, public readonly wheel?: Wheel) { super(); }
  spin(by: number) { return by > 3 ? 'small' : 'large'; }
  describe() { return super.describe() + this.spin(1); }
  owner() { return this.maker; }
  async polish() { await this.weigh(); return this; }
}
export class Maker {
  gears: Gear[] = [];
  make() { const gear = new Gear(this); this.gears.push(gear); return gear; }
  first() { return this.gears[0]; }
}
export function weigh(x: number) { return x; }
export default function build() { return new Maker(); }
function hidden() { return 1; }
""",
    "lib/inner.ts": "export { weigh as measure, Gear, default as start } from './gear';\nexport * from './more';\nimport { hidden2 } from './more';\nexport { hidden2 as shown };\n",
    "lib/more.ts": "export const twice = (n: number) => n * 2;\nexport function hidden2() { return twice(2); }\nexport function measure() { return 0; }\nexport const spare = new Spare();\nclass Spare { turn() { return 'x'; } }\nexport * from './inner';\n",
    "index.ts": "export * from './lib/inner';\nexport * as more from './lib/more';\nexport { start as default } from './lib/inner';\n",
    "app.ts": """
import begin, { measure, Gear as Cog, twice, shown, more, spare } from './index';
import * as all from './index.js';
import type { Shape, Size, Pair } from './lib/gear';
export function weigh() { return measure(1); }
export function shadow(measure: (n: number) => number) { return measure(2); }
export function block() { { const twice = (q: number) => q; twice(1); } return twice(3); }
export function local() { function shown() { return 0; } return shown(); }
export function typed(g: Cog, s: Shape | undefined, list: Cog[], p: Promise<Cog>) { g.describe(); g.weigh(); s?.spin(1); list[0].owner().make(); return g.owner().first().polish(); }
export async function waits(p: Promise<Cog>) { const g = await p; g.polish(); (await g.polish()).spin(2); for (const t of g.owner().gears) t.owner(); }
export const maker = begin();
export const made = maker.make();
function later() { made.spin(3); all.measure(1); more.hidden2(); all.more.twice(1); Cog.count(); spare.turn(); new Cog(maker).weigh(); nowhere(); begin.call(null); }
export function catches() { try { shown(); } catch (shown) { shown(); } }
export function hoisted() { inside(); function inside() { return weigh(); } }
export function wide(this_: Size, both: Size | number, pair: Pair<number>, deep: { a: { b: { c: { d: { e: string } } } } }) { return both; }
export function several(flag: boolean) { if (flag) { return 1; } return; }
export function mixed(flag: boolean) { if (flag) return 'yes'; const f = () => { return 5; }; return f(); }
export const object = () => ({ a: 1, b: 'x', c: [true, false], f(n: number) { return n + 1; }, g: made });
export const arrow = async () => made.teeth;
export function cast(x: unknown) { return x as Size; }
export function logic(a: string | null) { return a ?? 'none'; }
export function test(a: number) { return a > 1 && !a; }
export function text(n: number) { return `a${n}` + n; }
export function ofClass() { return made; }
export function parts() { return made.wheel; }
export function* steps() { yield 1; }
""",
}
A, G, M, I = "app.ts#", "lib/gear.ts#", "lib/more.ts#", "index.ts#"
N, S, B = {"kind": "primitive", "name": "number"}, {"kind": "primitive", "name": "string"}, {"kind": "primitive", "name": "boolean"}


def ref(name, *arguments):
    return {"kind": "reference", "name": name, "typeArguments": list(arguments)}


def literal(*values):
    members = [{"kind": "literal", "value": v} for v in values]
    return members[0] if len(members) == 1 else {"kind": "union", "members": members}


@pytest.fixture(scope="module")
def built(spark):
    files = spark.createDataFrame(list(FILES.items()), "file_path string, text string")
    nodes, edges = extract.graph(files)
    return {r["id"]: json.loads(r["doc"]) for r in nodes.collect()}, [tuple(r) for r in edges.orderBy("edge_seq").select("kind", "src", "dst").collect()]


def calls(built, name):
    return [d for k, s, d in built[1] if k == "call" and s == f"{A}function:{name}"]


def test_calls_by_scope(built):
    assert calls(built, "weigh") == [G + "function:weigh"]  # a two-step re-export under two names, nearer than the one by a star
    assert calls(built, "shadow") == [] and calls(built, "local") == [] and calls(built, "hoisted") == [A + "function:weigh"]
    assert calls(built, "block") == [M + "function:twice"]
    assert calls(built, "catches") == [M + "function:hidden2"]


def test_calls_by_receiver(built):
    g = G + "function:"
    assert calls(built, "typed") == [g + "Gear.describe", g + "Part.weigh", g + "Gear.owner", g + "Maker.make", g + "Gear.owner", g + "Maker.first", g + "Gear.polish"]
    assert calls(built, "waits") == [g + "Gear.polish", g + "Gear.polish", g + "Gear.spin", g + "Gear.owner", g + "Gear.owner"]
    assert calls(built, "later") == [g + "Gear.spin", g + "weigh", M + "function:hidden2", M + "function:twice", g + "Part.count", M + "function:Spare.turn", g + "Part.weigh"]
    inside = {(s, d) for k, s, d in built[1] if k == "call" and s.startswith(G)}
    assert inside == {(g + "Gear.describe", g + "Part.describe"), (g + "Gear.describe", g + "Gear.spin"), (g + "Gear.polish", g + "Part.weigh")}
    assert [(s, d) for k, s, d in built[1] if k == "call" and s == A + "module:app"] == [(A + "module:app", g + "build"), (A + "module:app", g + "Maker.make")]


def test_references_and_heritage(built):
    refs = {(s.split(":")[-1], d) for k, s, d in built[1] if k == "references" and s.startswith(A)}
    assert {d for s, d in refs if s == "typed"} == {G + "class:Gear", G + "interface:Shape"} and {d for s, d in refs if s == "wide"} == {G + "typeAlias:Size", G + "typeAlias:Pair"}
    assert {(s, d) for k, s, d in built[1] if k == "inherits"} == {(G + "interface:Wheel", G + "interface:Shape"), (G + "class:Gear", G + "class:Part"), (G + "class:Gear", G + "interface:Shape")}


def returned(built, name, file=A):
    return built[0][f"{file}function:{name}"]["returnType"]


def test_inferred_returns(built):
    sizes = literal("small", "large")
    assert returned(built, "weigh") == N and returned(built, "Gear.spin", G) == sizes and returned(built, "Part.describe", G) == S and returned(built, "Gear.describe", G) == S
    assert returned(built, "Gear.owner", G) == ref("Maker") and returned(built, "Gear.polish", G) == ref("Promise", ref("Gear")) and returned(built, "Maker.first", G) == ref("Gear")
    assert returned(built, "build", G) == ref("Maker") and returned(built, "typed") == ref("Promise", ref("Gear")) and returned(built, "waits") == ref("Promise", {"kind": "primitive", "name": "void"})
    assert returned(built, "several") == {"kind": "union", "members": [{"kind": "literal", "value": 1}, {"kind": "primitive", "name": "undefined"}]} and returned(built, "mixed")["members"][1] == N
    assert returned(built, "cast") == sizes and returned(built, "logic") == S
    assert returned(built, "text") == S and returned(built, "ofClass") == ref("Gear") and returned(built, "test") == B
    assert returned(built, "arrow") == ref("Promise", N) and returned(built, "steps")["kind"] == "unknown" and returned(built, "parts") == ref("Wheel")
    o = {p["name"]: p["typeInfo"] for p in returned(built, "object")["properties"]}
    assert o["a"] == N and o["b"] == S and o["c"] == {"kind": "array", "elementType": B} and o["f"]["returnType"] == N and o["g"] == ref("Gear")


def test_types_written_out(built):
    p = {x["name"]: x["typeInfo"] for x in built[0][A + "function:wide"]["parameters"]}
    assert p["this_"] == literal("small", "large") and p["both"]["members"] == [*literal("small", "large")["members"], N] and p["pair"] == ref("Pair", N)
    deep = p["deep"]
    for _ in range(4):
        deep = deep["properties"][0]["typeInfo"]
    assert deep["properties"][0]["typeInfo"] == {"kind": "unknown", "raw": "string"}
    assert returned(built, "wide") == p["both"]
    assert [x["typeInfo"] for x in built[0][A + "function:typed"]["parameters"]][:3] == [ref("Gear"), {"kind": "union", "members": [ref("Shape"), {"kind": "primitive", "name": "undefined"}]}, {"kind": "array", "elementType": ref("Gear")}]
    gear = {x["name"]: x["typeInfo"] for x in built[0][G + "class:Gear"]["properties"]}
    assert gear == {"teeth": N, "axis": literal("steel"), "next": {"kind": "primitive", "name": "null"}}
    shape = {x["name"]: x["typeInfo"] for x in built[0][G + "interface:Shape"]["properties"]}
    assert shape["teeth"] == N and shape["size"] == literal("small", "large") and shape["spin"]["returnType"] == literal("small", "large")
    assert built[0][G + "function:Part.weigh"]["parameters"][0]["typeInfo"] == N and built[0][G + "typeAlias:Teeth"]["typeInfo"] == N


def test_functions_as_values(spark):
    files = [("a.ts", "import { f } from './b';\nexport const g = () => f;\nexport const h = () => C;\nclass C {}\n"), ("b.ts", "type T = 1 | 2;\nexport function f(x: T) { return w(x); }\nfunction w(y: T) { return y; }\n")]
    docs = {r["name"]: json.loads(r["doc"]) for r in extract.graph(spark.createDataFrame(files, "file_path string, text string"))[0].collect()}
    assert docs["g"]["returnType"] == {"kind": "function", "parameters": [{"name": "x", "typeInfo": literal(1, 2), "isOptional": False, "isRest": False}], "returnType": literal(1, 2)}
    assert docs["h"]["returnType"] == {"kind": "unknown", "raw": "C"} and docs["f"]["returnType"] == literal(1, 2)


def test_nothing_is_left_unwritten(built):
    assert '"path"' not in json.dumps(built[0]) and '"instance"' not in json.dumps(built[0])


def test_long_chains(spark):
    """A chain of re-exports under changing names, one of stars, circles and recursive types end, in few rounds."""
    n = 17
    files = [(f"c{i}.ts", f"export {{ f{i + 1} as f{i} }} from './c{i + 1}';\nexport * from './s{i}';") for i in range(n)]
    files += [(f"s{i}.ts", f"export * from './s{i + 1}';\nexport * from './s{max(0, i - 1)}';") for i in range(n)]
    files += [(f"c{n}.ts", f"export function f{n}() {{ return 1; }}\nexport type Tree = {{ left: Tree, right?: Tree }};\nexport type Round = Square;\nexport type Square = Round;\nexport function grow(t: Tree, r: Round) {{ return t; }}"), (f"s{n}.ts", "export function deep() { return 2; }"), ("l.ts", "export { a as b, b as a } from './l';\nexport * from './l';"), ("u.ts", "import { f0 } from './c0';\nimport { deep } from './s0';\nimport { a } from './l';\nf0(); deep(); a();")]
    nodes, edges = extract.graph(spark.createDataFrame(files, "file_path string, text string"))
    assert {r["dst"] for r in edges.where("kind = 'call'").collect()} == {f"c{n}.ts#function:f{n}", f"s{n}.ts#function:deep"}
    doc = json.loads(nodes.where(F.col("name") == "grow").first()["doc"])
    assert doc["parameters"][0]["typeInfo"]["kind"] == "object" and doc["parameters"][1]["typeInfo"]["kind"] == "unknown"


@pytest.mark.parametrize(
    ("text", "want"),
    [("1", literal(1)), ("-1", literal(-1)), ("'a'", literal("a")), ("`a`", S), ("true", literal(True)), ("null", {"kind": "primitive", "name": "null"}), ("a > 1", B), ("a * 2", N), ("'a' + b", S), ("1 + 2", N), ("[1, 2]", {"kind": "array", "elementType": N}), ("[]", {"kind": "array", "elementType": {"kind": "primitive", "name": "any"}}),
     ("c ? 1 : 'x'", {"kind": "union", "members": [literal(1), literal("x")]}), ("c ? true : false", B), ("x as Set<string>", ref("Set", S)), ("'a' as const", literal("a")), ("/a+/g", ref("RegExp")), ("typeof x", S), ("!x", B), ("(((2)))", literal(2)), ("{ a: 1 }", {"kind": "object", "properties": [{"name": "a", "typeInfo": N, "isOptional": False, "isReadonly": False}]}),
     ("(a: string, b = 2, ...c) => a.length > b", {"kind": "function", "parameters": [{"name": "a", "typeInfo": S, "isOptional": False, "isRest": False}, {"name": "b", "typeInfo": N, "isOptional": True, "isRest": False, "defaultValue": "2"}, {"name": "c", "typeInfo": {"kind": "array", "elementType": {"kind": "primitive", "name": "any"}}, "isOptional": False, "isRest": True}], "returnType": B})],
)
def test_values(text, want):
    r = extract.FileReader("a.ts", f"const v = {text};\n")
    i = next(k for k, t in enumerate(r.ts) if t.text == "=") + 1
    assert r.scope.value(i, len(r.ts) - 1) == want


def test_unions():
    assert union([literal("a"), S]) == S and union([N, N]) == N and union([literal(True), literal(False), S])["members"] == [S, B]


def test_scope_tree():
    """Scopes lie inside their parents; this is the class of the method around, but not in a plain function."""
    r = extract.FileReader("a.ts", "class A { m(x) { return () => this.n(x); } p = () => this.m(1); q() { function f() { this.m(2); } f(); } }")
    for s in r.scope.scopes:
        assert s.parent < 0 or r.scope.scopes[s.parent].start <= s.start < s.stop <= r.scope.scopes[s.parent].stop
    at = [k for k, t in enumerate(r.ts) if t.text == "this"]
    assert [r.scope.this(k) for k in at] == ["A", "A", ""]
    assert isinstance(r.scope, ScopeReader) and isinstance(r.types, TypeReader) and tokens("")[0] == []


@pytest.mark.parametrize("path", FILES)
def test_incomplete_sources(path):
    for stop in range(0, len(FILES[path]), 3):
        assert extract.FileReader(path, FILES[path][:stop]).read()[0][2] == "node"
    ts, _ = tokens(FILES[path])
    for t in ts[::2]:
        extract.FileReader(path, FILES[path][: t.start] + FILES[path][t.start + len(t.text) :]).read()


def test_closed(spark):
    pairs = spark.createDataFrame([(i, i + 1, [1, 0]) for i in range(33)] + [(0, 20, [1, 1]), (33, 0, [1, 0])], "a int, b int, rank array<int>")
    got = {(r["a"], r["b"]): r["rank"][0] for r in resolve.closed(pairs, "rank").collect()}
    assert got[0, 20] == 1 and got[0, 33] == 14 and got[5, 33] == 28 and got[21, 5] == 18 and len(got) == 34 * 33
