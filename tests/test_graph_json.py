import json

import pytest

from graphloom.sources import graph_json as G
from graphloom.sources.files import FileError, find_upward, read_config, read_json, read_text, scan, write_json

STRING = {"kind": "primitive", "name": "string"}
TYPES = [
    STRING,
    {"kind": "literal", "value": "a"},
    {"kind": "literal", "value": 1.5},
    {"kind": "literal", "value": True},
    {"kind": "array", "elementType": STRING},
    {"kind": "tuple", "elements": [STRING, STRING]},
    {"kind": "union", "members": [STRING, {"kind": "primitive", "name": "null"}]},
    {"kind": "intersection", "members": [STRING]},
    {"kind": "object", "properties": [{"name": "p", "typeInfo": STRING, "isOptional": True, "isReadonly": False, "jsdoc": "d"}]},
    {"kind": "reference", "name": "Map", "typeArguments": [STRING, STRING]},
    {"kind": "function", "parameters": [{"name": "x", "typeInfo": STRING, "isOptional": False, "isRest": True, "defaultValue": "1"}], "returnType": STRING},
    {"kind": "unknown", "raw": "T[K]"},
]


def document(**more):
    f = {"kind": "function", "id": "a.ts#function:f", "name": "f", "filePath": "a.ts", "line": 1, "column": 1, "isExported": True, "isAsync": False, "parameters": [], "returnType": STRING}
    nodes = {f["id"]: f}
    for i, t in enumerate(TYPES):
        k = f"a.ts#typeAlias:T{i}"
        nodes[k] = {"kind": "typeAlias", "id": k, "name": f"T{i}", "filePath": "a.ts", "line": 2, "column": 3, "isExported": False, "typeInfo": t}
    nodes["a.ts#class:C"] = {"kind": "class", "id": "a.ts#class:C", "name": "C", "filePath": "a.ts", "line": 1, "column": 1, "isExported": True, "superClass": "B", "interfaces": ["I"], "methods": [f], "properties": []}
    nodes["a.ts#interface:I"] = {"kind": "interface", "id": "a.ts#interface:I", "name": "I", "filePath": "a.ts", "line": 1, "column": 1, "isExported": True, "extends": [], "properties": []}
    nodes["a.ts#module:a"] = {"kind": "module", "id": "a.ts#module:a", "name": "a", "filePath": "a.ts", "exports": ["f"]}
    edges = [{"kind": "call", "from": "x", "to": "a.ts#function:f", "line": 4}, {"kind": "import", "from": "a", "to": "b", "importedNames": ["*"], "isTypeOnly": True}, {"kind": "inherits", "from": "a", "to": "b"}, {"kind": "references", "from": "a", "to": "b"}]
    return {"version": "1.0", "generatedAt": "2020-01-01T00:00:00Z", "projectRoot": "/p", "entrypoints": ["a.ts"], "nodes": nodes, "edges": edges} | more


def test_round_trip(spark, tmp_path):
    doc = document()
    path = str(tmp_path / "deep" / "g.json")
    G.write_graph(G.from_text(spark, json.dumps(doc)), path)
    back = G.read_graph(spark, path)
    assert json.loads(G.to_text(back)) == doc
    G.save_tables(back, str(tmp_path / "tables"))
    again = G.load_tables(spark, str(tmp_path / "tables"))
    assert again.edges.where("kind = 'call'").count() == 1 and json.loads(G.to_text(again)) == doc
    assert back.nodes.where("kind = 'class'").first()["names"] == ["I"]


def test_unknown_keys_are_stripped(spark):
    doc = document()
    doc["nodes"]["a.ts#module:a"]["extra"] = 1
    assert "extra" not in json.loads(G.to_text(G.from_text(spark, json.dumps(doc))))["nodes"]["a.ts#module:a"]


@pytest.mark.parametrize("change", [
    lambda d: d["edges"].append({"kind": "call", "from": "a", "to": "b", "line": -1}),
    lambda d: d["edges"].append({"kind": "jumps", "from": "a", "to": "b"}),
    lambda d: d["nodes"]["a.ts#function:f"].pop("returnType"),
    lambda d: d["nodes"]["a.ts#typeAlias:T4"]["typeInfo"].update(elementType={"kind": "primitive", "name": "int"}),
    lambda d: d.pop("version"),
])
def test_bad_documents(spark, change):
    doc = document()
    change(doc)
    with pytest.raises(G.GraphError) as e:
        G.from_text(spark, json.dumps(doc))
    assert e.value.code == "VALIDATION_FAILED" and e.value.problems


def test_codes(spark, tmp_path):
    with pytest.raises(G.GraphError) as e:
        G.from_text(spark, "{")
    assert e.value.code == "SERIALIZE_ERROR"
    with pytest.raises(G.GraphError) as e:
        G.read_graph(spark, str(tmp_path / "none.json"))
    assert e.value.code == "IO_ERROR"


def test_files(spark, tmp_path):
    for p in ("a.ts", "x/b.ts", "x/y/c.ts", "node_modules/d.ts", "e.md"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text(p)
    got = {r["text"] for r in scan(spark, str(tmp_path), (".ts",)).collect()}
    assert got == {"a.ts", "x/b.ts", "x/y/c.ts"}
    assert {r["text"] for r in scan(spark, str(tmp_path), (".ts",), max_depth=1).collect()} == {"a.ts", "x/b.ts"}
    assert find_upward(str(tmp_path / "x/y"), "a.ts") == str(tmp_path / "a.ts") and find_upward(str(tmp_path), "nothing-of-this-name") is None
    write_json(str(tmp_path / "j/k.json"), {"a": 1})
    assert read_json(str(tmp_path / "j/k.json")) == {"a": 1}
    (tmp_path / "c.json").write_text('{ // note\n "a": "//x", /* b */ "l": [1,], }')
    assert read_config(str(tmp_path / "c.json")) == {"a": "//x", "l": [1]}
    for f, code in ((lambda: read_text(str(tmp_path / "none")), "NOT_FOUND"), (lambda: read_json(str(tmp_path / "a.ts")), "PARSE_ERROR")):
        with pytest.raises(FileError) as e:
            f()
        assert e.value.code == code


def test_parts(spark, tmp_path):
    """The document in parts: one JSON document when put together, and the same tables when read, in order; quotes and line ends in keys and texts."""
    nodes = [{"kind": "module", "id": f'm"{k}\n', "name": "n, {x}", "filePath": f"src/{k}.ts", "exports": ["a\nb"]} for k in range(30)]
    edges = [{"kind": "call", "from": nodes[k]["id"], "to": nodes[(k * 7 + 1) % 30]["id"], "line": k} for k in range(30)]
    doc = {"version": "1.0", "generatedAt": "", "projectRoot": "/p", "entrypoints": ["src/3.ts", "src/1.ts"], "nodes": {n["id"]: n for n in nodes}, "edges": edges}
    G.write_parts(G.from_text(spark, json.dumps(doc)), str(tmp_path / "parts"))
    assert json.loads("".join(p.read_text() for p in sorted((tmp_path / "parts").glob("part-*")))) == doc
    back = G.read_parts(spark, str(tmp_path / "parts"))
    assert json.loads(G.to_text(back)) == doc
