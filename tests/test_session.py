import json

import pytest

from graphloom import __main__ as cli
from graphloom.operators import duplicates
from graphloom.session import GraphSession
from graphloom.sources import files
from tests.test_extract import FILES

TWIN = "export function depthOf(berth: string, draught: number): number {\n  const left = find(berth).depth - draught;\n  return left;\n}\nfunction find(code: string) { return null as any; }\n"


@pytest.fixture(scope="module")
def project(tmp_path_factory):
    root = tmp_path_factory.mktemp("project")
    for path, text in {**FILES, "src/a.ts": TWIN, "src/b.ts": TWIN.replace("left", "rest"), "tsconfig.json": '{ // sources\n "include": ["src"], }'}.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(text)
    (root / "src/ledger.d.ts").write_text("export declare function no(): void;")
    return root


def test_session(spark, project, tmp_path):
    out = str(tmp_path / "graph.json")
    assert cli.main(["analyze", str(project), "--output", out, "--entrypoint", "src/harbour.ts"]) == 0
    doc = json.load(open(out))
    assert doc["entrypoints"] == ["src/harbour.ts"] and len([e for e in doc["edges"] if e["kind"] == "import"]) == 3
    with GraphSession.read(spark, out) as s:
        assert s.stats().first()["class_count"] == 2
        left = "src/ledger.ts#function:clearance"
        form = s.form(left)
        assert [(f["kind"], f["required"]) for f in form["fields"]] == [("text", True), ("number", True)]
        with pytest.raises(LookupError):
            s.form("src/ledger.ts#module:ledger")
        paths = {r["path"] for r in s.call_paths(left).collect()}
        assert f"src/harbour.ts#module:harbour>src/harbour.ts#function:start>src/harbour.ts#function:Harbour.moor>{left}" in paths
        around = {r["src"]: r["context"] for r in s.node_edges(left).where("kind = 'call' AND direction = 'in'").collect()}
        moor = around["src/harbour.ts#function:Harbour.moor"]
        assert any("depthLeft(b, draught)" in x["content"] for x in moor) and 4 <= len(moor) <= 7
        for missing in (lambda: s.edges_between(left, left), lambda: s.node_edges("nothing")):
            with pytest.raises(LookupError):
                missing()
        assert [r["content"] for r in s.source("src/ledger.ts", 2, 1).orderBy("line").collect()] == FILES["src/ledger.ts"].split("\n")[:3]
        with pytest.raises(PermissionError):
            s.source("../graph.json", 1)
        dot = s.dot()
        assert dot.startswith("digraph G {") and 'label="Entrypoint"' in dot and "weight=4, style=solid" in dot and 'label="default, fee, depthLeft"' in dot and "style=dotted" in dot
        copies = {(r["match_type"], r["signature"]) for r in duplicates.duplicates(s.functions()).collect()}
        assert ("identical-name", "depthOf") in copies and ("identical-name", "find") in copies
        f = {r["id"]: r for r in s.functions().collect()}
        assert f["src/a.ts#function:depthOf"]["body"] == f["src/b.ts#function:depthOf"]["body"] != f["src/a.ts#function:find"]["body"] and f["src/a.ts#function:depthOf"]["signature"] == "string, number"
        assert f["src/harbour.ts#function:start"]["signature"] is None and s.problems().count() == 0
    assert cli.main(["architect", out, "--output", str(tmp_path / "r.md"), "--no-cycles", "--fan-in", "1", "--fan-out", "1"]) == 0
    text = (tmp_path / "r.md").read_text()
    assert text.startswith("# Graph report") and "sailings" in text and "## Unreached code" in text and "## Copies" in text and "depthOf" in text and "→" in text
    assert cli.main(["architect", str(tmp_path / "none.json")]) == 1


def test_configuration(project, tmp_path):
    def holds(config, *names):
        (tmp_path / "tsconfig.json").write_text(config)
        h = files.configured(files.config_path(str(tmp_path / "deep/er")))
        return [h(str(tmp_path / n)) for n in names]

    (tmp_path / "deep/er").mkdir(parents=True)
    assert holds("{}", "a.ts", "x/b.ts", "node_modules/c.ts", "x/node_modules/y/c.ts") == [True, True, False, False]
    assert holds('{"include": ["src/**/*.ts", "lib"], "exclude": ["**/*.spec.ts"]}', "src/a.ts", "src/b/c.ts", "src/b/c.spec.ts", "lib/q/r.ts", "other/a.ts") == [True, True, False, True, False]
    assert holds('{"files": ["main.ts"], /* only */}', "main.ts", "other.ts") == [True, False]
    assert holds('{"compilerOptions": {"outDir": "./out"}}', "out/a.ts", "a.ts") == [False, True]
    (tmp_path / "base.json").write_text('{"include": ["one"]}')
    assert holds('{"extends": "./base"}', "one/a.ts", "two/a.ts") == [True, False]
    for bad in ("{", '{"include": "src"}', '{"extends": "./none"}'):
        with pytest.raises(files.ConfigError, match="INVALID_TSCONFIG"):
            holds(bad, "a.ts")
    with pytest.raises(files.ConfigError, match="TSCONFIG_NOT_FOUND"):
        files.config_path(str(tmp_path), str(tmp_path / "nothing.json"))


def test_entrypoints_of_a_project(spark, project, tmp_path):
    with GraphSession.scan(spark, str(project)) as s:
        assert sorted(r["path"] for r in s.entrypoints.collect()) == ["src/a.ts", "src/b.ts", "src/berth.ts", "src/harbour.ts", "src/ledger.ts"]
    only = tmp_path / "only.json"
    only.write_text(json.dumps({"files": [str(project / "src/berth.ts")]}))
    with GraphSession.scan(spark, str(project), config=str(only)) as s:
        assert [r["path"] for r in s.entrypoints.collect()] == ["src/berth.ts"]
