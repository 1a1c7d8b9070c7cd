"""Project configurations: what they extend, what they inherit, and what is wrong with them."""

import json
import os

import pytest

from graphloom.sources import files


def put(folder, name, value):
    path = os.path.join(folder, name)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(value if isinstance(value, str) else json.dumps(value))
    return path


def test_inherited_key_by_key(tmp_path):
    root = str(tmp_path)
    put(root, "base/one.json", {"include": ["../lib/**/*.ts"], "exclude": ["../lib/old"], "compilerOptions": {"outDir": "../built"}})
    put(root, "base/two.json", {"include": ["../src"]})
    put(root, "node_modules/@shop/config/tsconfig.json", {"files": ["extra.ts"]})
    path = put(root, "app/tsconfig.json", "{ // of the shop\n \"extends\": [\"../base/one\", \"../base/two.json\", \"@shop/config\"], /* nothing else, */ }")
    holds = files.configured(path)
    inside = lambda name: holds(os.path.join(root, name))
    assert inside("src/a/b.ts") and not inside("lib/a.ts") and not inside("lib/old/a.ts") and inside("node_modules/@shop/config/extra.ts") and not inside("app/a.ts")
    assert files.inherited(path)["exclude"] == (os.path.join(root, "base"), ["../lib/old"])
    plain = files.configured(put(root, "plain/tsconfig.json", {"extends": "../base/one.json", "include": ["**/*"], "exclude": []}))
    assert plain(os.path.join(root, "plain/x/y.ts")) and not plain(os.path.join(root, "lib/a.ts"))


@pytest.mark.parametrize("value", ["[]", "1", "{", '{"include": "src"}', '{"files": [1]}', '{"extends": [1]}', '{"extends": {}}', '{"extends": "./none"}', '{"extends": "none"}', '{"extends": "./tsconfig.json"}', '{"compilerOptions": []}'])
def test_invalid(tmp_path, value):
    path = put(str(tmp_path), "tsconfig.json", value)
    with pytest.raises(files.ConfigError) as e:
        files.configured(path)
    assert e.value.code == "INVALID_TSCONFIG"


def test_circle_and_missing(tmp_path):
    put(str(tmp_path), "a.json", {"extends": "./b.json"})
    put(str(tmp_path), "b.json", {"extends": "./a.json"})
    with pytest.raises(files.ConfigError) as e:
        files.configured(str(tmp_path / "a.json"))
    assert e.value.code == "INVALID_TSCONFIG"
    with pytest.raises(files.ConfigError) as e:
        files.config_path(str(tmp_path), str(tmp_path / "none.json"))
    assert e.value.code == "TSCONFIG_NOT_FOUND"


def test_comments_in_linear_time(tmp_path):
    path = put(str(tmp_path), "tsconfig.json", "{" + "// one\n/* two */" * 100_000 + '"include": ["src",],}')
    assert files.read_config(path) == {"include": ["src"]}
