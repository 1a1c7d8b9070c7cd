"""Files: folder scans, look-ups upwards, typed reads and writes."""

from __future__ import annotations

import json
import os
import posixpath
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

IGNORED = ("node_modules", "dist", ".git", "coverage")


class FileError(Exception):
    """code: NOT_FOUND, PERMISSION_DENIED, PARSE_ERROR, WRITE_ERROR or UNKNOWN."""

    def __init__(self, code: str, path: str):
        super().__init__(f"{code}: {path}")
        self.code, self.path = code, path


def _code(e: OSError, other: str = "UNKNOWN") -> str:
    return "NOT_FOUND" if isinstance(e, FileNotFoundError) else "PERMISSION_DENIED" if isinstance(e, PermissionError) else other


def scan(spark: SparkSession, root: str, extensions: tuple[str, ...] = (), ignore: tuple[str, ...] = IGNORED, max_depth: int | None = None) -> DataFrame:
    """path, text of the files below root; a file at depth d lies in d nested folders."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    files = reader.load(root).select(F.regexp_replace("path", "^file:/*", "/").alias("path"), "content")
    inside = F.split(F.substr("path", F.lit(len(root.rstrip("/")) + 2)), "/")
    keep = ~F.arrays_overlap(inside, F.lit(list(ignore))) if ignore else F.lit(True)
    if extensions:
        keep = keep & F.exists(F.lit(list(extensions)), lambda x: F.col("path").endswith(x))
    if max_depth is not None:
        keep = keep & (F.size(inside) - 1 <= max_depth)
    return files.where(keep).select("path", F.decode("content", "UTF-8").alias("text"))


def find_upward(folder: str, name: str) -> str | None:
    here = os.path.abspath(folder)
    while True:
        path = os.path.join(here, name)
        if os.path.isfile(path):
            return path
        above = os.path.dirname(here)
        if above == here:
            return None
        here = above


def read_text(path: str) -> str:
    try:
        with open(path, encoding="utf-8") as f:
            return f.read()
    except OSError as e:
        raise FileError(_code(e), path) from e


def write_text(path: str, text: str) -> None:
    try:
        os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
        with open(path, "w", encoding="utf-8") as f:
            f.write(text)
    except OSError as e:
        raise FileError(_code(e, "WRITE_ERROR"), path) from e


def read_json(path: str):
    try:
        return json.loads(read_text(path))
    except ValueError as e:
        raise FileError("PARSE_ERROR", path) from e


def write_json(path: str, value) -> None:
    write_text(path, json.dumps(value, indent=2, ensure_ascii=False))


def read_config(path: str) -> dict:
    """JSON that may hold comments and trailing commas."""
    out, text, i = [], read_text(path), 0
    while i < len(text):
        if text[i] == '"':
            j = i + 1
            while j < len(text) and text[j] != '"':
                j += 2 if text[j] == "\\" else 1
            out.append(text[i : j + 1])
            i = j + 1
        elif text.startswith("//", i):
            i = end if (end := text.find("\n", i)) >= 0 else len(text)
        elif text.startswith("/*", i):
            i = end + 2 if (end := text.find("*/", i)) >= 0 else len(text)
        else:
            if text[i] in "}]":  # a comma before it, with only space and comments between, is dropped
                last = next((k for k in range(len(out) - 1, -1, -1) if not out[k].isspace()), -1)
                if last >= 0 and out[last] == ",":
                    del out[last]
            out.append(text[i])
            i += 1
    try:
        return json.loads("".join(out))
    except ValueError as e:
        raise FileError("PARSE_ERROR", path) from e


class ConfigError(Exception):
    """code: TSCONFIG_NOT_FOUND or INVALID_TSCONFIG."""

    def __init__(self, code: str, path: str, reason: str = ""):
        super().__init__(f"{code}: {path} {reason}".rstrip())
        self.code, self.path = code, path


def config_path(root: str, explicit: str | None = None) -> str:
    """The named project configuration, or the nearest tsconfig.json from root upwards."""
    path = os.path.abspath(explicit) if explicit else find_upward(root, "tsconfig.json")
    if path is None or not os.path.isfile(path):
        raise ConfigError("TSCONFIG_NOT_FOUND", path or root)
    return path


def _pattern(glob: str) -> str:
    """A regular expression for a pattern of the configuration: ** is any number of folders, * and ? stay in one name; a folder stands for all below it."""
    glob = posixpath.normpath(glob)
    last = glob.rsplit("/", 1)[-1]
    if "*" not in last and "?" not in last and "." not in last:
        glob += "/**/*"
    out = re.escape(glob).replace(r"\*\*/", r"(?:(?!\.\./)[^/]+/)*").replace(r"\*\*", ".*").replace(r"\*", "[^/]*").replace(r"\?", "[^/]")
    return out


def _base(path: str, name: str) -> str:
    """The file that a configuration extends: by a path, or from a package in the nearest node_modules that has it."""
    folder = os.path.dirname(path)
    if name.startswith((".", "/")):
        tries = [os.path.normpath(os.path.join(folder, name))]
    else:
        tries = []
        while True:
            tries.append(os.path.join(folder, "node_modules", name))
            if os.path.dirname(folder) == folder:
                break
            folder = os.path.dirname(folder)
    for t in tries:
        for found in (t, t + ".json", os.path.join(t, "tsconfig.json")):
            if os.path.isfile(found):
                return found
    raise ConfigError("INVALID_TSCONFIG", path, f"{name} isn't there")


def inherited(path: str, seen: tuple[str, ...] = ()) -> dict[str, tuple[str, object]]:
    """files, include, exclude and outDir, each with the folder of the configuration that says it: its own, else that of the last one it extends that does."""
    path = os.path.abspath(path)
    if path in seen:
        raise ConfigError("INVALID_TSCONFIG", path, "extends itself")
    try:
        config = read_config(path)
    except FileError as e:
        raise ConfigError("INVALID_TSCONFIG", path) from e
    if not isinstance(config, dict):
        raise ConfigError("INVALID_TSCONFIG", path, "an object expected")
    options = config.get("compilerOptions")
    if options is not None and not isinstance(options, dict):
        raise ConfigError("INVALID_TSCONFIG", path, "compilerOptions is an object")
    bases = config.get("extends", [])
    bases = [bases] if isinstance(bases, str) else bases
    lists = {k: config.get(k) for k in ("files", "include", "exclude")}
    if any(v is not None and not (isinstance(v, list) and all(isinstance(x, str) for x in v)) for v in [*lists.values(), bases]):
        raise ConfigError("INVALID_TSCONFIG", path, "extends, files, include and exclude are lists of text")
    out: dict[str, tuple[str, object]] = {}
    for name in bases:
        out |= inherited(_base(path, name), (*seen, path))
    folder, own = os.path.dirname(path), {k: v for k, v in lists.items() if v is not None}
    if isinstance((options or {}).get("outDir"), str):
        own["outDir"] = options["outDir"]
    return out | {k: (folder, v) for k, v in own.items()}


def configured(path: str) -> Callable[[str], bool]:
    """Whether a file (absolute) belongs to the project that the configuration describes: what `files` names, and what `include` matches and `exclude` doesn't; without both, all below it.
    What it doesn't say comes from those that it extends, key by key, and is relative to them."""
    config, here = inherited(path), os.path.dirname(os.path.abspath(path))
    at = lambda k: config[k][0] if k in config else here
    say = lambda k: config[k][1] if k in config else None
    named = {os.path.normpath(os.path.join(at("files"), f)) for f in say("files") or []}
    include = say("include") if "include" in config else [] if "files" in config else ["**/*"]
    out_dir = say("outDir")
    exclude = [(at("exclude"), g) for g in say("exclude")] if "exclude" in config else [(here, g) for g in ("**/node_modules", "**/bower_components", "**/jspm_packages")] + ([(at("outDir"), out_dir)] if out_dir else [])
    wanted = [(at("include"), re.compile(_pattern(g))) for g in include]
    unwanted = [(f, re.compile(_pattern(g))) for f, g in exclude]

    def holds(file: str) -> bool:
        if file in named:
            return True
        inside = lambda globs: any(p.fullmatch(posixpath.relpath(file, f)) for f, p in globs)
        return inside(wanted) and not inside(unwanted)

    return holds
