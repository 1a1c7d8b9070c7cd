"""Scalar functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What marks a path as a test's (suffixes, and folder names followed by a separator).
TEST_PATH = r"(?i)(\.(test|spec)\.(ts|tsx|js|jsx)$|(^|[/\\])(tests?|__tests?__|spec|fixtures?|__mocks?__)[/\\])"
#: What makes a path a test's, a fixture's or a mock's; the first match decides.
CATEGORIES = (
    ("tests", r"(?i)(\.(test|spec)\.(ts|tsx|js|jsx)$|(^|[/\\])(tests?|__tests?__|spec)[/\\])"),
    ("fixtures", r"(?i)((^|[/\\])fixtures?[/\\]|\.fixture\.(ts|tsx|js|jsx)$)"),
    ("mocks", r"(?i)((^|[/\\])(__mocks__|mocks?)[/\\]|\.mock\.(ts|tsx|js|jsx)$)"),
)


def is_test_path(path: Column) -> Column:
    return path.rlike(TEST_PATH)


def file_category(path: Column) -> Column:
    """tests, fixtures, mocks or null. A dot in a suffix is a dot."""
    out = F.lit(None).cast("string")
    for name, pattern in reversed(CATEGORIES):
        out = F.when(path.rlike(pattern), F.lit(name)).otherwise(out)
    return out


def round2(x: Column) -> Column:
    """Two decimals, halves upwards."""
    return F.floor(x * 100 + 0.5) / 100


def ellipsis(text: Column, most: int) -> Column:
    """Text of more than `most` characters is cut to most - 3 and an ellipsis."""
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most - 3)), F.lit("…"))).otherwise(text)


def edge_id(src: Column, dst: Column) -> Column:
    """base64url of src, NUL and dst, without padding or line breaks."""
    joined = F.concat(src.cast("string").cast("binary"), F.lit(bytearray(1)), dst.cast("string").cast("binary"))
    return F.translate(F.base64(joined), "+/=\r\n", "-_")


def djb2(text: Column) -> Column:
    """The xor variant over UTF-16 units of the basic plane, as 8 hex digits."""
    units = F.when(F.length(text) > 0, F.split(text, "")).otherwise(F.array().cast("array<string>"))
    h = F.aggregate(units, F.lit(5381).cast("long"), lambda h, c: F.when(c == "", h).otherwise(((h * 33).bitwiseAND(F.lit(4294967295))).bitwiseXOR(F.ascii(c).cast("long"))))
    return F.lower(F.lpad(F.hex(h), 8, "0"))


def pad_start(text: Column, width: int) -> Column:
    """Pads on the left, never cuts."""
    return F.when(F.length(text) < width, F.lpad(text, width, " ")).otherwise(text)


def node_id(path: Column, kind: Column, name: Column) -> Column:
    return F.concat(path, F.lit("#"), kind, F.lit(":"), name)


def node_label(node: Column) -> Column:
    """What follows the last #."""
    return F.substring_index(node, "#", -1)


def escape_dot(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for raw, shown in (('"', '\\"'), ("\r", "\\r"), ("\n", "\\n")):
        out = F.replace(out, F.lit(raw), F.lit(shown))
    return out


def escape_html(text: Column) -> Column:
    out = text
    for raw, shown in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(raw), F.lit(shown))
    return out


def escape_script(text: Column) -> Column:
    """Keeps text from closing a script element."""
    return F.regexp_replace(text, "(?i)</(script)", r"<\\/$1")


def dirname(path: Column) -> Column:
    return F.when(path.contains("/"), F.regexp_extract(path, r"^(.*?)/+[^/]*/*$", 1)).otherwise(F.lit("."))


def basename(path: Column, suffix: str = "") -> Column:
    name = F.regexp_extract(path, r"([^/]*)/*$", 1)
    return F.when(name.endswith(suffix) & (name != suffix), F.left(name, F.length(name) - len(suffix))).otherwise(name) if suffix else name


def extname(path: Column) -> Column:
    return F.regexp_extract(path, r"[^/.][^/]*?(\.[^./]*)$", 1)


def normalized(path: Column) -> Column:
    """Without empty and '.' segments; '..' removes the segment before it."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    kept = F.aggregate(parts, F.array().cast("array<string>"), lambda a, p: F.when((p == "..") & (F.size(a) > 0) & (F.element_at(a, -1) != ".."), F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(p))))
    return F.concat(F.when(path.startswith("/"), F.lit("/")).otherwise(F.lit("")), F.array_join(kept, "/"))


def absolute(path: Column, root: str) -> Column:
    return normalized(F.when(path.startswith("/"), path).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), path)))


def is_descendant(path: Column, root: Column) -> Column:
    a, b = normalized(path), normalized(root)
    return (a == b) | a.startswith(F.concat(F.regexp_replace(b, "/$", ""), F.lit("/")))
