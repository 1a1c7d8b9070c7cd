import base64
import math

from pyspark.sql import functions as F

from graphloom.functions import scalars as S
from graphloom.functions.tokens import djb2


def one(spark, expression):
    return spark.range(1).select(expression).first()[0]


def test_paths(spark):
    is_test = lambda p: one(spark, S.is_test_path(F.lit(p)))
    assert [is_test(p) for p in ("a/x.test.ts", "tests/x.ts", "src/__mocks__/x.ts", "src/contests/x.ts", "latest.ts", "src/spec")] == [True, True, True, False, False, False]
    cat = lambda p: one(spark, S.file_category(F.lit(p)))
    assert [cat(p) for p in ("tests/a.ts", "fixtures/a.ts", "x/__mocks__/a.ts", "latest.ts")] == ["tests", "fixtures", "mocks", None]
    assert one(spark, S.absolute(F.lit("./src/../a.ts"), "/p")) == "/p/a.ts"
    assert [one(spark, f(F.lit("a/b.test.ts"))) for f in (S.dirname, S.basename, S.extname)] == ["a", "b.test.ts", ".ts"]
    assert one(spark, S.is_descendant(F.lit("/p/a/b"), F.lit("/p/a"))) and not one(spark, S.is_descendant(F.lit("/p/ab"), F.lit("/p/a")))


def test_numbers_and_text(spark):
    assert one(spark, S.round2(F.lit(57) / F.lit(200))) == math.floor(57 / 200 * 100 + 0.5) / 100
    assert one(spark, S.ellipsis(F.lit("x" * 81), 80)) == "x" * 77 + "…" and one(spark, S.ellipsis(F.lit("x" * 80), 80)) == "x" * 80
    for text in ("", "a", "hello world", "x" * 300):
        assert one(spark, S.djb2(F.lit(text))) == djb2(text)
    long = "n" * 100
    assert one(spark, S.edge_id(F.lit(long), F.lit("b"))) == base64.urlsafe_b64encode(f"{long}\0b".encode()).decode().rstrip("=")
    assert one(spark, S.escape_dot(F.lit('a"\\\n'))) == 'a\\"\\\\\\n' and one(spark, S.escape_html(F.lit("<&'>"))) == "&lt;&amp;&#39;&gt;"
    assert one(spark, S.escape_script(F.lit("</script>"))) == "<\\/script>"
    assert one(spark, S.pad_start(F.lit("12345"), 4)) == "12345" and one(spark, S.pad_start(F.lit("7"), 4)) == "   7"
    assert one(spark, S.node_label(S.node_id(F.lit("a.ts"), F.lit("function"), F.lit("f")))) == "function:f"
