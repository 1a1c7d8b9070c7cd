"""Groups of functions that look like copies: by name, by parameter types and by body."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST = 30
#: Names too common to tell anything.
COMMON_NAMES = ("constructor", "toString", "valueOf", "render", "init", "setup", "teardown", "create", "get", "set", "update", "delete", "close", "open", "run", "start", "stop", "parse", "format", "validate", "serialize", "deserialize", "encode", "decode")
#: Signatures too common to tell anything.
TRIVIAL_SIGNATURES = ("string", "number", "boolean", "void", "null", "undefined", "unknown", "any", "")


def _groups(rows: DataFrame, key: str, match: str, *more) -> DataFrame:
    """match_type, signature, members, files, first_seq of the groups with two members in two files."""
    g = rows.groupBy(F.col(key).alias("signature")).agg(F.count(F.lit(1)).alias("members"), F.count_distinct("file_path").alias("files"), F.min("node_seq").alias("first_seq"), *more)
    return g.where("members >= 2 AND files >= 2").select(F.lit(match).alias("match_type"), "*")


def same_name(functions: DataFrame) -> DataFrame:
    """functions: id, name, file_path, node_seq."""
    return _groups(functions.where(~F.col("name").isin(*COMMON_NAMES)), "name", "identical-name")


def same_signature(functions: DataFrame) -> DataFrame:
    """functions also have signature (canonical parameter types; null without parameters). Groups of one name are same_name's."""
    rows = functions.where(F.col("signature").isNotNull() & ~F.col("signature").isin(*TRIVIAL_SIGNATURES))
    return _groups(rows, "signature", "identical-parameters", F.count_distinct("name").alias("names")).where("names > 1").drop("names")


def same_body(functions: DataFrame, covered: DataFrame) -> DataFrame:
    """functions also have body (structural hash; null for bodies too short). covered: file_path, name of members of other groups; two members at least must not be among them."""
    rows = functions.where("body IS NOT NULL").join(covered.select("file_path", "name").distinct().withColumn("old", F.lit(1)), ["file_path", "name"], "left")
    return _groups(rows, "body", "identical-body", F.count_if(F.col("old").isNull()).alias("novel")).where("novel >= 2").drop("novel")


def members(functions: DataFrame, groups: DataFrame, key: str) -> DataFrame:
    """The functions that a group holds."""
    return functions.join(groups.select(F.col("signature").alias(key)), key, "left_semi")


def duplicates(functions: DataFrame, most: int = MOST) -> DataFrame:
    """All three passes, the largest groups first; equals by pass, then first member."""
    names = same_name(functions)
    signatures = same_signature(functions)
    covered = members(functions, names, "name").select("file_path", "name").unionByName(members(functions, signatures, "signature").select("file_path", "name"))
    bodies = same_body(functions, covered)
    every = names.withColumn("pass", F.lit(1)).unionByName(signatures.withColumn("pass", F.lit(2))).unionByName(bodies.withColumn("pass", F.lit(3)))
    return every.orderBy(F.desc("members"), "pass", "first_seq").limit(most)
