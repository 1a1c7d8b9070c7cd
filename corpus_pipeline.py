"""Documents through quality rules, quality classifier, near-duplicate removal and packing.

Each stage reads what the one before it wrote. The first three return the columns of documents and drop rows only; packing returns one row a piece.

Defined results: null and empty texts fail the quality rules and so are in no sequence; a row with a null id passes on its text alone; of repeated rows one is left (near-duplicate
removal); further columns, whatever their names, are kept up to packing and have no effect; without labels the rules keep what passes the base rule and the classifier, whose score then
is 0.5, keeps nothing; an empty table gives no rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from graphloom.llm import ngram_join, packing, quality_model, quality_rules
from graphloom.llm.common import cut, table


def quality_rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep_good(docs, table(spark, sf_dir, "labels"))


def quality_model_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_model.keep_good(docs, table(spark, sf_dir, "labels"))


def ngram_join_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.keep_one(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules_stage),
    ("quality_model", quality_model_stage),
    ("ngram_join", ngram_join_stage),
    ("packing", packing_stage),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; each result is written to the checkpoint folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs if i == 0 else cut(docs), sf_dir)
    return docs
