"""What several operators share: folds, checkpoints, stored tables."""

from __future__ import annotations

import contextlib
import ctypes
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.plans.fixpoint import cut, shared_folder

#: Shuffle files of a query that writes a table are removed when the table is there.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def stored(df: DataFrame) -> tuple[DataFrame, str]:
    """df written as Parquet to the shared folder and read again, and its path; the shuffle files behind it are not kept."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEAN, "false")
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEAN, before)
    return spark.read.schema(df.schema).parquet(path), path


def remove(spark: SparkSession, *paths: str) -> None:
    """Deletes stored tables that nothing reads any more."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)


#: Keys that are broadcast at most.
HOT_KEYS = 20_000


def spread_join(rows: DataFrame, about: DataFrame, key: str, size: str, how: str = "inner") -> DataFrame:
    """rows joined (inner or left) with about, which has one row a key and the number of its rows, and is read more than once. Keys with more than 1 / HOT_KEYS of all rows, fewer than HOT_KEYS whatever
    the input, are broadcast, so their rows stay where they are; the others are shuffled."""
    most = max(1000, int(about.agg(F.sum(size)).first()[0] or 0) // HOT_KEYS)
    hot = F.broadcast(about.where(F.col(size) > most))
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(about.where(F.col(size) <= most), key, how)
    return rows.join(hot, key).unionByName(rest)


#: Ids that are broadcast at most.
MOST_IDS = 1 << 22


def with_ids(rows: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """The rows whose key is among ids; what is computed on them later is computed on these alone. Ids are counted: up to MOST_IDS are broadcast, so that texts stay where they are; more are shuffled."""
    ids = ids.select(key).distinct()
    return rows.join(F.broadcast(ids) if ids.count() <= MOST_IDS else ids, key, "left_semi")


_caches: dict[str, dict] = {}


def worker_cache(owner: str) -> dict:
    """What an operator keeps in a worker from task to task."""
    return _caches.setdefault(owner, {})


def enter(owner: str = "") -> None:
    """Called where a task begins: a worker that served another operator drops what that one kept."""
    for other, cache in _caches.items():
        if other != owner:
            cache.clear()


def frugal(owner: str = "") -> Callable:
    """For functions over batches: others' caches go before a task, freed memory after it."""

    def wrap(run: Callable) -> Callable:
        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            enter(owner)
            yield from run(batches)
            trim()

        return task

    return wrap


def trim() -> None:
    """Gives memory that a worker holds but doesn't use back to the system: freed arrays of many sizes otherwise stay with a worker that is used again."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # no such function outside glibc
        ctypes.CDLL(None).malloc_trim(0)


def free_name(df: DataFrame, name: str) -> str:
    """A column name like `name` that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


__all__ = ["cut", "enter", "fold", "free_name", "frugal", "remove", "spread_join", "stored", "table", "trim", "with_ids", "worker_cache"]
