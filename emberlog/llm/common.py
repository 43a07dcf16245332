"""Pieces that several training-data operators share."""

from __future__ import annotations

import ctypes
import gc
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, suppress

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z alone. Texts of ASCII only take the cheaper built-in."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, LOWER)
    )


def row_key(doc_id: str, text: str) -> list[Column]:
    """Content-based key of a row: rows with an equal key have equal id and text, so equal results.

    The id part is never null, so that the key can be an equi-join key.
    """
    return [
        F.coalesce(F.col(doc_id).cast("string"), F.lit("\0")).alias("k_id"),
        F.xxhash64(F.col(text)).alias("k_hash"),
    ]


def _one_process(spark: SparkSession) -> bool:
    return spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local"


def scratch_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share.

    A session that leaves it unset gets a machine-local one only in local mode, where driver and executors are one
    process; on a cluster executors would not see one another's files, so that is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not _one_process(spark):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = f"file:///tmp/checkpoints/emberlog-{spark.sparkContext.applicationId}"
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Writes df to the shared folder and reads it again: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/emberlog/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def discard(*frames: DataFrame) -> None:
    """Deletes tables of materialize() that no later plan reads."""
    for df in frames:
        path = getattr(df, "_scratch_path", None)
        if path:
            jvm = df.sparkSession._jvm
            hadoop = jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(hadoop, True)


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of plans that nothing refers to any more.

    It does so when the driver's heap is collected, which a driver that only plans rarely is; between the phases
    of an operator, whose results are written out, the files of a phase would otherwise stay beside the next one's.
    """
    for _ in range(2):  # the first finds what the second's queue then deletes
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.4)


def shrink_executors(spark: SparkSession) -> None:
    """Lets executors give the free part of their heaps back to the machine, before a phase whose Python workers need room.

    A heap that has grown in one phase stays as large beside the workers of the next one; only full collections shrink it,
    and the first of two leaves half of it. As many tasks as there are cores reach every executor that is idle; one that
    gets none merely keeps its heap. Where driver and executors are one process, nothing is done.
    """
    cores = spark.sparkContext.defaultParallelism
    for _ in range(0 if _one_process(spark) else 2):
        spark.range(0, cores, 1, cores).select(F.expr("java_method('java.lang.System', 'gc')")).collect()


@contextmanager
def small_batches(spark: SparkSession, rows: int = 2000) -> Iterator[None]:
    """Arrow batches of fewer rows for what is written inside: a batch of long texts is held by the JVM and by Python."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, min(int(before), rows) if int(before) > 0 else rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def tidy(batches: Iterator) -> Iterator:
    """The batches; after the last one, memory that the Python worker has freed goes back to the machine."""
    yield from batches
    trim()


def trim() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL("libc.so.6").malloc_trim(0)


#: Most keys of a broadcast filter (a few tens of MB at most); more are joined by shuffle.
BROADCAST_KEYS = 300_000


def filtered_by_keys(df: DataFrame, keys: DataFrame, on: list[str], how: str, most: int = BROADCAST_KEYS) -> DataFrame:
    """df joined left_semi or left_anti with written-out keys: broadcast up to `most`, else by shuffle."""
    if keys.count() <= most:
        keys = F.broadcast(keys)
    return df.join(keys, on, how)


_CACHES: dict = {}


def worker_cache(owner: str, cache):
    """Registers an operator's cache in a Python worker and empties what others, or its own earlier tasks, left there.

    Workers live on through a job of several operators, and each operator's cache would stay beside the next one's.
    """
    for other in [o for o, c in _CACHES.items() if c is not cache]:
        _CACHES.pop(other).clear()
    _CACHES[owner] = cache
    return cache


def word_array(text: Column, separators: str) -> Column:
    """Words of a text as an array: maximal runs outside the Java character class `separators`."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"[{separators}]+"), "")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
