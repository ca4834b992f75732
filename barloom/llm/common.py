"""Shared helpers: reading tables, shared scratch folders, cutting lineage."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Arrow batches to Python workers stay below this size, whatever the length of the texts.
BATCH_BYTES = 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound_batches(spark: SparkSession, most: int = BATCH_BYTES) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(most))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4096")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; where that is unset, a temporary one in local mode only."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = context.getCheckpointDir()
    if not folder:
        if context.master != "local" and not context.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spark-barloom-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what is written there goes when the driver ends, or by remove()."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(lambda: [remove(spark, p) for p in [*_written]])
    _written.append(path)
    return path


_written: list[str] = []


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a scratch path; at the driver's end the session may be gone already."""
    with contextlib.suppress(Exception):
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    _written.remove(path)


def staged(df: DataFrame, name: str) -> DataFrame:
    """df, written as Parquet to the shared folder and read back: lineage ends there and it survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def removed(df: DataFrame) -> None:
    """Deletes the files of a staged table that nothing will read again."""
    remove(df.sparkSession, df._staged_at)


_kept: list[dict] = []


def kept_in_worker() -> dict:
    """A dictionary for what a Python worker keeps from one task to the next; released() empties it."""
    _kept.append({})
    return _kept[-1]


def released() -> None:
    """In a worker: forgets what earlier tasks of other operators kept, and returns its memory to the system."""
    for found in _kept:
        found.clear()
    trimmed()


def trimmed() -> None:
    """In a worker: returns to the system what earlier tasks have freed, which allocators keep otherwise."""
    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc's
        trim(0)


def checkpointed(df: DataFrame) -> DataFrame:
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def fold_of(doc_id, n: int):
    """crc32 of the id as text, modulo n; null ids are in fold null."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % F.lit(n)


def ascii_lower(column):
    """Lower-cases A-Z only."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
