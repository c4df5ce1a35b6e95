"""What the operators of this subpackage share: table reading, durable intermediates and their release."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path
from tempfile import mkdtemp

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of an Arrow batch handed to a Python worker, about: long texts make batches of few rows.
BATCH_BYTES = 2 << 20


def lean() -> None:
    """To be called in a Python worker: from now on large arrays go back to the system when they are freed, rather than stay with a
    worker that is used again."""
    if not getattr(lean, "done", False):
        lean.done = True
        pa.set_memory_pool(pa.system_memory_pool())
        if hasattr(libc := ctypes.CDLL(None), "mallopt"):  # the thresholds of mmap and trim, in glibc
            libc.mallopt(-3, 1 << 20)
            libc.mallopt(-1, 1 << 20)


def trim() -> None:
    """To be called in a Python worker at the end of a task: small freed memory goes back too."""
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, through Spark's reader only (any Hadoop file system)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of BATCH_BYTES at most in this session from now on, so that workers' memory follows neither
    the rows' number nor their length."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def durable_dir(spark: SparkSession) -> str:
    """The folder shared by driver and executors: spark.checkpoint.dir. Where it is unset, a local one if all runs on this machine."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    made = getattr(durable_dir, "made", None)
    if made is None:
        made = durable_dir.made = Path(mkdtemp(prefix="folioforge-")).as_uri()
    return made


@contextmanager
def shuffles_released(spark: SparkSession) -> Iterator[None]:
    """Queries that run inside drop their shuffle files when they end: their results are at rest."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


#: Tables that `durable` has written and `drop` hasn't deleted.
_made: list[str] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Durable tables that are made inside and not dropped there are deleted at the end, also after a failure; the session's size of Arrow batches
    is as before. Results must have been written or collected by then."""
    key, made = "spark.sql.execution.arrow.maxBytesPerBatch", len(_made)
    before = spark.conf.get(key, None)
    try:
        yield
    finally:
        for path in _made[made:]:
            _delete(spark, path)
        del _made[made:]
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def durable(df: DataFrame, tag: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage is cut, and losing executors loses nothing."""
    spark = df.sparkSession
    bounded_batches(spark)
    path = f"{durable_dir(spark)}/folioforge/{tag}-{uuid.uuid4().hex}"
    _made.append(path)
    with shuffles_released(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.folio_path = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete durable tables whose successors are at rest; others (not made by `durable`) are left alone."""
    for df in tables:
        if path := getattr(df, "folio_path", None):
            _delete(df.sparkSession, path)
            if path in _made:
                _made.remove(path)


def text_of(df: DataFrame, text_col: str = "text") -> Column:
    """The text column, null read as the empty text."""
    return F.coalesce(df[text_col].cast("string"), F.lit(""))
