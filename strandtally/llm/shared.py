"""Where jobs of this subpackage keep intermediate tables.

A step whose result is read more than once, or whose lineage must end, is
written as Parquet below ``spark.checkpoint.dir``: every executor and the
driver see that folder, so a lost executor costs a re-read and nothing else.
"""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


_LIBC = ctypes.CDLL(None)


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a temporary one only where none is set and all tasks run on this machine."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir isn't set: executors need a folder that all of them share")
        where = "file://" + tempfile.mkdtemp(prefix="strandtally-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: With it Spark removes a job's shuffle files when the job ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, name: str, paths: list[str] | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and return the table read back. Its path is added to ``paths``, if given.

    Nothing reads the write's shuffle files afterwards, so they are removed at its end."""
    spark = df.sparkSession
    path = new_path(spark, name)
    if paths is not None:
        paths.append(path)
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Within it tables are written from Arrow batches of that many rows at most, so rows with texts take less memory."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def give_back() -> None:
    """Give memory that is free back to the system: a worker stays for later tasks, beside the executor's own memory."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if hasattr(_LIBC, "malloc_trim"):
        _LIBC.malloc_trim(0)


def remove(paths: list[str]) -> None:
    """Remove stored tables that no later step reads, because all that came of them is stored itself."""
    for path in paths:
        store, at = fs.FileSystem.from_uri(path)
        store.delete_dir(at)
    paths.clear()


def free_prefix(df: DataFrame, start: str = "__own_") -> str:
    """A prefix that no column of ``df`` begins with, whatever case it is written in."""
    taken = [c.lower() for c in df.columns]
    while any(c.startswith(start) for c in taken):
        start = "_" + start
    return start


def partitions_for(df: DataFrame, column: str, bytes_each: int = 128 << 20) -> int:
    """Partitions for a shuffle that carries a text column: by its size, and no fewer than the session's number."""
    whole = df.agg(F.sum(F.octet_length(column))).first()[0] or 0
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-whole // bytes_each))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
