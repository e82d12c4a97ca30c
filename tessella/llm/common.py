"""Shared plumbing of the corpus operators: scratch tables, skew-safe joins, hashing.

Intermediate tables are written as Parquet below ``spark.checkpoint.dir``, the
folder that the driver and all executors share, and read back by path: a lost
executor then costs a task, not the lineage.
"""

from __future__ import annotations

import atexit
import gc
import re
import shutil
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tables of at most so many rows are broadcast after they have been counted.
BROADCAST_ROWS = 50_000
#: A side that is broadcast holds at most so many bytes.
BROADCAST_BYTES = 64 << 20
#: A key with more than 1/HEAVY_KEYS of all rows is heavy; there are fewer than HEAVY_KEYS of them.
HEAVY_KEYS = 1_000


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared scratch folder that the session names; in local mode without one, a temporary folder of this process."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="tessella-")
        atexit.register(shutil.rmtree, path, True)
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_dir(spark)}/tessella/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and return a scan of it."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete what ``materialize`` wrote for ``tables``, once nothing that is still to run reads it."""
    for table in tables:
        jvm = table.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(table._scratch)
        path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished jobs: it does once the driver's garbage has been collected.

    The plans of Python's dead DataFrames are let go by the bridge a moment later.
    """
    for _ in range(3):
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.5)


def fits(table: DataFrame, rows: int, size: int = BROADCAST_BYTES) -> bool:
    """Whether a written table is small enough to be sent to every task: its rows and its bytes are counted."""
    width = F.lit(0)
    for f in table.schema.fields:
        text = f.dataType.simpleString() in ("string", "binary")
        width = width + (F.coalesce(F.octet_length(f.name), F.lit(0)) if text else F.lit(8))
    n, held = table.agg(F.count("*"), F.sum(width)).first()
    return n <= rows and (held or 0) <= size


def lookup_join(rows: DataFrame, table: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """Left join of ``rows`` to ``table`` (one row a key, ``size`` = its number of rows in ``rows``).

    ``table`` must be a written table: it is measured, and broadcast when small.
    Otherwise its heavy keys, of which there can be at most HEAVY_KEYS, are
    broadcast and the light rest is joined by a shuffle, so that no task gets
    more than 1/HEAVY_KEYS of the rows for one key.  Rows with a null key meet
    nothing and are not shuffled.  ``total`` is the number of rows.
    """
    value = table.drop(size)
    if fits(table, BROADCAST_ROWS):
        return rows.join(F.broadcast(value), key, "left")
    bound = max(2, total // HEAVY_KEYS)
    heavy = table.filter(F.col(size) > bound)
    light = value.join(F.broadcast(heavy.select(key)), key, "left_anti")
    keyed = rows.filter(F.col(key).isNotNull())
    flagged = keyed.join(F.broadcast(heavy.select(F.col(key), F.lit(True).alias("_heavy"))), key, "left")
    cold = flagged.filter(F.col("_heavy").isNull()).drop("_heavy").join(light, key, "left")
    hot = flagged.filter(F.col("_heavy")).drop("_heavy").join(F.broadcast(heavy.drop(size)), key)
    none = rows.filter(F.col(key).isNull())
    for f in value.schema.fields:
        if f.name != key:
            none = none.withColumn(f.name, F.lit(None).cast(f.dataType))
    return cold.unionByName(hot).unionByName(none)


def sliced(batches, rows: int):
    """The batches in pieces of at most ``rows`` rows: a kernel's memory then does not hang on the session's Arrow settings."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def trimmed(run, rows: int = 500):
    """``run`` (batches -> batches) over batches of at most ``rows`` rows.

    Afterwards the worker gives its freed memory back: workers outlive their tasks.
    """

    def wrapped(batches):
        try:
            yield from run(sliced(batches, rows))
        finally:
            _trim()

    return wrapped


def _trim() -> None:
    import ctypes

    import pyarrow

    gc.collect()
    pyarrow.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):  # glibc
        libc.malloc_trim(0)


def fold(doc_id, n: int):
    """crc32 of doc_id as text, modulo n; null where doc_id is null."""
    return F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % n


def held_out(doc_id, n: int):
    """Whether the fold of a document is 0; false for a null id, which is in no fold and teaches nothing."""
    return F.coalesce(fold(doc_id, n) == 0, F.lit(False))
