"""Cutting lineage in a folder that all machines share."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def ready(spark: SparkSession) -> str:
    """The shared folder: the cluster's spark.checkpoint.dir, or on a single machine, where it is unset, a folder of one's own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not sc.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            folder = tempfile.mkdtemp(prefix="checkpoints-")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


#: Rows and bytes of an Arrow batch, so that texts in flight stay small beside the heap.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1024", "spark.sql.execution.arrow.maxBytesPerBatch": "4194304"}
DEFAULT_ROWS = "10000"


def small_batches(spark: SparkSession) -> None:
    """Sets the session's Arrow batches to BATCH, unless somebody has chosen another size than Spark's own."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", DEFAULT_ROWS) == DEFAULT_ROWS:
        for k, v in BATCH.items():
            spark.conf.set(k, v)


def stored(df: DataFrame) -> DataFrame:
    """The rows, computed once, and read from a table of one's own in the shared folder from then on; it goes when the session ends, or by ``discard``."""
    spark = df.sparkSession
    small_batches(spark)
    path = f"{ready(spark)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").option("parquet.enable.dictionary", "false").parquet(path)  # most columns are hashes
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    out = spark.read.schema(df.schema).parquet(path)
    out._shelf = at
    return out


def discard(*frames: DataFrame) -> None:
    """Deletes the tables of stored frames that nothing reads any more."""
    for df in frames:
        df._shelf.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(df._shelf, True)


def release(spark: SparkSession) -> None:
    """Lets Spark drop the shuffle files of frames that aren't referred to any more; between the phases of a long job."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def trimmed(batches: Iterable[pa.RecordBatch], lent: Broadcast | None = None) -> Iterator[pa.RecordBatch]:
    """The batches of a worker, which then gives the memory it has freed back to the machine, and the value of ``lent`` with it.

    A worker otherwise keeps a broadcast value until its next task of another stage, also while it is idle and
    others work. The value is read again from the executor's file when a task asks for it.
    """
    yield from batches
    if getattr(lent, "_path", None) is not None:  # with encryption there is no file to read again
        vars(lent).pop("_value", None)
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another C library
        pass


#: Bytes of the other side up to which a join is done without shuffling the large side.
BROADCAST_BYTES = 16 << 20


def join_small(large: DataFrame, small: DataFrame, on: str | list[str], how: str = "inner", row_bytes: Column | int = 48, limit: int = BROADCAST_BYTES) -> DataFrame:
    """A join that broadcasts the stored side ``small`` if its rows, of ``row_bytes`` each, have at most ``limit`` bytes; otherwise both sides are shuffled."""
    size = small.agg(F.sum(row_bytes if isinstance(row_bytes, Column) else F.lit(row_bytes))).first()[0] or 0
    return large.join(F.broadcast(small) if size <= limit else small.hint("merge"), on, how)
