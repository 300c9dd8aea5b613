"""What several operators of this subpackage share: defined inputs, crc folds, shared-folder tables."""

from __future__ import annotations

import ctypes
import gc
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeline.session import checkpoint_dir

#: Fixed value: a word is a run of anything but space and the control characters 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, directory: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{table}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a fresh one in local mode without it."""
    return checkpoint_dir(spark).rstrip("/")


def table_cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: cuts lineage, survives lost executors.

    The files go when the driver's JVM ends; a caller that is done earlier may drop them.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)
    return spark.read.schema(df.schema).parquet(path)


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; a NULL id counts as the text ''."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts


def with_size(table: DataFrame, row_bytes: int | Column, limit: int = 16 << 20) -> DataFrame:
    """``table`` marked for broadcast if its counted rows come to ``limit`` bytes at most; otherwise as it is."""
    size = table.count() * row_bytes if isinstance(row_bytes, int) else table.agg(F.sum(row_bytes)).first()[0] or 0
    return F.broadcast(table) if size <= limit else table


def release_memory() -> None:
    """Give what a task has freed back to the system: its Python worker lives on beside those of other stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)
