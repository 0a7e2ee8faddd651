"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import re
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_path(spark: SparkSession, what: str) -> str:
    """A fresh path in the folder that the driver and all executors share (spark.checkpoint.dir)."""
    return f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}"


def shared_folder(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir.  Where it is unset, a folder in /tmp will do if all runs on this machine, as in tests; else no folder is known to be shared."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file:///tmp/checkpoints"
    return folder.rstrip("/")


#: Bytes of an Arrow batch: texts may be long, and a batch is held by the JVM and by Python.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Bound the session's Arrow batches, where Spark's default (64 MB) holds."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key).rstrip("bB") == str(64 << 20):
        spark.conf.set(key, str(BATCH_BYTES))


def staged(df: DataFrame, what: str, held: list[str] | None = None) -> DataFrame:
    """``df`` written to the shared folder and read back: its lineage ends at files that outlive any executor.

    The files go when the session's JVM ends, or by ``drop`` of the paths that ``held`` collects.
    """
    path = shared_path(df.sparkSession, what)
    df.write.parquet(path)
    fs, p = _file(df.sparkSession, path)
    fs.deleteOnExit(p)
    if held is not None:
        held.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(spark: SparkSession, held: list[str]) -> None:
    """Delete tables that ``staged`` wrote and nothing reads any more."""
    while held:
        fs, p = _file(spark, held.pop())
        fs.delete(p, True)


def _file(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


#: Bytes that a task of a range-partitioned write is to read.
TASK_BYTES = 64 << 20


def tasks_for(spark: SparkSession, size: int | None) -> int:
    """Into how many tasks so many bytes are dealt: no fewer than the session's shuffle partitions."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(size or 0) // TASK_BYTES))


#: A key is hot from so large a share of the rows on: no more than so many keys can be.
HOT_KEYS = 256


def join_back(rows: DataFrame, per_key: DataFrame, key: str, *, spread: str) -> DataFrame:
    """``rows`` with the columns of ``per_key``, which has a row for each of their keys (nulls are one key) and the key's number of rows, ``n``.

    Rows of hot keys are dealt out by the hash of their ``spread`` column, and those keys' results are
    copied as often.  Hot keys are ``HOT_KEYS`` at most, so the table that tells them is broadcast whatever the input.
    """
    total = per_key.agg(F.sum("n")).first()[0] or 0
    deals = F.ceil(F.col("n") * HOT_KEYS / total) if total else F.lit(1)
    hot = per_key.where(F.col("n") * HOT_KEYS >= total).groupBy(F.xxhash64(key).alias("hot_")).agg(F.max(deals).cast("int").alias("deals_"))
    told = lambda df: df.join(F.broadcast(hot), F.xxhash64(df[key]) == F.col("hot_"), "left").withColumn("deals_", F.coalesce("deals_", F.lit(1))).drop("hot_")
    left = told(rows).withColumn("deal_", F.pmod(F.xxhash64(spread), "deals_").cast("int")).drop("deals_")
    right = told(per_key.drop("n")).withColumn("deal_", F.explode(F.sequence(F.lit(0), F.col("deals_") - 1))).select(F.col(key).alias("key_"), F.col("deal_").alias("other_"), *(c for c in per_key.columns if c not in (key, "n")))
    return left.join(right, left[key].eqNullSafe(right["key_"]) & (F.col("deal_") == F.col("other_")), "left").drop("deal_", "key_", "other_")


def per_batch(f: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]):
    """A function for mapInArrow from one on batches; what a task has freed goes back to the system at its end."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield from f(batch)
        release()

    return run


def release() -> None:
    """Give freed memory back: workers live on between tasks, and their heaps would keep the largest task's size."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def fresh_name(df: DataFrame, name: str) -> str:
    """A prefix that no column of ``df`` begins with."""
    while any(c.lower().startswith(name) for c in df.columns):
        name += "_"
    return name


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return df.select(*columns) if columns else df
