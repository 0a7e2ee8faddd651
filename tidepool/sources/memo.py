"""Scores kept by key: what was scored before is read, the rest is scored and added.

The table lies in buckets by the hash of its keys, as partitions of Parquet files, so a look-up
reads the buckets that its keys are in.  Runs are added as versions (see ``accepted``): scores
of a run that broke off are not seen.  Of a key scored twice, by runs at the same time, the
earlier version counts.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BUCKETS = 256


class ScoreMemo:
    """Scores by ``keys`` in ``folder``, a path that driver and executors share."""

    def __init__(self, spark: SparkSession, folder: str, keys: Sequence[str], buckets: int = BUCKETS):
        self.spark, self.folder, self.keys, self.buckets = spark, folder.rstrip("/"), list(keys), buckets

    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _versions(self) -> list[str]:
        fs, p = self._fs(f"{self.folder}/done")
        return sorted(f.getPath().getName() for f in fs.listStatus(p)) if fs.exists(p) else []

    def _held(self, path: str) -> bool:
        """Whether a table has files: one without rows, in partitions, has none, and no schema."""
        fs, p = self._fs(path)
        return any(f.isDirectory() for f in fs.listStatus(p))

    def _bucket(self):
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def known(self, buckets: list[int] | None = None) -> DataFrame | None:
        """What is kept, one version's rows for each key; of some buckets only, if they are named."""
        every = None
        for n, v in enumerate(self._versions()):
            if not self._held(f"{self.folder}/scores/{v}"):
                continue
            rows = self.spark.read.parquet(f"{self.folder}/scores/{v}")
            rows = (rows if buckets is None else rows.where(F.col("__bucket").isin(buckets))).withColumn("__version", F.lit(n))
            every = rows if every is None else every.unionByName(rows)
        if every is None:
            return None
        first = F.min("__version").over(Window.partitionBy("__bucket", *self.keys))
        return every.withColumn("__first", first).where("__version = __first").drop("__version", "__first")

    def scores(self, wanted: DataFrame, score: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """The score rows of the keys of ``wanted``; ``score`` (a frame of distinct keys to rows with these keys) gets only keys that are not kept.

        A key may have several rows, or none: it counts as scored.  Null keys are keys too.
        """
        asked = wanted.select(*self.keys).distinct().withColumn("__bucket", self._bucket())
        touched = [r[0] for r in asked.select("__bucket").distinct().collect()]  # at most ``buckets``
        done = self._keys(touched)
        same = lambda a, b: [a[k].eqNullSafe(b[k]) for k in self.keys]
        todo = asked if done is None else asked.join(done, same(asked, done), "left_anti")
        version = f"{len(self._versions()):08d}-{uuid.uuid4().hex}"
        todo.write.partitionBy("__bucket").parquet(f"{self.folder}/keys/{version}")
        todo = self.spark.read.schema(asked.schema).parquet(f"{self.folder}/keys/{version}")
        self.n_scored = todo.count()
        if self.n_scored:
            score(todo.drop("__bucket")).withColumn("__bucket", self._bucket()).repartition("__bucket").write.partitionBy("__bucket").parquet(f"{self.folder}/scores/{version}")
            fs, p = self._fs(f"{self.folder}/done/{version}")
            fs.create(p).close()
        held = self.known(touched)
        if held is None:
            raise ValueError("nothing was asked for, and nothing is kept")
        return held.join(asked.drop("__bucket"), same(held, asked), "left_semi").drop("__bucket")

    def _keys(self, buckets: list[int]) -> DataFrame | None:
        every = None
        for v in self._versions():
            rows = self.spark.read.parquet(f"{self.folder}/keys/{v}").where(F.col("__bucket").isin(buckets)).select(*self.keys)
            every = rows if every is None else every.unionByName(rows)
        return every
