"""Keep-first over chunks that come one after another: keys that earlier chunks had are known without reading old rows.

Keys lie in buckets by hash.  A bucket has a Bloom filter, a few bits of which tell that a key
was never accepted; only keys whose bits are all set are looked up, in the key files of the
buckets that they are in.  A chunk writes its new keys, and the filters of the buckets that it
changed, as a new version; a version counts once its ``done`` file is there, so a run that broke
off leaves nothing behind.  All files are Parquet in one folder.

Filters have ``bits`` bits each and are joined by bucket, never collected.  As a bucket fills,
its filter lets more keys through to the look-up: slower, and never wrong.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.operators.reviews import keep_first

BUCKETS, BITS, HASHES = 256, 1 << 20, 4


def _bits(first: np.ndarray, second: np.ndarray, bits: int) -> np.ndarray:
    """The bits of each key, a column for each of ``HASHES``."""
    a, b = first.astype(np.int64).view(np.uint64), second.astype(np.int64).view(np.uint64) | np.uint64(1)
    return np.stack([((a + np.uint64(k) * b) >> np.uint64(11)) % np.uint64(bits) for k in range(HASHES)], axis=1).astype(np.int64)


class AcceptedKeys:
    """The keys accepted so far, in ``folder``, a path that driver and executors share."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = BUCKETS, bits: int = BITS):
        self.spark, self.folder, self.buckets, self.bits = spark, folder.rstrip("/"), buckets, bits

    # -- versions -------------------------------------------------------------------------

    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def versions(self) -> list[str]:
        """Finished versions, oldest first."""
        fs, p = self._fs(f"{self.folder}/done")
        return sorted(f.getPath().getName() for f in fs.listStatus(p)) if fs.exists(p) else []

    def _tables(self, kind: str) -> list[str]:
        """The tables of a kind that have files: a chunk without new keys has no key files."""

        def held(path: str) -> bool:
            fs, p = self._fs(path)
            return any(f.isDirectory() or f.getPath().getName().startswith("part-") for f in fs.listStatus(p))

        return [p for p in (f"{self.folder}/{kind}/{v}" for v in self.versions()) if held(p)]

    # -- admission --------------------------------------------------------------------------

    def _hashed(self, df: DataFrame, key: str) -> DataFrame:
        k = F.col(key).cast("string")
        df = df.withColumns({"__h1": F.xxhash64(k), "__h2": F.xxhash64(F.lit(1), k)})
        return df.withColumn("__bucket", F.pmod("__h1", F.lit(self.buckets)).cast("int"))

    def filters(self) -> DataFrame:
        """bucket, bits of the latest version of each bucket's filter."""
        found = [self.spark.read.parquet(p).withColumn("version", F.lit(n)) for n, p in enumerate(self._tables("filters"))]
        if not found:
            return self.spark.createDataFrame([], "__bucket int, bits binary")
        every = found[0]
        for f in found[1:]:
            every = every.unionByName(f)
        return every.groupBy("__bucket").agg(F.max_by("bits", "version").alias("bits"))

    def admit(self, chunk: DataFrame, key: str, order: Sequence[Column | str]) -> DataFrame:
        """The rows of ``chunk`` whose key no earlier chunk had, the first of each key; they are accepted from now on.

        Null keys are one key.  The result is read from the version's own files.
        """
        version = f"{len(self.versions()):08d}-{uuid.uuid4().hex}"
        first = self._hashed(keep_first(chunk, key, order), key).withColumn("__k", F.col(key).cast("string"))
        asked = self._written(self._maybe(first), f"{self.folder}/asked/{version}")
        maybe, new = asked.where("__maybe"), asked.where("NOT __maybe")
        places = [r[0] for r in maybe.select("__bucket").distinct().collect()]  # at most ``buckets``
        self.looked_up = len(places)
        if places:
            old = [self.spark.read.parquet(p).where(F.col("__bucket").isin(places)) for p in self._tables("keys")]
            known = old[0]
            for o in old[1:]:
                known = known.unionByName(o)
            known = known.select(F.col("__bucket").alias("__b"), F.col("__k").alias("__o"))
            new = new.unionByName(maybe.join(known, (F.col("__bucket") == F.col("__b")) & F.col("__k").eqNullSafe(F.col("__o")), "left_anti"))
        rows = self._written(new.drop("__maybe"), f"{self.folder}/rows/{version}")
        keys = rows.select("__bucket", "__k", "__h1", "__h2")
        keys.repartition("__bucket").write.partitionBy("__bucket").parquet(f"{self.folder}/keys/{version}")
        self._grown(keys).write.parquet(f"{self.folder}/filters/{version}")
        fs, p = self._fs(f"{self.folder}/done/{version}")
        fs.create(p).close()
        return rows.select(chunk.columns)

    def _written(self, df: DataFrame, path: str) -> DataFrame:
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def _maybe(self, rows: DataFrame) -> DataFrame:
        """``rows`` with whether the filter of their bucket lets them through."""
        bits = self.bits
        if not self._tables("filters"):  # the first chunk: nothing to ask, so its rows stay where they are
            return rows.withColumn("__maybe", F.lit(False))

        # a filter goes once to the task of its bucket: keys come as hashes, their rows stay where they are
        rows = rows.withColumn("__id", F.xxhash64("__h1", "__h2"))
        told = rows.select("__id", "__h1", "__h2", "__bucket").distinct()
        grouped = told.withColumn("__bits", F.lit(None).cast("binary")).unionByName(self.filters().select(F.lit(None).cast("long").alias("__id"), F.lit(0).cast("long").alias("__h1"), F.lit(0).cast("long").alias("__h2"), "__bucket", F.col("bits").alias("__bits")))
        grouped = grouped.repartition("__bucket").sortWithinPartitions("__bucket", F.col("__bits").isNull())

        def beside(batches):
            """Keys behind their bucket's filter, which comes first."""
            bucket, mask = None, None
            for b in batches:
                place, ids = b.column("__bucket").to_numpy(), b.column("__id")
                at = _bits(b.column("__h1").fill_null(0).to_numpy(), b.column("__h2").fill_null(0).to_numpy(), bits)
                is_filter, out = ids.is_null().to_numpy(zero_copy_only=False), np.zeros(b.num_rows, bool)
                change = np.flatnonzero((np.diff(place) != 0) | is_filter[1:] | is_filter[:-1]) + 1
                for i, j in zip([0, *change], [*change, len(place)]):
                    if place[i] != bucket:
                        bucket, mask = place[i], None
                    if is_filter[i]:
                        mask = np.frombuffer(b.column("__bits")[int(i)].as_py(), np.uint8)
                    elif mask is not None:
                        x = at[i:j]
                        out[i:j] = ((mask[x >> 3] >> (x & 7).astype(np.uint8)) & 1).all(axis=1)
                keep = pa.array(~is_filter)
                yield pa.RecordBatch.from_arrays([ids.filter(keep), pa.array(out).filter(keep)], names=["__id", "__maybe"])

        answers = grouped.mapInArrow(beside, "__id long, __maybe boolean").groupBy("__id").agg(F.max("__maybe").alias("__maybe"))
        return rows.join(answers, "__id").drop("__id")

    def _grown(self, keys: DataFrame) -> DataFrame:
        """The filters of the buckets of some new keys, with these keys' bits set."""
        bits = self.bits

        def grow(batches):
            bucket, mask = None, None
            for b in batches:
                place = b.column("__bucket").to_numpy()
                at = _bits(b.column("__h1").to_numpy(), b.column("__h2").to_numpy(), bits)
                for i in range(len(place)):
                    if place[i] != bucket:
                        if mask is not None:
                            yield _filter(bucket, mask)
                        bucket, mask = place[i], np.zeros(bits // 8, np.uint8)
                    raw = b.column("__bits")[i].as_py()
                    if raw is not None:
                        mask |= np.frombuffer(raw, np.uint8)
                    else:
                        np.bitwise_or.at(mask, at[i] >> 3, (1 << (at[i] & 7)).astype(np.uint8))
            if mask is not None:
                yield _filter(bucket, mask)

        touched = keys.select("__bucket").distinct()
        old = self.filters().join(touched, "__bucket", "left_semi").select("__bucket", F.lit(0).cast("long").alias("__h1"), F.lit(0).cast("long").alias("__h2"), F.col("bits").alias("__bits"))
        rows = keys.select("__bucket", "__h1", "__h2", F.lit(None).cast("binary").alias("__bits")).unionByName(old)
        return rows.repartition("__bucket").sortWithinPartitions("__bucket").mapInArrow(grow, "__bucket int, bits binary")


def _filter(bucket: int, mask: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([int(bucket)], pa.int32()), pa.array([mask.tobytes()], pa.binary())], names=["__bucket", "bits"])
