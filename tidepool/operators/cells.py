"""An index of a vector collection: cells around centroids, files by cell, queries that read the cells near them.

The centroids are those of k-means on a bounded sample (``SAMPLE`` rows, those whose ids hash
lowest); every row is indexed, in the cell of the centroid nearest by cosine, and the table is
written partitioned by cell, large cells as several files.  A search reads the partitions of the
cells that some query probes and no others, and scores exactly; with as many probes as cells, it
is the exact search, which goes by blocks of any cells' items: a query is sent once a block, not once a
cell.  Within a cell, blocks of items meet slices of queries, so a cell that holds a large part of all
rows is no single task.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.functions import vectors as V
from tidepool.functions.columns import named
from tidepool.functions.hashing import stable_uniform
from tidepool.operators.pruned import AT_ONCE, SLACK, Best, _own
from tidepool.operators.retrieval import CATALOG_CELLS, SLICE_QUERIES, _matrix, best_of_block, best_of_rows
from tidepool.operators.windows import ranked

SAMPLE, MOST_CELLS, SEED = 50_000, 4096, 2026
#: The exact search: tasks that it is dealt into at least, and the least and most queries of one.
TASKS, LEAST_SLICE, MOST_SLICE = 24, 256, 16_384


def nearest_cells(vectors: np.ndarray, centres: np.ndarray, probes: int) -> np.ndarray:
    """The numbers of the ``probes`` centroids of the largest cosine to each vector, best first, ties to the lower number."""
    return np.argsort(-np.round(vectors @ centres.T, 12), axis=1, kind="stable")[:, :probes]


def build_index(df: DataFrame, path: str, item: str, vector: str, n_cells: int | None = None, sample: int = SAMPLE, rounds: int = 10) -> int:
    """Write the index of ``df`` (item, vector and what else it has) to ``path``; returns the number of cells.

    Rows whose vector is null or of length zero are in the cell 0, so they are found only as the exact search finds them.
    """
    spark = df.sparkSession
    rows = df.withColumn("__u", V.unit(named(vector)))
    n = n_cells or min(MOST_CELLS, max(1, math.isqrt(df.count())))
    some = rows.where(F.col("__u").isNotNull() & (V.norm(F.col("__u")) > 0.5)).orderBy(stable_uniform(SEED, "cells", named(item)), named(item)).limit(sample)
    model = KMeans(k=n, seed=SEED, maxIter=rounds, featuresCol="f").fit(some.select(array_to_vector("__u").alias("f")).repartition(1)) if n > 1 else None
    centres = np.array(model.clusterCenters()) if model else np.array([some.first()["__u"]])
    centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
    shared, names = spark.sparkContext.broadcast(centres), df.columns  # MOST_CELLS rows

    def place(batches):
        for b in batches:
            cell = np.zeros(b.num_rows, np.int32)
            u = b.column("__u")
            held = np.flatnonzero(u.is_valid().to_numpy(zero_copy_only=False))
            if len(held):
                cell[held] = nearest_cells(_matrix(u.take(pa.array(held))), shared.value, 1)[:, 0]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(cell)], names=[*names, "cell"])

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + ", cell int"
    placed = rows.mapInArrow(place, ddl).hint("rebalance", "cell")  # adaptive execution splits large cells
    placed.write.partitionBy("cell").mode("overwrite").parquet(f"{path}/vectors")
    sizes = spark.read.parquet(f"{path}/vectors").groupBy("cell").count().collect()  # a row per cell
    count = {r["cell"]: r["count"] for r in sizes}
    meta = [(i, c.tolist(), count.get(i, 0)) for i, c in enumerate(centres)]
    spark.createDataFrame(meta, "cell int, centre array<double>, n long").coalesce(1).write.mode("overwrite").parquet(f"{path}/cells")
    return len(centres)


def probed(spark: SparkSession, path: str, queries: DataFrame, query: str, item: str, probes: int, own: str | None = None) -> DataFrame:
    """A row per query and cell that it probes: __q, __own, __v, cell."""
    cells = spark.read.parquet(f"{path}/cells").orderBy("cell").collect()  # MOST_CELLS at most
    shared = spark.sparkContext.broadcast(np.array([r["centre"] for r in cells]))
    filled = np.array([r["n"] > 0 for r in cells])
    left = queries.where(F.col("vector").isNotNull()).select(F.col(query).alias("__q"), F.col(own or item).cast("long").alias("__own"), V.unit(F.col("vector")).alias("__v"))
    kind = queries.schema[query].dataType.simpleString()

    def near(batches):
        step = max(1, AT_ONCE // max(1, len(filled), probes * shared.value.shape[1]))  # a query is copied for each cell
        for b in (b.slice(a, step) for b in batches for a in range(0, b.num_rows, step)):
            cell = nearest_cells(_matrix(b.column("__v")), shared.value, probes)
            at = np.repeat(np.arange(b.num_rows), cell.shape[1])
            keep = filled[cell.ravel()]
            yield pa.RecordBatch.from_arrays([*(c.take(pa.array(at[keep])) for c in b.columns), pa.array(cell.ravel()[keep].astype(np.int32))], names=["__q", "__own", "__v", "cell"])

    return left.mapInArrow(near, f"__q {kind}, __own long, __v array<double>, cell int")


def search_index(spark: SparkSession, path: str, queries: DataFrame, query: str, item: str, vector: str, k: int = 100, probes: int = 8, own: str | None = None, mask: bool = True, cells: int = CATALOG_CELLS) -> DataFrame:
    """The k best items of each query (query, vector, its own item) by cosine in the ``probes`` nearest cells: query, item, score, rank."""
    known = spark.read.parquet(f"{path}/cells").agg(F.count(F.lit(1)).alias("cells"), F.sum("n").alias("n"), F.max(F.size("centre")).alias("dims")).first()
    if probes >= known["cells"]:
        got = _exact(spark, path, queries, query, item, vector, k, own, mask, max(1, -(-known["n"] * known["dims"] // cells)))
        return ranked(got, query, F.col("score"), [F.col(item)]).where(F.col("rank") <= k)
    asked = probed(spark, path, queries, query, item, probes, own)
    wanted = {r["cell"]: r["count"] for r in asked.groupBy("cell").count().collect()}  # a row per cell
    sizes = {r["cell"]: (r["n"], len(r["centre"])) for r in spark.read.parquet(f"{path}/cells").where(F.col("cell").isin(list(wanted))).collect()}
    plan = [(c, max(1, -(-sizes[c][0] * sizes[c][1] // cells)), max(1, -(-n // SLICE_QUERIES))) for c, n in wanted.items()]
    plan = F.broadcast(spark.createDataFrame(plan, "cell int, __blocks int, __slices int"))
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = asked.join(plan, "cell").withColumn("__s", F.pmod(F.xxhash64("__q"), F.col("__slices")).cast("int")).withColumn("__b", spread("__blocks")).drop("__blocks", "__slices")
    held = spark.read.parquet(f"{path}/vectors").where(F.col("cell").isin(sorted(wanted)) & F.col(vector).isNotNull())
    right = held.select("cell", F.col(item).cast("long").alias("__i"), V.unit(F.col(vector)).alias("__m")).join(plan, "cell")
    right = right.withColumn("__b", F.pmod(F.xxhash64("__i"), F.col("__blocks")).cast("int")).withColumn("__s", spread("__slices")).drop("__blocks", "__slices")
    kind = queries.schema[query].dataType.simpleString()

    def cell(q: pa.Table, x: pa.Table) -> pa.Table:
        out = []
        if q.num_rows and x.num_rows:
            x = x.sort_by("__i").combine_chunks()
            items, matrix = x["__i"].to_numpy(), _matrix(x["__m"])
            for b in q.combine_chunks().to_batches(max_chunksize=max(1, min(256, 4_000_000 // len(items)))):
                out.append(pa.RecordBatch.from_arrays(best_of_block(b["__q"], b["__own"], _matrix(b["__v"]), items, matrix, mask, k), names=[query, item, "score"]))
        empty = pa.schema([(query, q.schema.field("__q").type), (item, pa.int64()), ("score", pa.float64())])
        return pa.Table.from_batches(out, empty)

    got = left.groupBy("cell", "__s", "__b").cogroup(right.groupBy("cell", "__s", "__b")).applyInArrow(cell, f"{query} {kind}, {item} long, score double")
    return ranked(got, query, F.col("score"), [F.col(item)]).where(F.col("rank") <= k)


def _exact(spark: SparkSession, path: str, queries: DataFrame, query: str, item: str, vector: str, k: int, own: str | None, mask: bool, blocks: int) -> DataFrame:
    """query, item, score: the k best items of each query in each of some blocks of the index; every slice of queries meets every block."""
    left = queries.where(F.col("vector").isNotNull()).select(F.col(query).alias("__q"), F.col(own or item).cast("long").alias("__own"), V.unit(F.col("vector")).alias("__v"))
    right = spark.read.parquet(f"{path}/vectors").where(F.col(vector).isNotNull()).select(F.col(item).cast("long").alias("__i"), V.unit(F.col(vector)).alias("__m"))
    n = queries.count()
    slices = max(1, -(-n // MOST_SLICE), min(-(-TASKS // blocks), n // LEAST_SLICE))
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = left.withColumn("__s", F.pmod(F.xxhash64("__q"), F.lit(slices)).cast("int")).withColumn("__b", spread(blocks))
    right = right.withColumn("__b", F.pmod(F.xxhash64("__i"), F.lit(blocks)).cast("int")).withColumn("__s", spread(slices))
    kind = queries.schema[query].dataType.simpleString()

    def met(asked: pa.Table, held: pa.Table) -> pa.Table:
        schema = pa.schema([(query, asked.schema.field("__q").type), (item, pa.int64()), ("score", pa.float64())])
        out = [schema.empty_table()]
        if asked.num_rows and held.num_rows:
            held = held.sort_by("__i").combine_chunks()
            items, matrix = held["__i"].to_numpy(), _matrix(held["__m"])
            few = max(k, min(len(items), 4096))  # the first items give each query a bound, which few of the others reach
            step = max(1, AT_ONCE // few)
            for b in asked.combine_chunks().to_batches(max_chunksize=step):
                v, (mine, masked) = _matrix(b["__v"]), _own(b, mask)
                best = Best(np.full(len(v), -np.inf), k)
                for a in range(0, len(items), few):
                    ids = items[a : a + few]
                    s = v @ matrix[a : a + few].T
                    s[(ids[None, :] == mine[:, None]) & masked[:, None]] = -np.inf
                    r, c = best_of_rows(np.round(s, 12), k) if a == 0 else np.nonzero(s >= best.least[:, None] - SLACK)
                    score = np.round(s[r, c], 12)
                    keep = np.isfinite(score)
                    best.add(r[keep], ids[c[keep]], score[keep])
                    best.cut()
                r, found, score = best.cut()
                out.append(pa.Table.from_arrays([b["__q"].take(pa.array(r)), pa.array(found), pa.array(score)], schema=schema))
        return pa.concat_tables(out)

    return left.groupBy("__s", "__b").cogroup(right.groupBy("__s", "__b")).applyInArrow(met, f"{query} {kind}, {item} long, score double")
