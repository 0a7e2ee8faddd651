"""Approximate nearest neighbours by cosine: robust-pruned directed graphs, one per shard.

Equal vectors are one point, with its ``k`` + 1 smallest ids: of copies that tie,
no more can be among any query's k results, so nothing is lost.  Points go to
shards by the hash of their vector.  A task builds the graph of a shard (greedy
searches propose neighbours, relaxed distance pruning keeps diverse edges) and
streams the queries through a beam search.  Scores are exact cosines, in double
precision, on the original vectors.  All rows are indexed.

Shards hold about ``points / 64`` points, within ``SHARD``: their number is then
bounded until shards reach the upper end, and the queries' work grows with the
queries alone.

Vectors that are null, empty, zero, or hold null or non-finite components take no
part, as query or candidate.  Vectors of different lengths are not compared.  Equal
rows count once.  Rows that share an id are one item, whose score with another is
the largest of their vectors': so an id is found once at most by a query, and never
by itself.  Fewer than k candidates: all of them.  Rows without an id take no part.
An empty table gives an empty result.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepool.llm.tables import small_batches, staged
from tidepool.llm.vector_graph import QUERY_BEAM, Graph

SHARD, SHARDS, QUERY_BLOCK = (1024, 1 << 14), 64, 128


def usable(vector: Column) -> Column:
    """Whether a vector takes part."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, *, id_col: str = "vec_id", vector_col: str = "embedding", beam: int = QUERY_BEAM) -> DataFrame:
    """The k nearest rows of ``vectors`` to each row of ``queries`` but its own: query_id, rank, <id>, score."""
    small_batches(vectors.sparkSession)
    shape = lambda df: df.select(F.col(id_col).cast("long").alias("id"), F.transform(vector_col, lambda x: x.cast("double")).alias("v")).where(F.col("id").isNotNull() & usable(F.col("v")))
    copies = Window.partitionBy("v").orderBy("id")
    points = staged(shape(vectors).distinct().withColumn("nth", F.row_number().over(copies)).where(F.col("nth") <= k + 1).drop("nth"), "points")
    size = min(max(points.count() // SHARDS, SHARD[0]), SHARD[1])
    counted = points.groupBy(F.size("v").alias("dim")).count().collect()  # one row per length of vector
    plan = {r["dim"]: max(1, -(-r["count"] // size)) for r in counted}
    spark = vectors.sparkSession
    shards = spark.createDataFrame([(d, n) for d, n in plan.items()], "dim int, shards int")  # as small
    salt = F.pmod(F.xxhash64("v"), F.col("shards"))
    indexed = points.join(F.broadcast(shards), F.size("v") == F.col("dim")).select("dim", salt.cast("int").alias("shard"), F.lit(0).alias("kind"), "id", "v")
    asked = shape(queries).distinct().join(F.broadcast(shards), F.size("v") == F.col("dim"))
    asked = asked.select("dim", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"), F.lit(1).alias("kind"), "id", "v")
    rows = indexed.union(asked).repartition("dim", "shard").sortWithinPartitions("dim", "shard", "kind", "id")

    def run(batches):
        key, ids, parts, shard = None, [], [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            dim, number, kind = (batch.column(c).to_numpy() for c in range(3))
            change = np.flatnonzero((np.diff(dim) != 0) | (np.diff(number) != 0) | (np.diff(kind) != 0)) + 1
            for a, b in zip([0, *change], [*change, len(dim)]):
                if (dim[a], number[a]) != key:
                    key, ids, parts, shard = (dim[a], number[a]), [], [], None
                vector = batch.column(4).slice(a, b - a).flatten().to_numpy(zero_copy_only=False).reshape(b - a, dim[a])
                if kind[a] == 0:
                    ids.append(batch.column(3).to_numpy()[a:b])
                    parts.append(vector)
                    continue
                if shard is None and ids:
                    shard = Shard(np.concatenate(ids), np.concatenate(parts))
                    parts = []
                for c in range(a, b if shard is not None else a, QUERY_BLOCK):
                    d = min(b, c + QUERY_BLOCK)
                    yield shard.query(batch.column(3).to_numpy()[c:d], vector[c - a : d - a], k, beam)

    found = rows.mapInArrow(run, "query_id long, id long, score double").groupBy("query_id", "id").agg(F.max("score").alias("score"))
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "score")


def norms(v: np.ndarray) -> np.ndarray:
    """Euclidean norms, scaled so that no square overflows."""
    most = np.abs(v).max(axis=1)
    return np.sqrt(((v / most[:, None]) ** 2).sum(axis=1)) * most


class Shard:
    """The points of a shard with the ids of each, and their graph."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        _, first, of = np.unique(vectors, axis=0, return_index=True, return_inverse=True)
        order = np.lexsort((ids, of.ravel()))
        self.ids, of = ids[order], of.ravel()[order]
        self.bounds = np.searchsorted(of, np.arange(len(first) + 1))
        self.v = vectors[first]
        self.distinct = np.unique(ids)
        self.norm = norms(self.v)
        self.graph = Graph(self.v / self.norm[:, None])

    def query(self, ids: np.ndarray, vectors: np.ndarray, k: int, beam: int) -> pa.RecordBatch:
        """Each query's k nearest here, by exact score then id."""
        norm = norms(vectors)
        unit = vectors / norm[:, None]
        found, _, _ = self.graph.search(unit.astype(np.float32), max(beam, k + 1))
        near = found[:, : 4 * (k + 1)]
        with np.errstate(over="ignore", invalid="ignore"):
            score = np.einsum("qcd,qd->qc", self.v[near], vectors) / (self.norm[near] * norm[:, None])
        odd = ~np.isfinite(score)  # products beyond double precision: scale first
        if odd.any():
            score[odd] = np.einsum("qcd,qd->qc", self.v[near] / self.norm[near][:, :, None], unit)[odd]
        out: list[tuple[int, int, float]] = []
        for q, (name, point, s) in enumerate(zip(ids.tolist(), near.tolist(), score.tolist())):
            best = self.items(name, point, s, k)
            if len(best) < min(k, len(self.distinct) - 1):  # copies and other vectors of the same ids fill the beam: look at all points
                best = self.items(name, range(len(self.v)), (((self.v / self.norm[:, None]) @ unit[q])).tolist(), k)
            out += [(name, i, x) for i, x in best]
        columns = list(zip(*out)) if out else [(), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.float64())], names=["query_id", "id", "score"])

    def items(self, query: int, points: Sequence[int], scores: list[float], k: int) -> list[tuple[int, float]]:
        """The k best ids of some points, but the query's own, each with its largest score."""
        best: dict[int, float] = {}
        for p, x in zip(points, scores):
            if p < 0:
                continue
            for i in self.ids[self.bounds[p] : self.bounds[p + 1]].tolist():
                if i != query and x > best.get(i, -np.inf):
                    best[i] = x
        return sorted(best.items(), key=lambda z: (-z[1], z[0]))[:k]
