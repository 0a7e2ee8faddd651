"""Connected components by alternating large-star and small-star rounds.

(Kiveris et al., Connected Components in MapReduce and Beyond, 2014.)  Edges stay
distributed; each round ends in a table in the shared folder.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.llm.tables import drop, staged

_EDGE = "u long, v long"


def _forest(batches):
    """The edges of a task as stars around the smallest node of each of their components."""
    for batch in batches:
        if not batch.num_rows:
            continue
        nodes, at = np.unique(np.concatenate([batch.column(0).to_numpy(), batch.column(1).to_numpy()]), return_inverse=True)
        a, b = at[: batch.num_rows], at[batch.num_rows :]
        root = np.arange(len(nodes))
        while True:
            low = np.minimum(root[a], root[b])
            new = root.copy()
            np.minimum.at(new, root[a], low)
            np.minimum.at(new, root[b], low)
            new = new[new]
            if (new == root).all():
                break
            root = new
        while not (root[root] == root).all():
            root = root[root]
        off = np.flatnonzero(root != np.arange(len(nodes)))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[off]), pa.array(nodes[root[off]])], names=["u", "v"])


def components(edges: DataFrame, held: list[str] | None = None) -> DataFrame:
    """(node, component): the smallest node reachable, for every node of ``edges`` (u, v); self loops are ignored.

    The result reads the last round's table, whose path is added to ``held``; earlier ones are deleted.
    """
    spark, rounds = edges.sparkSession, []
    edges = edges.select(F.col("u").cast("long"), F.col("v").cast("long")).where("u <> v")
    edges = staged(edges.mapInArrow(_forest, _EDGE).distinct(), "edges", rounds)
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: every node's smaller neighbours, and the node itself, go to the least of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        before, rounds = rounds, []
        after = staged(small, "edges", rounds)
        drop(spark, before)
        # done when every node has one edge and no centre is the outer end of another
        outer = after.groupBy("u").agg(F.count("*").alias("n"))
        more = outer.where("n > 1").limit(1).count() or after.join(outer.select(F.col("u").alias("v")), "v", "left_semi").limit(1).count()
        edges = after
        if not more:
            break
    if held is not None:
        held += rounds
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
