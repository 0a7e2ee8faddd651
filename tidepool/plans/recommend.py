"""Whole recommendation jobs: batch recommendations, the regression gate, the flagship query."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.operators import ranking as R
from tidepool.operators import retrieval as T
from tidepool.operators.windows import ranked


def recommend(queries: DataFrame, catalog: DataFrame, query: str, item: str, reranker: R.PoolReranker | None = None, k: int = 10, k_retrieval: int = 100) -> DataFrame:
    """query, item, rank, final: retrieval of ``k_retrieval`` items, re-ranking, and the k best.

    ``queries``: query, own item, vector; ``catalog``: item, vector, pop.
    """
    if k > k_retrieval:
        raise ValueError("k must not exceed the size of the pool")
    reranker = reranker or R.RERANKERS["logpop_blend"]
    pool = T.cosine_pool(queries, catalog, query, item, k_retrieval).drop("rank")
    scored = reranker(pool.join(catalog.select(item, "pop"), item), query)
    return ranked(scored, query, F.col("final"), [F.col(item)]).where(F.col("rank") <= k).select(query, item, "rank", "final")


def regression_gate(current: Mapping[str, Mapping[str, float]], baseline: Mapping[str, Mapping[str, float]], tolerance: float = 1e-3) -> list[str]:
    """What is wrong: methods that are missing, values outside [0, 1], values that fell by more than the tolerance."""
    wrong = [f"{m} is missing" for m in baseline if m not in current]
    for m, row in current.items():
        for c, v in row.items():
            if not 0 <= v <= 1:
                wrong.append(f"{m} {c} is {v}")
            elif c in baseline.get(m, {}) and baseline[m][c] - v > tolerance:
                wrong.append(f"{m} {c} fell from {baseline[m][c]} to {v}")
    return wrong


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Mean metrics of each method over all queries and by slice, on the driver's tables."""
    from tidepool.plans import rec_queries as Q

    return Q.metric_tables(spark, d)
