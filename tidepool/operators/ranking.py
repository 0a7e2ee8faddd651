"""Re-ranking inside pools: blends of retrieval, popularity and metadata scores.

All are window expressions over a long pool (query, item, score, ...): one shuffle by query.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepool.functions import vectors as V
from tidepool.operators.windows import minmax, ranked

ALPHA, W_META = 0.2, 0.1


def logpop_blend(query: str, alpha: float = ALPHA, score: str = "score", pop: str = "pop") -> Column:
    """alpha * minmax(score) + (1 - alpha) * minmax(log1p(pop))."""
    return alpha * minmax(F.col(score), query) + (1 - alpha) * minmax(F.log1p(pop), query)


def with_blend(df: DataFrame, query: str, base: str, other: str, weight: float, out: str) -> DataFrame:
    """(1 - w) minmax(base) + w minmax(other); base itself at w <= 0, minmax(other) at w >= 1."""
    if weight <= 0:
        return df.withColumn(out, F.col(base))
    if weight >= 1:
        return df.withColumn(out, minmax(F.col(other), query))
    return df.withColumn(out, (1 - weight) * minmax(F.col(base), query) + weight * minmax(F.col(other), query))


def metadata_cosine(pool: DataFrame, enriched: DataFrame, anchor: str, item: str, fields: list[str], out: str = "meta") -> DataFrame:
    """The mean over fields of the cosine between the anchor item's and the item's pooled vectors; missing ones count 0."""
    own = enriched.select(F.col(item).alias("__a"), *(F.col(f).alias(f"__a_{f}") for f in fields))
    cand = enriched.select(F.col(item).alias("__c"), *(F.col(f).alias(f"__c_{f}") for f in fields))
    df = pool.join(own, F.col(anchor) == F.col("__a"), "left").join(cand, F.col(item) == F.col("__c"), "left")
    return df.withColumn(out, mean_cosine([f"__a_{f}" for f in fields], [f"__c_{f}" for f in fields])).drop("__a", "__c", *(f"__{s}_{f}" for s in "ac" for f in fields))


def mean_cosine(left: Sequence[str], right: Sequence[str]) -> Column:
    """The mean over pairs of columns of their vectors' cosine; missing ones count 0."""
    each = [F.coalesce(V.cosine(F.col(a), F.col(b)), F.lit(0.0)) for a, b in zip(left, right)]
    return sum(each[1:], each[0]) / F.lit(float(len(each)))


def metadata_jaccard(pool: DataFrame, sets: DataFrame, anchor: str, item: str, weights: dict[str, float], out: str = "meta") -> DataFrame:
    """The weighted mean over fields of the Jaccard index of the anchor's and the item's sets."""
    own = sets.select(F.col(item).alias("__a"), *(F.col(f).alias(f"__a_{f}") for f in weights))
    cand = sets.select(F.col(item).alias("__c"), *(F.col(f).alias(f"__c_{f}") for f in weights))
    df = pool.join(own, F.col(anchor) == F.col("__a"), "left").join(cand, F.col(item) == F.col("__c"), "left")
    empty = lambda c: F.coalesce(c, F.array().cast("array<string>"))
    each = [w * V.jaccard(empty(F.col(f"__a_{f}").cast("array<string>")), empty(F.col(f"__c_{f}").cast("array<string>"))) for f, w in weights.items()]
    return df.withColumn(out, sum(each[1:], each[0]) / F.lit(float(sum(weights.values())))).drop("__a", "__c", *(f"__{s}_{f}" for s in "ac" for f in weights))


def metadata_entity_max(pool: DataFrame, entities: DataFrame, anchor: str, item: str, fields: list[str], out: str = "meta") -> DataFrame:
    """The mean over fields of the largest cosine between an entity vector of the anchor item and one of the item; 0 where either has none."""
    own = entities.select(F.col(item).alias("__a"), *(F.col(f).alias(f"__a_{f}") for f in fields))
    cand = entities.select(F.col(item).alias("__c"), *(F.col(f).alias(f"__c_{f}") for f in fields))
    df = pool.join(own, F.col(anchor) == F.col("__a"), "left").join(cand, F.col(item) == F.col("__c"), "left")
    each = [F.coalesce(V.max_cosine(F.col(f"__a_{f}"), F.col(f"__c_{f}")), F.lit(0.0)) for f in fields]
    return df.withColumn(out, sum(each[1:], each[0]) / F.lit(float(len(fields)))).drop("__a", "__c", *(f"__{s}_{f}" for s in "ac" for f in fields))


def v2a(pool: DataFrame, query: str, w_meta: float = W_META, alpha: float = ALPHA, out: str = "final") -> DataFrame:
    """The log-popularity blend, then blended with ``meta``."""
    return with_blend(pool.withColumn("__d1", logpop_blend(query, alpha)), query, "__d1", "meta", w_meta, out).drop("__d1")


# -- candidate formulas -----------------------------------------------------------


def linear(query: str, alpha: float) -> Column:
    """Popularity as it is instead of its logarithm."""
    return alpha * minmax(F.col("score"), query) + (1 - alpha) * minmax(F.col("pop"), query)


def rank_fusion(query: str, item: str, k: int = 60, weight: float = 0.5) -> Column:
    """Reciprocal ranks of score and popularity."""
    w = Window.partitionBy(query)
    r = F.row_number().over(w.orderBy(F.col("score").desc(), item))
    p = F.row_number().over(w.orderBy(F.col("pop").desc(), item))
    return weight / (k + r) + (1 - weight) / (k + p)


def geometric(query: str, alpha: float, eps: float = 1e-9) -> Column:
    """minmax(score)^alpha * minmax(log1p(pop))^(1 - alpha), both kept above eps."""
    return F.pow(F.greatest(minmax(F.col("score"), query), F.lit(eps)), F.lit(alpha)) * F.pow(F.greatest(minmax(F.log1p("pop"), query), F.lit(eps)), F.lit(1 - alpha))


def head_only(df: DataFrame, query: str, item: str, m: int, alpha: float = ALPHA, out: str = "final") -> DataFrame:
    """The m best by score are blended among themselves and stay ahead of the rest, which keep their order."""
    df = df.withColumn("__r", F.row_number().over(Window.partitionBy(query).orderBy(F.col("score").desc(), item))).withColumn("__h", F.col("__r") <= m)
    inside = alpha * minmax(F.col("score"), [query, "__h"]) + (1 - alpha) * minmax(F.log1p("pop"), [query, "__h"])
    return df.withColumn(out, F.when(F.col("__h"), inside + 1).otherwise(-F.col("__r").cast("double"))).drop("__r", "__h")


def gated(query: str, alpha: float, gate: float) -> Column:
    """The blend where the spread of scores is below the gate, else the scores alone."""
    w = Window.partitionBy(query)
    return F.when(F.max("score").over(w) - F.min("score").over(w) < gate, logpop_blend(query, alpha)).otherwise(minmax(F.col("score"), query))


def popularity_only() -> Column:
    return F.log1p("pop")


def cross_encoder_blend(query: str, w: float, alpha: float | None = None) -> Column:
    """w minmax(ce) + (1 - w) minmax(score), or with the log-popularity blend in the second part."""
    rest = minmax(F.col("score"), query) if alpha is None else logpop_blend(query, alpha)
    return w * minmax(F.col("ce"), query) + (1 - w) * rest


def scores_from_picks(pool: DataFrame, query: str, item: str, out: str = "final") -> DataFrame:
    """A model's picks (array column ``picks``) as scores: n - place for picked items, below all of them for others; null picks leave the scores."""
    at = F.array_position("picks", F.col(item)).cast("double")
    n = F.size("picks").cast("double")
    return pool.withColumn(out, F.when(F.col("picks").isNull(), F.col("score")).when(at > 0, n - at + 1).otherwise(F.lit(0.0)))


def listnet_target(query: str, label: str) -> Column:
    """The uniform distribution over a pool's positives; zeros if it has none."""
    n = F.sum(label).over(Window.partitionBy(query))
    return F.when(n > 0, F.col(label) / n).otherwise(F.lit(0.0))


def softmax(x: str, query: str) -> Column:
    w = Window.partitionBy(query)
    e = F.exp(F.col(x) - F.max(x).over(w))
    return e / F.sum(e).over(w)


@dataclass(frozen=True)
class PoolReranker:
    """A named re-ranking of one retrieval method's pools; with ``fields``, the pool comes with ``meta``, the mean cosine of these vectors to the query's own item's."""

    name: str
    base_method: str
    apply: Callable[..., DataFrame]
    params: dict = field(default_factory=dict)
    fields: tuple[str, ...] = ()

    def __call__(self, pool: DataFrame, query: str) -> DataFrame:
        return self.apply(pool, query, **self.params)


def _logpop(p: DataFrame, q: str, alpha: float) -> DataFrame:
    return p.withColumn("final", logpop_blend(q, alpha))


#: Metadata vectors that the shipped re-rankers compare; fixed names.
META_FIELDS = ("genres", "themes", "keywords")
_BLEND, _V2A = {"alpha": ALPHA}, {"w_meta": W_META, "alpha": ALPHA}

#: Re-rankers by name; their base methods are names of ``retrieval.SCORERS``.
RERANKERS: dict[str, PoolReranker] = {
    r.name: r
    for r in (
        PoolReranker("bare", "raw", lambda p, q: p.withColumn("final", F.col("score"))),
        PoolReranker("logpop_blend", "raw", _logpop, _BLEND),
        PoolReranker("v2a", "raw", v2a, _V2A, META_FIELDS),
        PoolReranker("two_tower_v1_heuristic_logpop_blend", "two_tower_v1", _logpop, _BLEND),
        PoolReranker("two_tower_v1_v2a_embed_query_logpop_blend", "two_tower_v1", v2a, _V2A, META_FIELDS),
        PoolReranker("rag_chunk_v1_vector_blend_query_v2a_embed_query_logpop_blend", "rag_chunk_v1_vector_blend_query", v2a, _V2A, META_FIELDS),
    )
}


def grid(pool: DataFrame, query: str, values: list[float], score: Callable[[float], Column], evaluate: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``evaluate`` over the pool scored with each value of a parameter, as one frame with the column ``value``."""
    frames = [evaluate(pool.withColumn("final", score(v))).withColumn("value", F.lit(float(v))) for v in values]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def scored_grid(pool: DataFrame, scores: Column, config: str = "config", out: str = "final") -> DataFrame:
    """A row of the pool for each configuration (its number from 0), of an array with a score for each: the pool is read once."""
    return pool.select("*", F.posexplode(scores).alias(config, out))


def grid_metrics(pool: DataFrame, positives: DataFrame, query: str, item: str, configs: Sequence[dict], score: Callable[..., Column] | Column, k: int = 10) -> DataFrame:
    """Mean metrics of every configuration, with a column for each parameter: one scan, one ranking by (configuration, query).

    ``score``: a configuration's parameters to a score, or an array column with the scores of all of them in order.
    """
    from tidepool.operators import metrics as M

    scores = score if isinstance(score, Column) else F.array(*(score(**c) for c in configs))
    lists = ranked(scored_grid(pool.select(query, item, scores.alias("__s")), F.col("__s")).drop("__s"), ["config", query], F.col("final"), [F.col(item)])
    means = M.mean_table(M.ranking_metrics(lists.where(F.col("rank") <= k), positives, query, item, k, ["config"]), ["config"], ["hit", "precision", "recall", "ap", "ndcg", "mrr"])
    values = F.array(*(F.struct(*(F.lit(v).alias(n) for n, v in c.items())) for c in configs))
    return means.select("config", values[F.col("config")].alias("c"), "hit", "precision", "recall", "ap", "ndcg", "mrr", "n").select("config", "c.*", "hit", "precision", "recall", "ap", "ndcg", "mrr", "n")
