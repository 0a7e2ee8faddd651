"""Offline evaluation of retrieval and ranking: scored methods, the set of tables, run metadata, frozen pools.

Pools, lists and metrics are long frames with a ``method`` column, so every method
goes through one plan.  Given a folder, a job writes pools, lists and per-query
metrics there once, and its tables are made from those files.
"""

from __future__ import annotations

import time
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.operators import metrics as M
from tidepool.operators import ranking as R
from tidepool.operators.cohorts import require_disjoint
from tidepool.operators.windows import deciles, ranked

#: Methods that an evaluation needs, and the one that others are compared with; fixed values.
REQUIRED, REFERENCE = ("raw", "popularity_train", "multi_mean_train"), "popularity_train"
MASKING = "mask_query_app_v1"
RETRIEVAL_COLS = ("hit", "precision", "recall")
RANKING_COLS = ("hit", "precision", "recall", "ap", "ndcg", "mrr", "oracle_hit", "oracle_ndcg")
GUARD_COLS = ("ild", "coverage", "novelty", "gap_vs_reference")


def _union(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def long_pools(pools: Mapping[str, DataFrame], query: str, item: str) -> DataFrame:
    """Pools by name (query, item, score) as one frame: method, query, item, score, rank.  A pool that brings its ``rank`` keeps it."""
    columns = lambda n, p: [F.lit(n).alias("method"), query, F.col(item).cast("long").alias(item), F.col("score").cast("double").alias("score")]
    held = [p.select(*columns(n, p), F.col("rank").cast("int").alias("rank")) for n, p in pools.items() if "rank" in p.columns]
    others = [p.select(*columns(n, p)) for n, p in pools.items() if "rank" not in p.columns]
    return _union([*held, *([ranked(_union(others), ["method", query], F.col("score"), [F.col(item)])] if others else [])])


def require(methods: Sequence[str], k_final: int, k_retrieval: int, required: Sequence[str] = REQUIRED) -> None:
    """ValueError without the required methods, or for a pool smaller than the list."""
    if lost := sorted(set(required) - set(methods)):
        raise ValueError(f"methods must include {sorted(required)}; absent: {lost}")
    if k_retrieval < k_final:
        raise ValueError(f"k_retrieval ({k_retrieval}) must be at least k_final ({k_final})")


def ranked_lists(pools: DataFrame, catalog: DataFrame, rerankers: Sequence[R.PoolReranker], query: str, item: str, anchors: DataFrame | None = None) -> DataFrame:
    """method, retrieval_method, query, item, final, rank: every pool in its own order, and each re-ranking of its base method's pools.

    ``anchors``: query, anchor (its own item), for re-rankers that compare metadata.
    """
    base = pools.select("method", F.col("method").alias("retrieval_method"), query, item, F.col("score").alias("final"), "rank")
    vectors = {"vector", "tower_vector", "profile_vector", *(f for r in rerankers for f in r.fields)}
    extra = [c for c in catalog.columns if c not in vectors | {"pop", item}]
    made = []
    for r in rerankers:
        fields = list(r.fields)
        known = catalog.select(item, "pop", *extra, *(F.col(f).alias(f"__c_{f}") for f in fields))
        pool = pools.where(F.col("method") == r.base_method).drop("method", "rank").join(known, item)
        if fields:
            if anchors is None:
                raise ValueError(f"{r.name} needs the queries' own items")
            own = catalog.select(F.col(item).alias("anchor"), *(F.col(f).alias(f"__a_{f}") for f in fields))
            pool = pool.join(anchors.join(own, "anchor", "left").drop("anchor"), query)  # a row per query, not per pool item, meets its own item
            pool = pool.withColumn("meta", R.mean_cosine([f"__a_{f}" for f in fields], [f"__c_{f}" for f in fields])).drop(*(f"__{s}_{f}" for s in "ac" for f in fields))
        scored = r(pool, query).select(query, item, "final")
        made.append(ranked(scored, query, F.col("final"), [F.col(item)]).select(F.lit(r.name).alias("method"), F.lit(r.base_method).alias("retrieval_method"), query, item, "final", "rank"))
    return _union([base, *made])


def with_segments(per: DataFrame, examples: DataFrame, query: str) -> DataFrame:
    """Metrics with their example's counts, slice and support bucket."""
    x = examples.select(query, "n_eval_targets", "n_support", M.slice_name(F.col("n_eval_targets")).alias("slice"), M.support_bucket(F.col("n_support")).alias("bucket"))
    return per.join(x, query)


def retrieval_metrics(pools: DataFrame, positives: DataFrame, examples: DataFrame, query: str, item: str, k_retrieval: int) -> DataFrame:
    """A row per retrieval method and example: hit, precision and recall of the pool, and how many positives it holds."""
    per = M.ranking_metrics(pools, positives, query, item, k_retrieval, ["method"])
    return with_segments(per.select("method", query, "n_pos", *RETRIEVAL_COLS, F.round(F.col("recall") * F.col("n_pos")).cast("long").alias("n_positive_in_retrieved")), examples, query)


def ranking_metrics(lists: DataFrame, pools: DataFrame, positives: DataFrame, examples: DataFrame, query: str, item: str, k_final: int, k_retrieval: int, retrieval: DataFrame | None = None) -> DataFrame:
    """A row per method and example: the metrics of its list, and of the best order of the pool that it re-ranks.

    ``retrieval``: what ``retrieval_metrics`` gave for these pools, where that ran before: it tells how many positives each holds.
    """
    keys = ["method", "retrieval_method"]
    per = M.ranking_metrics(lists, positives, query, item, k_final, keys)
    if retrieval is None:
        best = M.oracle_metrics(pools.where(F.col("rank") <= k_retrieval), positives, query, item, k_final, ["method"])
    else:
        best = M.oracle_of(retrieval.withColumnRenamed("n_positive_in_retrieved", "held"), ["method", query], k_final)
    best = best.select(F.col("method").alias("retrieval_method"), query, "oracle_hit", "oracle_ndcg")
    return with_segments(per.join(best, ["retrieval_method", query]), examples, query)


def popularity_deciles(positives: DataFrame, catalog: DataFrame, query: str, item: str) -> DataFrame:
    """query, decile of the mean popularity of its positives."""
    mean = positives.join(catalog.select(item, "pop"), item).groupBy(query).agg(F.avg("pop").alias("pos_pop_mean"))
    return deciles(mean, "pos_pop_mean").select(query, "decile")


def _guarded(table: DataFrame, guards: DataFrame, keys: Sequence[str]) -> DataFrame:
    return table.join(guards.select(*keys, *GUARD_COLS), list(keys), "left")


def guarded_lists(top: DataFrame, catalog: DataFrame, examples: DataFrame, positives: DataFrame, by_decile: DataFrame, query: str, item: str, k_personalization: int) -> DataFrame:
    """A row per method and query: its list's diversity, novelty and distance to the reference, and for a query with positives its slice, bucket and decile."""
    lists = top.where(F.col("rank") <= k_personalization).select("method", query, item)
    rows = M.list_guards(lists, catalog, ["method"], query, item, REFERENCE)
    held = examples.join(positives.select(query), query, "left_semi").select(query, M.slice_name(F.col("n_eval_targets")).alias("slice"), M.support_bucket(F.col("n_support")).alias("bucket"))
    return rows.join(held.join(by_decile, query, "left"), query, "left")


def ranking_tables(per: DataFrame, lists: DataFrame, n_items: int, by_decile: DataFrame, query: str) -> dict[str, DataFrame]:
    """Means by method overall and by slice, support bucket and decile, with diversity, coverage, novelty and distance to the reference (of ``guarded_lists``), and the method's retrieval method."""
    out = {}
    for name, by in (("overall", []), ("by_slice", ["slice"]), ("by_support_bucket", ["bucket"]), ("by_pop_decile", ["decile"])):
        rows = per if by != ["decile"] else per.join(by_decile, query).where("decile IS NOT NULL")
        held = lists if not by else lists.where(F.col(by[0]).isNotNull())
        guards = M.guard_table(held, n_items, ["method", *by])
        out[f"ranking_{name}"] = _guarded(M.mean_table(rows, ["method", "retrieval_method", *by], RANKING_COLS), guards, ["method", *by])
    out["ranking_pop_delta"] = M.deltas(out["ranking_by_pop_decile"], ["decile"], REFERENCE, RANKING_COLS)
    out["personalization"] = M.guard_table(lists, n_items, ["method"])
    return out


def retrieval_tables(per: DataFrame, by_decile: DataFrame, query: str) -> dict[str, DataFrame]:
    held = per.join(by_decile, query).where("decile IS NOT NULL")
    out = {f"retrieval_{n}": M.mean_table(per, ["method", *by], RETRIEVAL_COLS) for n, by in (("overall", []), ("by_slice", ["slice"]), ("by_support_bucket", ["bucket"]))}
    out["retrieval_by_pop_decile"] = M.mean_table(held, ["method", "decile"], RETRIEVAL_COLS)
    out["retrieval_pop_delta"] = M.deltas(out["retrieval_by_pop_decile"], ["decile"], REFERENCE, RETRIEVAL_COLS)
    return out


def artifacts(lists: DataFrame, pools: DataFrame, positives: DataFrame, examples: DataFrame, query: str, item: str, k_final: int, k_retrieval: int) -> DataFrame:
    """A row per method and example with its pool, list and positives as JSON.  Lists have fixed sizes, positives are a user's."""

    def packed(rows: DataFrame, keys: list[str], score: str, ids: str, scores: str) -> DataFrame:
        best = F.array_sort(F.collect_list(F.struct("rank", F.col(item).alias("i"), F.col(score).alias("s"))))
        return rows.groupBy(*keys).agg(best.alias("b")).select(*keys, F.to_json(F.transform("b", lambda x: x["i"])).alias(ids), F.to_json(F.transform("b", lambda x: x["s"])).alias(scores))

    pool = packed(pools.where(F.col("rank") <= k_retrieval).withColumnRenamed("method", "retrieval_method"), ["retrieval_method", query], "score", "retrieved_app_ids_json", "retrieved_scores_json")
    listed = packed(lists.where(F.col("rank") <= k_final), ["method", "retrieval_method", query], "final", "ranked_app_ids_json", "ranked_scores_json")
    wanted = positives.groupBy(query).agg(F.to_json(F.array_sort(F.collect_set(item))).alias("validation_positive_app_ids_json"))
    out = with_segments(listed.join(pool, ["retrieval_method", query]).join(wanted, query), examples, query)
    return out.withColumns({"retrieval_k": F.lit(k_retrieval), "final_k": F.lit(k_final), "masking_policy_version": F.lit(MASKING)})


def run_metadata(examples: DataFrame, retrieval: DataFrame, ranking: DataFrame, methods: Sequence[str], catalog_size: int, **settings) -> dict:
    """Settings, coverage, counts by slice and bucket, the retrieval bottleneck, and the spread in the single-target slice."""
    row = lambda df: df.first().asDict()
    x = examples.select(M.slice_name(F.col("n_eval_targets")).alias("slice"), M.support_bucket(F.col("n_support")).alias("bucket"), "n_eval_targets")
    pairs = lambda df: {r[0]: r[1] for r in df.collect()}  # noqa: E731  a few rows: slices, buckets, methods
    single = lambda df, cols: {r["method"]: {c: r[c] for c in cols} for r in df.where(F.col("slice") == M.SLICES[1]).groupBy("method").agg(*(F.stddev_pop(c).alias(c) for c in cols)).collect()}
    bottleneck = M.bottleneck(retrieval, ["method"], "n_positive_in_retrieved")
    return {
        **settings, "methods_run": list(methods), "masking_policy_version": MASKING, "candidate_pool_size": catalog_size,
        "coverage": row(M.coverage(x, "n_eval_targets")),
        "counts_by_slice": pairs(x.groupBy("slice").count()),
        "counts_by_support_bucket": pairs(M.counts_over(x, "bucket", M.BUCKETS)),
        "retrieval_bottleneck": {r["method"]: r.asDict() for r in bottleneck.collect()},
        "slice_b_empirical_std": {"retrieval": single(retrieval, RETRIEVAL_COLS), "ranking": single(ranking, RANKING_COLS[:6])},
    }


def _kept(df: DataFrame, name: str, folder: str | None) -> DataFrame:
    if folder is None:
        return df
    df.write.mode("overwrite").parquet(f"{folder}/{name}")
    return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/{name}")


def evaluate_retrieval(examples: DataFrame, positives: DataFrame, catalog: DataFrame, pools: Mapping[str, DataFrame], query: str, item: str, *, k_final: int = 10, k_retrieval: int = 100, support: DataFrame | None = None, folder: str | None = None) -> dict[str, DataFrame]:
    """The part of ``evaluate`` that ranks nothing: the retrieval tables by name, ``retrieval`` (per example), and the written input, pools and deciles."""
    require(list(pools), k_final, k_retrieval)
    if support is not None:
        require_disjoint(support, positives, [query, item])
    out = {n: _kept(df, n, folder) for n, df in (("examples", examples), ("positives", positives), ("catalog", catalog))}
    examples, positives, catalog = out.values()
    pool = out["pools"] = _kept(long_pools(pools, query, item).where(F.col("rank") <= k_retrieval), "pools", folder)
    retrieval = out["retrieval"] = _kept(retrieval_metrics(pool, positives, examples, query, item, k_retrieval), "retrieval", folder)
    if folder is not None and retrieval.isEmpty():
        raise ValueError("no example has a positive")
    out["deciles"] = _kept(popularity_deciles(positives, catalog, query, item), "deciles", folder)
    return out | retrieval_tables(retrieval, out["deciles"], query)


def evaluate(examples: DataFrame, positives: DataFrame, catalog: DataFrame, pools: Mapping[str, DataFrame], rerankers: Sequence[R.PoolReranker], query: str, item: str, *, k_final: int = 10, k_retrieval: int = 100, k_personalization: int = 10, support: DataFrame | None = None, own: str | None = None, folder: str | None = None, metadata: bool = False, retrieved: Mapping[str, DataFrame] | None = None) -> dict:
    """The whole evaluation: tables by name, ``retrieval`` and ``ranking`` (per example), ``artifacts``, and ``run_meta`` if asked for.

    ``examples``: query, n_eval_targets, n_support; ``positives``: distinct (query, item); ``catalog``: item, vector,
    pop and what re-rankers need; ``pools``: (query, item, score) by retrieval method, the query's own item left out.
    ``support``: (query, item) rows that methods learn from, which share none with the positives (else a ValueError);
    ``own``: the examples' column with the query's own item.  A method that no example has a positive for is a ValueError.
    ``retrieved``: what ``evaluate_retrieval`` gave for the same input, where that ran before.
    """
    require(list(pools), k_final, k_retrieval)
    if unknown := sorted({r.base_method for r in rerankers} - set(pools)):
        raise ValueError(f"no pools of the re-rankers' base methods: {unknown}")
    began = time.perf_counter()
    if retrieved is None:
        retrieved = evaluate_retrieval(examples, positives, catalog, pools, query, item, k_final=k_final, k_retrieval=k_retrieval, support=support, folder=folder)
    examples, positives, catalog, pool, retrieval, by_decile = (retrieved[n] for n in ("examples", "positives", "catalog", "pools", "retrieval", "deciles"))
    anchors = None if own is None else examples.select(query, F.col(own).alias("anchor"))
    lists = ranked_lists(pool, catalog, rerankers, query, item, anchors)
    lists = _kept(lists.where(F.col("rank") <= max(k_final, k_personalization)), "lists", folder)
    ranking = _kept(ranking_metrics(lists, pool, positives, examples, query, item, k_final, k_retrieval, retrieval), "ranking", folder)
    if folder is not None and ranking.isEmpty():
        raise ValueError("no example has a positive")
    guarded = _kept(guarded_lists(lists, catalog, examples, positives, by_decile, query, item, k_personalization), "guards", folder)
    scored = time.perf_counter()
    out = {**{n: t for n, t in retrieved.items() if n.startswith("retrieval_")}, **ranking_tables(ranking, guarded, catalog.count(), by_decile, query)}
    out |= {"retrieval": retrieval, "ranking": ranking, "artifacts": artifacts(lists, pool, positives, examples, query, item, k_final, k_retrieval)}
    if metadata:
        methods = [*pools, *(r.name for r in rerankers)]
        out["run_meta"] = run_metadata(examples, retrieval, ranking, methods, catalog.count(), k_final=k_final, k_retrieval=k_retrieval, k_personalization=k_personalization)
        out["run_meta"]["timing_seconds"] = {"score_methods": round(scored - began, 3), "total": round(time.perf_counter() - began, 3)}
    return out


# -- frozen pools --------------------------------------------------------------------


def pool_table(rows: DataFrame, query: str, item: str, method: str = "pool_method") -> DataFrame:
    """Exported pools (JSON arrays of ids and scores) as long pools: method, query, item, score, rank."""
    ids, scores = F.from_json("retrieved_app_ids_json", "array<bigint>"), F.from_json("retrieved_scores_json", "array<double>")
    long = rows.select(F.col(method).alias("method"), query, F.posexplode(F.arrays_zip(ids.alias("i"), scores.alias("s"))).alias("p", "z"))
    return long.select("method", query, F.col("z.i").alias(item), F.col("z.s").alias("score"), (F.col("p") + 1).alias("rank"))


def rank_frozen(rows: DataFrame, examples: DataFrame, positives: DataFrame, catalog: DataFrame, pool_methods: Sequence[str], rerankers: Sequence[R.PoolReranker], query: str, item: str, *, reference: DataFrame, k_final: int = 10, k_retrieval: int = 100, k_personalization: int = 10, folder: str | None = None) -> dict[str, DataFrame]:
    """Ranking tables on exported pools, without retrieval: every pool as it is, each re-ranking, and ``reference`` (query, item, score), the popular items.

    With ``folder``, pools, lists and per-query metrics are written there once, and each table is made from these files.

    ValueError for a re-ranker whose base method is not among the pool methods.
    """
    if lost := sorted(r.name for r in rerankers if r.base_method not in pool_methods):
        raise ValueError(f"pools of the base methods are absent for: {lost}")
    frozen = pool_table(rows, query, item).where(F.col("method").isin(list(pool_methods)) & (F.col("rank") <= k_retrieval))
    popular = long_pools({REFERENCE: reference}, query, item).where(F.col("rank") <= k_retrieval)
    pool = _kept(frozen.unionByName(popular.select(frozen.columns)), "pools", folder)
    lists = ranked_lists(pool, catalog, rerankers, query, item)
    lists = _kept(lists.where(F.col("rank") <= max(k_final, k_personalization)), "lists", folder)
    per = _kept(ranking_metrics(lists, pool, positives, examples, query, item, k_final, k_retrieval), "ranking", folder)
    by_decile = _kept(popularity_deciles(positives, catalog, query, item), "deciles", folder)
    guarded = _kept(guarded_lists(lists, catalog, examples, positives, by_decile, query, item, k_personalization), "guards", folder)
    return {"ranking": per, **ranking_tables(per, guarded, catalog.count(), by_decile, query)}


def run_history(runs: Mapping[str, DataFrame], timestamps: Mapping[str, str]) -> DataFrame:
    """Tables of several runs as one, with ``run`` and ``run_ts``, in the order of time; columns that a run lacks are null."""
    frames = [df.withColumns({"run": F.lit(n), "run_ts": F.to_timestamp(F.lit(timestamps[n]))}) for n, df in runs.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames).orderBy("run_ts", "run")
