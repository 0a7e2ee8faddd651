"""Scoring of queries against a catalog, and pools of the best."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepool.functions import vectors as V
from tidepool.functions.hashing import stable_uniform
from tidepool.operators.pruned import pruned_pairs
from tidepool.operators.windows import ranked

#: A catalog is broadcast, and a block of items is scored at once, up to this many items times dimensions.
CATALOG_CELLS = 4_000_000
#: Queries that meet a block of items in one task.
SLICE_QUERIES = 4096
#: For pools, every item is scored up to this many; of more, those that may be among the best.
MOST_SCORED = 32_768


def popularity(events: DataFrame, catalog: DataFrame, item: str, floor: float = 1e-6, flag: str | None = None) -> DataFrame:
    """Catalog items with ``pop``: their events (those with ``flag`` 1, if it is named), at least ``floor``.  Give training events only."""
    if flag is not None:
        events = events.where(F.col(flag) == 1)
    n = events.groupBy(item).agg(F.count(F.lit(1)).alias("__n"))
    return catalog.join(n, item, "left").withColumn("pop", F.greatest(F.coalesce(F.col("__n"), F.lit(0)).cast("double"), F.lit(floor))).drop("__n")


def best_of_block(names: pa.Array, mine: pa.Array, vectors: np.ndarray, items: np.ndarray, matrix: np.ndarray, mask: bool, k: int | None) -> list[pa.Array]:
    """names, items and scores of the pairs of some queries and a block of ``items`` (ascending), or of the k best of each; with ``mask``, without the query's own item."""
    s = np.round(vectors @ matrix.T, 12)
    if mask:
        at = np.searchsorted(items, own_ids := mine.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
        held = (at < len(items)) & (items[np.minimum(at, len(items) - 1)] == own_ids) & mine.is_valid().to_numpy(zero_copy_only=False)
        s[np.flatnonzero(held), at[held]] = -np.inf
    r, c = best_of_rows(s, k)
    return [names.take(pa.array(r)), pa.array(items[c]), pa.array(s[r, c])]


def best_of_rows(s: np.ndarray, k: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of each row's k largest finite numbers, of equal ones the first, or of all of them."""
    if k is not None and k < s.shape[1]:
        least = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k]
        over, tied = s > least[:, None], s == least[:, None]
        r, c = np.nonzero(over | (tied & (np.cumsum(tied, axis=1) <= (k - over.sum(axis=1))[:, None])))
    else:
        r, c = np.nonzero(np.ones(s.shape, dtype=bool))
    keep = np.isfinite(s[r, c])
    return r[keep], c[keep]


def _scores(queries: DataFrame, catalog: DataFrame, query: str, item: str, own: str | None, mask: bool, k: int | None, cells: int) -> DataFrame:
    """query, item, score of every pair, or of the k best items by score, then id.

    A small catalog (by a count) goes to the tasks as one matrix.  Of a large one,
    the k best are found by ``pruned``, which scores the pairs that may be among them;
    for all pairs, a slice of the queries and a block of the items meet in a task, by
    key, so that neither side is ever whole in one task and a task scores a bounded
    matrix.  Scores are rounded to 12 digits, so that the order of sums decides no tie.
    """
    dims = catalog.select(F.max(F.size("vector")).alias("d"), F.count(F.lit(1)).alias("n")).first()
    size, spark = (dims["d"] or 0) * dims["n"], catalog.sparkSession
    kind = queries.schema[query].dataType.simpleString()
    schema = f"{query} {kind}, {item} long, score double"

    def score(names: pa.Array, mine: pa.Array, vectors: np.ndarray, items: np.ndarray, matrix: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(best_of_block(names, mine, vectors, items, matrix, mask, k), names=[query, item, "score"])

    left = queries.select(query, F.col(own or item).cast("long").alias("__own"), V.unit(F.col("vector")).alias("__v"))
    right = catalog.select(F.col(item).cast("long").alias("__i"), V.unit(F.col("vector")).alias("__m"))
    if k is not None and (size > cells or dims["n"] > MOST_SCORED):
        return pruned_pairs(left, right, query, item, mask, k, dims["n"], dims["d"], cells)
    if size <= cells:
        rows = right.orderBy("__i").collect()  # at most ``cells`` numbers
        shared = spark.sparkContext.broadcast((np.array([r["__i"] for r in rows], dtype=np.int64), np.array([r["__m"] for r in rows], dtype=np.float64).reshape(len(rows), dims["d"] or 0)))

        def all_items(batches):
            items, matrix = shared.value
            step = max(1, min(256, 4_000_000 // max(len(items), 1)))
            for b in batches:
                for a in range(0, b.num_rows if len(items) else 0, step):
                    part = b.slice(a, step)
                    yield score(part.column(0), part.column(1), _matrix(part.column(2)), items, matrix)

        return left.mapInArrow(all_items, schema)
    blocks = -(-size // cells)
    slices = max(1, -(-queries.count() // SLICE_QUERIES))
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = left.withColumn("__s", F.pmod(F.xxhash64(query), F.lit(slices)).cast("int")).withColumn("__b", spread(blocks))
    right = right.withColumn("__b", F.pmod(F.xxhash64("__i"), F.lit(blocks)).cast("int")).withColumn("__s", spread(slices))

    def cell(asked: pa.Table, held: pa.Table) -> pa.Table:
        out = []
        if asked.num_rows and held.num_rows:
            held = held.sort_by("__i").combine_chunks()
            items, matrix = held["__i"].to_numpy(), _matrix(held["__m"])
            for b in asked.combine_chunks().to_batches(max_chunksize=max(1, min(256, 4_000_000 // len(items)))):
                out.append(score(b["__q"], b["__own"], _matrix(b["__v"]), items, matrix))
        empty = pa.schema([(query, asked.schema.field("__q").type), (item, pa.int64()), ("score", pa.float64())])
        return pa.Table.from_batches(out, empty)

    left = left.withColumnRenamed(query, "__q")
    return left.groupBy("__s", "__b").cogroup(right.groupBy("__s", "__b")).applyInArrow(cell, schema)


def _matrix(lists: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Vectors of one length as rows."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), -1 if len(lists) else 0)


def cosine_pairs(queries: DataFrame, catalog: DataFrame, query: str, item: str, own: str | None = None, mask: bool = True, cells: int = CATALOG_CELLS) -> DataFrame:
    """Every query against every item: query, item, score; the query's own item is left out (``own``: its column).  For pools, use ``cosine_pool``."""
    return _scores(queries, catalog, query, item, own, mask, None, cells)


def cosine_pool(queries: DataFrame, catalog: DataFrame, query: str, item: str, k: int = 100, own: str | None = None, mask: bool = True, cells: int = CATALOG_CELLS) -> DataFrame:
    """The k best items of each query by cosine: query, item, score, rank.  Only k rows a query leave the scoring tasks."""
    return ranked(_scores(queries, catalog, query, item, own, mask, k, cells), query, F.col("score"), [F.col(item)]).where(F.col("rank") <= k)


def constant_scores(queries: DataFrame, items: DataFrame, query: str, item: str, score: Column, own: str | None = None, cells: int = CATALOG_CELLS) -> DataFrame:
    """A score per item (popularity) or per pair (random) for every query but its own item.

    Few items (by a count) are broadcast; of more, slices of queries meet blocks of items by key.
    """
    left, n = queries.select(query, F.col(own or item).alias("__own")), items.count()
    most = max(1, cells // 64)
    if n <= most:
        pairs = left.join(F.broadcast(items), F.lit(True))
    else:
        blocks, slices = -(-n // most), max(1, -(-queries.count() // SLICE_QUERIES))
        left = left.withColumn("__s", F.pmod(F.xxhash64(query), F.lit(slices))).withColumn("__b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        right = items.withColumn("__b", F.pmod(F.xxhash64(item), F.lit(blocks)).cast("int")).withColumn("__s", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
        pairs = left.join(right, ["__s", "__b"])
    return pairs.where(~F.col("__own").eqNullSafe(F.col(item))).select(query, F.col(item).cast("long").alias(item), score.alias("score"))


def constant_sums(queries: DataFrame, items: DataFrame, query: str, item: str, score: str, own: str | None = None) -> DataFrame:
    """query, n, items, score: how many items ``constant_scores`` pairs with a query, the sum of their ids and that of their scores (to 12 decimals).

    What is the same for all queries is summed once, and the query's own item is taken off: no row per pair.
    """
    of = [F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.col(item).cast("long")), F.lit(0)).alias("items"), F.coalesce(F.sum(F.col(score).cast("decimal(38,12)")), F.lit(0)).alias("score")]
    mine = items.groupBy(F.col(item).alias("__i")).agg(*of)
    left = queries.select(query, F.col(own or item).alias("__own"))
    both = left.join(mine, F.col("__own").eqNullSafe(F.col("__i")), "left").crossJoin(F.broadcast(items.agg(*of).toDF("__n", "__items", "__score")))
    less = [(F.col(f"__{c}") - F.coalesce(c, F.lit(0))).alias(c) for c in ("n", "items", "score")]
    return both.select(query, *less).where("n > 0").groupBy(query).agg(*(F.sum(c).alias(c) for c in ("n", "items", "score")))


def constant_pool(queries: DataFrame, items: DataFrame, query: str, item: str, score: str, k: int = 100, own: str | None = None) -> DataFrame:
    """The k best items of a score that is the same for all queries, but the query's own: of the k + 1 best overall, which are broadcast."""
    best = items.select(F.col(item).cast("long").alias(item), F.col(score).cast("double").alias("score")).orderBy(F.col("score").desc_nulls_last(), item).limit(k + 1)
    pairs = queries.select(query, F.col(own or item).alias("__own")).join(F.broadcast(best), F.lit(True)).where(~F.col("__own").eqNullSafe(F.col(item)))
    return ranked(pairs.drop("__own"), query, F.col("score"), [F.col(item)]).where(F.col("rank") <= k)


def random_score(seed: int, query: str, item: str) -> Column:
    return stable_uniform(seed, F.col(query).cast("string"), F.col(item))


def pool(scores: DataFrame, query: str, item: str, k: int = 100, excluded: DataFrame | None = None) -> DataFrame:
    """The k best items of each query: query, item, score, rank; ``excluded``: (query, item) rows to pass over."""
    if excluded is not None:
        scores = scores.join(excluded.select(query, item), [query, item], "left_anti")
    return ranked(scores, query, F.col("score"), [F.col(item)]).where(F.col("rank") <= k)


def pool_rows(pools: DataFrame, query: str, item: str, method: str) -> DataFrame:
    """A row per query with its pool as JSON arrays, best first.  A pool has a fixed size, so a group is bounded."""
    best = F.array_sort(F.collect_list(F.struct("rank", F.col(item).alias("i"), "score")))
    return pools.groupBy(query).agg(best.alias("b")).select(query, F.lit(method).alias("pool_method"), F.to_json(F.transform("b", lambda s: s["i"])).alias("retrieved_app_ids_json"), F.to_json(F.transform("b", lambda s: s["score"])).alias("retrieved_scores_json"))


def chunk_scores(queries: DataFrame, chunks: DataFrame, query: str, item: str, variant: str, own: str | None = None, k: int | None = None, cells: int = CATALOG_CELLS) -> DataFrame:
    """Cosine distance to the items' vectors of one variant, negated: query, item, score (-distance); items without one are absent."""
    held = chunks.where(F.col("variant") == variant).select(item, "vector")
    got = cosine_pairs(queries, held, query, item, own, cells=cells) if k is None else cosine_pool(queries, held, query, item, k, own, cells=cells)
    return got.withColumn("score", -(1 - F.col("score")))



def cascade(queries: DataFrame, catalog: DataFrame, query: str, item: str, session: str, m: int, k: int, own: str | None = None, cells: int = CATALOG_CELLS) -> DataFrame:
    """Two stages: the m best items by ``vector`` (habit), of which the k best by the ``session`` vector: query, item, score, rank, habit_score."""
    pool = cosine_pool(queries, catalog, query, item, m, own, cells=cells).select(query, item, F.col("score").alias("habit_score"))
    pool = pool.join(queries.select(query, F.col(session).alias("__s")), query).join(catalog.select(F.col(item).cast("long").alias(item), "vector"), item)
    scored = pool.select(query, item, "habit_score", F.round(V.cosine(F.col("__s"), F.col("vector")), 12).alias("score"))
    return ranked(scored, query, F.col("score"), [F.col(item)]).where(F.col("rank") <= k)


def interest_pool(interests: DataFrame, catalog: DataFrame, query: str, item: str, k: int = 100, own: str | None = None, cells: int = CATALOG_CELLS) -> DataFrame:
    """Pools of queries with several vectors (query, cluster, vector): an item's score is its largest cosine to one of them.

    An item among the k best by the largest is among the k best of that vector, so the vectors' pools hold all that is needed.
    """
    each = interests.select(F.struct(query, "cluster").alias("__interest"), F.col(own or item).alias(own or item), "vector")
    best = cosine_pool(each, catalog, "__interest", item, k, own, cells=cells)
    best = best.groupBy(F.col(f"__interest.{query}").alias(query), item).agg(F.max("score").alias("score"))
    return ranked(best, query, F.col("score"), [F.col(item)]).where(F.col("rank") <= k)


def tower_pool(queries: DataFrame, catalog: DataFrame, query: str, item: str, query_tower: list[list[float]], item_tower: list[list[float]], k: int = 100, own: str | None = None, cells: int = CATALOG_CELLS) -> DataFrame:
    """Pools by cosine after both sides are projected by their tower's matrix (rows: outputs)."""
    q = queries.withColumn("vector", V.project(F.col("vector"), query_tower))
    return cosine_pool(q, catalog.withColumn("vector", V.project(F.col("vector"), item_tower)), query, item, k, own, cells=cells)


#: name -> function(queries, catalog, query, item, k) giving a pool: query, item, score, rank.
#: ``catalog`` holds item, vector and pop, and for some methods tower_vector or profile_vector; ``queries`` query, its own item,
#: and vector or what the method names: train_mean_vector, fused_vector, tower_vector (projected by the towers), described_vector
#: (of the query's text with its item's description), blended_vector (``pooling.blended_with_own``).
Scorer = Callable[[DataFrame, DataFrame, str, str, int], DataFrame]


def _with(column: str, q: DataFrame) -> DataFrame:
    return q.withColumn("vector", F.col(column))


def _profiles(column: str) -> Scorer:
    """Distances of a query vector to the items' profile vectors, negated; items without a profile are absent."""
    return lambda q, c, query, item, k: cosine_pool(_with(column, q), _with("profile_vector", c).where(F.col("vector").isNotNull()), query, item, k).withColumn("score", -(1 - F.col("score")))


SCORERS: dict[str, Scorer] = {
    "raw": lambda q, c, query, item, k: cosine_pool(q, c, query, item, k),
    "multi_mean_train": lambda q, c, query, item, k: cosine_pool(_with("train_mean_vector", q), c, query, item, k),
    "fusion_c_raw_plus_behavior": lambda q, c, query, item, k: cosine_pool(_with("fused_vector", q), c, query, item, k),
    "two_tower_v1": lambda q, c, query, item, k: cosine_pool(_with("tower_vector", q), _with("tower_vector", c), query, item, k),
    "rag_chunk_v1_raw_query": _profiles("vector"),
    "rag_chunk_v1_query_plus_desc": _profiles("described_vector"),
    "rag_chunk_v1_vector_blend_query": _profiles("blended_vector"),
    "popularity_train": lambda q, c, query, item, k: constant_pool(q, c, query, item, "pop", k),
    "random": lambda q, c, query, item, k: pool(constant_scores(q, c.select(item), query, item, random_score(2026, query, item)), query, item, k),
}


def registered_pools(queries: DataFrame, catalog: DataFrame, query: str, item: str, methods: list[str], k: int = 100) -> dict[str, DataFrame]:
    """The pools of registered methods by name; KeyError for an unknown one."""
    if unknown := sorted(set(methods) - set(SCORERS)):
        raise KeyError(f"unknown methods: {unknown}; known: {sorted(SCORERS)}")
    return {m: SCORERS[m](queries, catalog, query, item, k) for m in methods}
