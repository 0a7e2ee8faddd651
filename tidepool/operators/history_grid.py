"""The grid of history blends on given pools: a row per query, all configurations of a batch of queries at once.

A query brings its vector, its ``top_k`` nearest history vectors for the largest top_k, its pool's vectors and which of
these items are positives; a task blends, scores, ranks and measures them as matrices and sends sums, so that there is no
row for a configuration's pool.  Scores are rounded to 9 digits, and equal ones are ordered by item id.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.functions import vectors as V
from tidepool.operators.windows import cap_per_group

METRICS = ("hit", "precision", "recall", "ap", "ndcg", "mrr")
#: Scores that are compared at once.
AT_ONCE = 1_000_000


def _padded(lists: pa.ListArray, width: int, dims: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Lists of rows of ``dims`` numbers as (list, width, dims) with zeros at the end, and the lists' numbers of rows."""
    size = np.diff(lists.offsets.to_numpy()) // dims
    held = np.arange(width) < size[:, None]
    out = np.zeros((len(size), width, dims))
    out[held] = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)
    return out, size


def _unit(x: np.ndarray) -> np.ndarray:
    n = np.sqrt((x * x).sum(axis=-1, keepdims=True))
    return np.where(n <= V.EPS, x, x / np.maximum(n, V.EPS))


def batch_sums(b: pa.RecordBatch, configs: Sequence[dict], k: int) -> np.ndarray:
    """(configuration, metric) sums over the queries of a batch (vector, near, history, pool, relevant, n_pos)."""
    q = _padded(b["vector"], 1, dims := len(b["vector"][0]))[0][:, 0]
    width = max(1, int(np.diff(b["near"].offsets.to_numpy()).max()))
    (near, n_near), (past, _) = _padded(b["near"], width), _padded(b["history"], width, dims)
    near, nth = near[:, :, 0], np.arange(width)[None, :]
    most = max(1, int(np.diff(b["relevant"].offsets.to_numpy()).max()))
    (pool, n_pool), (rel, _) = _padded(b["pool"], most, dims), _padded(b["relevant"], most)
    outside, rel, n_pos = np.arange(most) >= n_pool[:, None], rel[:, :, 0], b["n_pos"].to_numpy().astype(np.float64)
    gain = 1 / np.log2(np.arange(2, k + 2))
    ideal = np.cumsum(gain)[np.minimum(n_pos, k).astype(int) - 1]
    plain, blended, out = _unit(q), {}, np.zeros((len(configs), len(METRICS)))
    for n, c in enumerate(configs):
        cut = (c["min_similarity"], c["top_k"])
        if cut not in blended:
            held = (nth < n_near[:, None]) & (near >= cut[0]) & (nth < cut[1])
            w = np.where(held, np.maximum(near, 0.0), 0.0)
            w = np.where(w.sum(axis=1, keepdims=True) > 0, w, held)  # equal weights if all are 0
            blended[cut] = _unit(np.einsum("uh,uhd->ud", w, past)), held.any(axis=1, keepdims=True)
        h, some = blended[cut]
        alpha = min(max(c["alpha"], 0.0), 1.0)
        v = np.where(some, _unit((1 - alpha) * q + alpha * h), plain)
        s = np.round(np.einsum("upd,ud->up", pool, v), 9)
        s[outside | np.isnan(s)] = -np.inf
        order = np.argsort(-s, axis=1, kind="stable")[:, :k]
        r = np.take_along_axis(rel, order, axis=1)
        g, place, any_ = gain[: r.shape[1]], np.arange(1, r.shape[1] + 1), r.any(axis=1)
        found = r.sum(axis=1)
        ap = (r * np.cumsum(r, axis=1) / place).sum(axis=1) / n_pos
        mrr = np.where(any_, 1 / (r.argmax(axis=1) + 1), 0.0)
        out[n] = [x.sum() for x in (any_.astype(float), found / k, found / n_pos, ap, (r * g).sum(axis=1) / ideal, mrr)]
    return out


def history_grid_metrics(queries: DataFrame, history: DataFrame, pool: DataFrame, vectors: DataFrame, positives: DataFrame, query: str, item: str, configs: Sequence[dict], k: int = 10) -> DataFrame:
    """Mean metrics of every configuration (alpha, min_similarity, top_k), with a column for each parameter, as ``ranking.grid_metrics`` gives.

    ``queries``: query, vector; ``history``: query, item, item_vector; ``pool``: query, item, of a bounded number a query;
    ``vectors``: item, item_vector; ``positives``: distinct (query, item).  Queries without positives are left out first.
    """
    wanted = positives.groupBy(query).agg(F.collect_list(item).alias("wanted"))
    near = queries.join(wanted.select(query), query, "left_semi").join(history, query).select(query, item, "item_vector", F.round(V.cosine(F.col("vector"), F.col("item_vector")), 9).alias("c"), V.cosine(F.col("vector"), F.col("item_vector")).alias("exact"))
    near = cap_per_group(near, query, [F.col("c").desc(), F.col(item)], max(c["top_k"] for c in configs))
    near = near.groupBy(query).agg(F.array_sort(F.collect_list(F.struct((-F.col("c")).alias("c"), item, "exact", V.doubles(F.col("item_vector")).alias("v")))).alias("h"))
    held = pool.join(wanted.select(query), query, "left_semi").select(query, item).join(vectors.select(item, V.doubles(F.col("item_vector")).alias("v")), item)
    held = held.groupBy(query).agg(F.array_sort(F.collect_list(F.struct(item, "v"))).alias("p"))  # a pool is bounded
    none = F.array().cast("array<double>")
    of = lambda c, x: F.transform(c, lambda z: z[x])
    rows = held.join(wanted, query).join(queries.select(query, V.doubles(F.col("vector")).alias("vector")), query).join(near, query, "left").select(
        "vector", F.coalesce(of("h", "exact"), none).alias("near"), F.coalesce(F.flatten(of("h", "v")), none).alias("history"), F.flatten(of("p", "v")).alias("pool"),
        F.transform("p", lambda x: F.array_contains("wanted", x[item]).cast("double")).alias("relevant"), F.size("wanted").cast("long").alias("n_pos"),
    )
    configs = [dict(c) for c in configs]

    def task(batches):
        n, total = 0, np.zeros((len(configs), len(METRICS)))
        for b in batches:
            step = max(1, AT_ONCE // max(1, len(b["relevant"].flatten()) // max(1, b.num_rows)))
            for a in range(0, b.num_rows, step):
                part = b.slice(a, step)
                part = part.take(pa.array(np.arange(part.num_rows)))  # lists from their own start
                n, total = n + part.num_rows, total + batch_sums(part, configs, k)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(configs), dtype=np.int32)), *(pa.array(x) for x in total.T), pa.array([n] * len(configs), pa.int64())], names=["config", *METRICS, "n"])

    sums = rows.mapInArrow(task, f"config int, {', '.join(f'{m} double' for m in METRICS)}, n long").groupBy("config")
    means = sums.agg(*((F.sum(m) / F.sum("n")).alias(m) for m in METRICS), F.sum("n").alias("n"))
    values = F.array(*(F.struct(*(F.lit(v).alias(n) for n, v in c.items())) for c in configs))
    return means.select("config", values[F.col("config")].alias("c"), *METRICS, "n").select("config", "c.*", *METRICS, "n")
