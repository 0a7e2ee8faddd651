"""Two linear towers, learnt by in-batch contrast: a query and its positives near, a block's other items far.

Pairs (query, positive item) are dealt into blocks of some ``BLOCK`` by a hash of the pair,
once, so that a query with very many positives lies in many blocks; a block is one row of a
table, and the negatives of its pairs are its other items.  The loss of a block is the mean of
the query side's and the item side's cross-entropy over the cosines of projected vectors,
where all items of a query's group in the block count as its positives.  ``descent`` sums
losses and gradients over the blocks, so a step is the same however it is dealt out or repeated.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.functions import vectors as V
from tidepool.operators.descent import minimize, objective

BLOCK, TEMPERATURE, SEED = 256, 0.07, 2026
#: The least temperature at which exp(-2 / temperature), the least exponential of a block, is far from vanishing.
LEAST_SHARED = 0.01


@dataclass(frozen=True)
class Towers:
    """Matrices of the query and the item tower (rows: outputs), as ``retrieval.tower_pool`` takes them."""

    query: np.ndarray
    item: np.ndarray
    losses: list[float]

    def queries(self, df: DataFrame, vector: str = "vector", out: str = "tower_vector") -> DataFrame:
        return df.withColumn(out, V.project(F.col(vector), self.query.tolist()))

    def items(self, df: DataFrame, vector: str = "vector", out: str = "tower_vector") -> DataFrame:
        return df.withColumn(out, V.project(F.col(vector), self.item.tolist()))


def contrastive_blocks(pairs: DataFrame, group: str, query_vector: str, item_vector: str, key: list[str], block: int = BLOCK) -> DataFrame:
    """Pairs in blocks: groups, q and v, the block's rows one after another, in the order of ``key`` (which tells pairs apart).

    A block holds ``block`` pairs on average, by hash, so its size is bounded; each is one row.
    """
    n = max(1, -(-pairs.count() // block))
    name = F.pmod(F.xxhash64(*key, F.lit("block")), F.lit(n)).cast("int")
    one = F.struct(*key, F.xxhash64(group).alias("g"), V.doubles(F.col(query_vector)).alias("q"), V.doubles(F.col(item_vector)).alias("v"))
    rows = pairs.groupBy(name.alias("block")).agg(F.sort_array(F.collect_list(one)).alias("r"))
    of = lambda c: F.transform("r", lambda x: x[c])
    return rows.select("block", of("g").alias("groups"), F.flatten(of("q")).alias("q"), F.flatten(of("v")).alias("v"))


def _unit(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-12)
    return x / n, n


def _softmax(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row by row: probabilities and the logarithm of the sum of exponentials."""
    top = z.max(axis=1, keepdims=True)
    e = np.exp(z - top)
    total = e.sum(axis=1, keepdims=True)
    return e / total, (np.log(total) + top)[:, 0]


def _far_loss(z: np.ndarray, same: np.ndarray) -> tuple[float, np.ndarray]:
    """The loss and its gradient to the scores where a common shift would not do: each row and column has its own."""
    loss, dz = 0.0, np.zeros_like(z)
    for turned in (False, True):
        s = z.T if turned else z
        p, log_all = _softmax(s)
        t, log_pos = _softmax(np.where(same, s, -np.inf))
        loss += 0.5 * float((log_all - log_pos).sum())
        dz += 0.5 * ((p - t).T if turned else p - t)
    return loss, dz


def block_loss(q: np.ndarray, v: np.ndarray, groups: np.ndarray, a: np.ndarray, b: np.ndarray, temperature: float) -> tuple[float, np.ndarray, np.ndarray]:
    """The sum over a block's pairs of both sides' losses, halved, and its gradients to both towers."""
    qp, vp = q @ a.T, v @ b.T
    (qu, qn), (vu, vn) = _unit(qp), _unit(vp)
    z = qu @ vu.T / temperature
    same = groups[:, None] == groups[None, :]
    if temperature >= LEAST_SHARED:  # no score is beyond 1 / temperature, so one table of exponentials serves both sides
        e = np.exp(z - 1 / temperature)
        held = np.where(same, e, 0.0)
        loss, dz = 0.0, np.zeros_like(z)
        for axis in (0, 1):
            whole, mine = e.sum(axis=axis, keepdims=True), held.sum(axis=axis, keepdims=True)
            loss += 0.5 * float((np.log(whole) - np.log(mine)).sum())
            dz += e * (0.5 / whole) - held * (0.5 / mine)
    else:
        loss, dz = _far_loss(z, same)
    dz /= temperature
    dq, dv = dz @ vu, dz.T @ qu
    dq = (dq - qu * (dq * qu).sum(axis=1, keepdims=True)) / qn
    dv = (dv - vu * (dv * vu).sum(axis=1, keepdims=True)) / vn
    return loss, dq.T @ q, dv.T @ v


def start_towers(dim: int, width: int, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Both towers begin near the same projection, so that untrained scores are close to cosines (equal at full width, but for the noise)."""
    rnd = np.random.default_rng(seed)
    base = np.eye(dim) if width == dim else np.linalg.qr(rnd.normal(size=(dim, max(width, dim))))[0][:, :width].T if width < dim else rnd.normal(size=(width, dim)) / width**0.5
    return base + rnd.normal(0, 0.01, (width, dim)), base + rnd.normal(0, 0.01, (width, dim))


def train_towers(blocks: DataFrame, dim: int, width: int | None = None, *, temperature: float = TEMPERATURE, steps: int = 20, ridge: float = 0.0, seed: int = SEED) -> Towers:
    """Towers of ``width`` outputs for vectors of length ``dim`` from ``contrastive_blocks``, written to files: each step reads them."""
    width = width or dim
    a, b = start_towers(dim, width, seed)

    def gradient(batch: pa.RecordBatch, w: np.ndarray) -> tuple[float, float, np.ndarray]:
        a, b = w.reshape(2, width, dim)
        n, loss, da, db = 0, 0.0, np.zeros_like(a), np.zeros_like(b)
        for g, q, v in zip(*(batch.column(c) for c in ("groups", "q", "v"))):
            groups = g.values.to_numpy()
            one, ga, gb = block_loss(q.values.to_numpy().reshape(len(groups), dim), v.values.to_numpy().reshape(len(groups), dim), groups, a, b, temperature)
            n, loss, da, db = n + len(groups), loss + one, da + ga, db + gb
        return float(n), loss, np.concatenate([da.ravel(), db.ravel()])

    fit = minimize(objective(blocks, gradient, ridge), np.concatenate([a.ravel(), b.ravel()]), steps)
    a, b = fit.weights.reshape(2, width, dim)
    return Towers(a, b, fit.losses)
