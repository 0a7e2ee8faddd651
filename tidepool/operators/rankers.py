"""Rankers of pools that learn: a small network on each row's features, fitted by row or by list.

``pointwise``: class-weighted cross-entropy of each row's label; ``listwise``: cross-entropy
between the softmax of a list and the uniform distribution over its positives (lists without
one are left out).  The network (features -> hidden, ReLU -> 1) has some hundred weights; it
is fitted by ``descent`` over lists that ``padded_lists`` makes, and scores rows as a column
expression, so scoring needs no Python.  There is no dropout: ``ridge`` holds weights down,
and a tuning set stops the fit.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepool.functions.lists import PaddedLists  # noqa: F401  the same as a table function, for SQL
from tidepool.operators import classification as K
from tidepool.operators import metrics as M
from tidepool.operators.descent import Fit, minimize, objective
from tidepool.operators.ranking import PoolReranker
from tidepool.operators.windows import ranked

KINDS = ("pointwise", "listwise")
HIDDEN, LIST_LENGTH, SEED = 16, 100, 2027


@dataclass(frozen=True)
class Network:
    """features -> hidden (ReLU) -> a score; ``shift`` and ``scale`` bring features to mean 0 and deviation 1."""

    features: tuple[str, ...]
    hidden: int
    weights: np.ndarray
    shift: np.ndarray
    scale: np.ndarray
    losses: list[float] = field(default_factory=list)
    tuned: list[float] = field(default_factory=list)

    def parts(self, w: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        return split_weights(self.weights if w is None else w, len(self.features), self.hidden)

    def column(self) -> Column:
        """The score as an expression over the feature columns; null features count as their mean."""
        a, b, c, d = self.parts()
        x = [F.coalesce((F.col(f).cast("double") - float(m)) / float(s), F.lit(0.0)) for f, m, s in zip(self.features, self.shift, self.scale)]
        units = [F.greatest(F.lit(0.0), sum((v * float(u) for v, u in zip(x, row)), F.lit(float(bias)))) for row, bias in zip(a, b)]
        return sum((u * float(v) for u, v in zip(units, c)), F.lit(float(d)))

    def reranker(self, name: str, base_method: str) -> PoolReranker:
        """It as a re-ranking of a method's pools, which hold score and pop."""
        return PoolReranker(name, base_method, lambda p, q: pool_features(p).withColumn("final", self.column()).drop(*(f for f in FEATURES if f not in p.columns)))


#: Features of a pool's rows; fixed names.
FEATURES = ("retr_score", "log_pop")


def pool_features(pool: DataFrame, score: str = "score", pop: str = "pop") -> DataFrame:
    return pool.withColumns({"retr_score": F.col(score).cast("double"), "log_pop": F.log1p(F.col(pop).cast("double"))})


def labelled(pool: DataFrame, positives: DataFrame, query: str, item: str) -> DataFrame:
    """Pool rows with ``label``: 1 for the query's positives."""
    p = positives.select(query, item).distinct().withColumn("label", F.lit(1.0))
    return pool.join(p, [query, item], "left").withColumn("label", F.coalesce("label", F.lit(0.0)))


def padded_lists(pool: DataFrame, query: str, item: str, label: str, features: Sequence[str], length: int = LIST_LENGTH) -> DataFrame:
    """A row per query: query, list_len, items, x, y: the rows of the table function ``PaddedLists``, made without Python, as pools are large."""
    number = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    rows = pool.withColumn("__place", F.row_number().over(Window.partitionBy(query).orderBy("rank", item))).where(F.col("__place") <= length)
    one = F.struct("__place", F.col(item).cast("long").alias("i"), F.array(*(number(f) for f in features)).alias("x"), number(label).alias("y"))
    lists = rows.groupBy(query).agg(F.array_sort(F.collect_list(one)).alias("r")).withColumn("list_len", F.size("r"))  # ``length`` rows at most
    of, empty = lambda c: F.transform("r", lambda z: z[c]), length - F.col("list_len")
    x = F.concat(F.flatten(of("x")), F.array_repeat(F.lit(0.0), (empty * len(features)).cast("int")))
    return lists.select(query, "list_len", of("i").alias("items"), x.alias("x"), F.concat(of("y"), F.array_repeat(F.lit(0.0), empty.cast("int"))).alias("y"))


# -- losses of a batch of lists ------------------------------------------------------


def split_weights(w: np.ndarray, n: int, hidden: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    a, b, c = np.split(w[:-1], [n * hidden, (n + 1) * hidden])
    return a.reshape(hidden, n), b, c, w[-1]


def n_weights(n: int, hidden: int) -> int:
    return hidden * (n + 2) + 1


def start_weights(n: int, hidden: int, seed: int = SEED) -> np.ndarray:
    rnd = np.random.default_rng(seed)
    return np.concatenate([rnd.normal(0, (2 / n) ** 0.5, n * hidden), np.zeros(hidden), rnd.normal(0, (1 / hidden) ** 0.5, hidden), [0.0]])


def scores(x: np.ndarray, w: np.ndarray, hidden: int) -> tuple[np.ndarray, Callable[[np.ndarray], np.ndarray]]:
    """Scores of rows of features, and the function from the scores' gradient to the weights'."""
    a, b, c, d = split_weights(w, x.shape[1], hidden)
    h = x @ a.T + b
    on = h > 0
    h = np.where(on, h, 0.0)

    def back(dz: np.ndarray) -> np.ndarray:
        dh = np.where(on, np.outer(dz, c), 0.0)
        return np.concatenate([(dh.T @ x).ravel(), dh.sum(axis=0), h.T @ dz, [dz.sum()]])

    return h @ c + d, back


def list_loss(x: np.ndarray, y: np.ndarray, held: np.ndarray, w: np.ndarray, hidden: int) -> tuple[float, float, np.ndarray]:
    """(lists, loss, gradient) of lists (list, position, feature), their labels, and which positions are filled."""
    n, length, width = x.shape
    z, back = scores(x.reshape(-1, width), w, hidden)
    z = np.where(held, z.reshape(n, length), -np.inf)
    some = (y * held).sum(axis=1) > 0
    top = np.where(held.any(axis=1), z.max(axis=1), 0.0)
    e = np.exp(z - top[:, None])
    total = np.where(some, e.sum(axis=1), 1.0)
    target = np.where(some[:, None] & held, y, 0.0) / np.where(some, (y * held).sum(axis=1), 1.0)[:, None]
    log_p = np.where(held, z - top[:, None], 0.0) - np.log(total)[:, None]
    loss = -(target * log_p).sum()
    dz = np.where(some[:, None], e / total[:, None] - target, 0.0)
    return float(some.sum()), float(loss), back(dz.ravel())


def row_loss(x: np.ndarray, y: np.ndarray, held: np.ndarray, w: np.ndarray, hidden: int, weight: tuple[float, float]) -> tuple[float, float, np.ndarray]:
    """(rows, loss, gradient) of the filled rows, each weighted by its class."""
    x, y = x[held], y[held]
    z, back = scores(x, w, hidden)
    k = np.where(y > 0, weight[1], weight[0])
    loss = k * (np.logaddexp(0.0, z) - y * z)
    return float(len(y)), float(loss.sum()), back(k * (1 / (1 + np.exp(-np.clip(z, -500, 500))) - y))


def arrays(batch: pa.RecordBatch, width: int, shift: np.ndarray, scale: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, labels and filled positions of a batch of padded lists."""
    y = batch.column("y").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
    x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(*y.shape, width)
    held = np.arange(y.shape[1]) < batch.column("list_len").to_numpy()[:, None]
    return (x - shift) / scale, y, held


# -- fitting ------------------------------------------------------------------------------


def train_ranker(lists: DataFrame, rows: DataFrame, kind: str, features: Sequence[str] = FEATURES, label: str = "label", *, hidden: int = HIDDEN, steps: int = 20, ridge: float = 1e-4, seed: int = SEED, tune: Callable[[Network], float] | None = None, patience: int = 3) -> Network:
    """A network learnt from ``lists`` (``padded_lists``, written to files: each step reads them) and the ``rows`` they were made of.

    ``tune``: a network's quality; the best one is returned, and the fit ends when ``patience`` steps bring nothing better.
    """
    if kind not in KINDS:
        raise ValueError(f"unknown kind: {kind}")
    measured = rows.agg(*(F.avg(f).alias(f"m{i}") for i, f in enumerate(features)), *(F.stddev_pop(f).alias(f"s{i}") for i, f in enumerate(features))).first()
    shift = np.array([measured[f"m{i}"] or 0.0 for i in range(len(features))])
    scale = np.array([measured[f"s{i}"] or 1.0 for i in range(len(features))])
    if kind == "pointwise":
        weight = K.class_weights(rows, label).first()
        weight = (float(weight["w0"]), float(weight["w1"]))
    width = len(features)

    def gradient(batch: pa.RecordBatch, w: np.ndarray) -> tuple[float, float, np.ndarray]:
        x, y, held = arrays(batch, width, shift, scale)
        return list_loss(x, y, held, w, hidden) if kind == "listwise" else row_loss(x, y, held, w, hidden, weight)

    made = lambda w, fit=None: Network(tuple(features), hidden, w, shift, scale, list(fit.losses) if fit else [])
    best: dict = {"q": -np.inf, "w": None, "all": []}

    def after(step: int, w: np.ndarray) -> bool:
        q = tune(made(w))
        best["all"].append(q)
        if q > best["q"]:
            best.update(q=q, w=w, step=step)
        return step - best["step"] >= patience

    fit: Fit = minimize(objective(lists, gradient, ridge), start_weights(width, hidden, seed), steps, after=after if tune else None)
    w = fit.weights if best["w"] is None else best["w"]
    return Network(tuple(features), hidden, w, shift, scale, list(fit.losses), best["all"])


def mean_ndcg(pool: DataFrame, positives: DataFrame, query: str, item: str, k: int = 10) -> Callable[[Network], float]:
    """A network's mean NDCG at k on pools (query, item, features), as a tuning measure."""

    def of(network: Network) -> float:
        lists = ranked(pool.withColumn("final", network.column()), query, F.col("final"), [F.col(item)])
        return M.mean_table(M.ranking_metrics(lists, positives, query, item, k), [], ["ndcg"]).first()["ndcg"] or 0.0

    return of
