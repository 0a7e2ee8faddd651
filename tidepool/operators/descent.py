"""Fitting small models to large tables: gradients summed over tasks, L-BFGS on a bounded weight vector.

The table is an Arrow batch at a time in the tasks; a step sends the weights out and
brings one sum back.  Sums are taken in the order of the tasks' numbers, through a
layer of ``GROUPS`` partial sums, so a repeated attempt gives the same numbers, and
the driver adds ``GROUPS`` rows whatever the number of tasks.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GROUPS, MOST_WEIGHTS = 64, 1 << 20

#: (batch, weights) -> (number of terms, sum of losses, gradient of that sum).
Gradient = Callable[[pa.RecordBatch, np.ndarray], tuple[float, float, np.ndarray]]


def _row(part: int, values: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([values.tolist()], pa.list_(pa.float64()))], names=["part", "sums"])


def summed(rows: DataFrame, of_batch: Callable[[pa.RecordBatch], np.ndarray], size: int) -> np.ndarray:
    """The sum of ``of_batch`` (``size`` numbers) over all batches of ``rows``."""

    def partial(batches):
        total = np.zeros(size)
        for b in batches:
            if b.num_rows:
                total += of_batch(b)
        yield _row(TaskContext.get().partitionId(), total)

    def layer(batches):
        have: dict[int, np.ndarray] = {}
        for b in batches:
            for part, values in zip(b.column(0).to_pylist(), b.column(1)):
                x = values.values.to_numpy()
                have[part % GROUPS] = have[part % GROUPS] + x if part % GROUPS in have else x
        for group, x in have.items():
            yield _row(group, x)

    schema = "part int, sums array<double>"
    parts = rows.mapInArrow(partial, schema).repartition(F.col("part") % GROUPS).sortWithinPartitions("part").mapInArrow(layer, schema)
    out = np.zeros(size)
    for r in sorted(parts.collect(), key=lambda r: r["part"]):  # at most GROUPS rows
        out += np.array(r["sums"])
    return out


def objective(rows: DataFrame, gradient: Gradient, ridge: float = 0.0) -> Callable[[np.ndarray], tuple[float, np.ndarray]]:
    """weights -> (mean loss + ridge / 2 * |w|^2, its gradient) over ``rows``, which are read once a call: write them first."""

    def value(w: np.ndarray) -> tuple[float, np.ndarray]:
        if len(w) > MOST_WEIGHTS:
            raise ValueError(f"more than {MOST_WEIGHTS} weights")
        sent = rows.sparkSession.sparkContext.broadcast(w)

        def of_batch(b: pa.RecordBatch) -> np.ndarray:
            n, loss, g = gradient(b, sent.value)
            return np.concatenate([[n, loss], g])

        total = summed(rows, of_batch, len(w) + 2)
        sent.unpersist()
        n = max(total[0], 1.0)
        return float(total[1] / n + ridge / 2 * (w @ w)), total[2:] / n + ridge * w

    return value


@dataclass
class Fit:
    weights: np.ndarray
    losses: list[float] = field(default_factory=list)


def minimize(value: Callable[[np.ndarray], tuple[float, np.ndarray]], start: np.ndarray, steps: int, *, history: int = 8, tolerance: float = 1e-9, after: Callable[[int, np.ndarray], bool] | None = None) -> Fit:
    """L-BFGS with backtracking: the weights, and the loss at the start and after each step.

    It ends early where the loss no longer falls by ``tolerance``, or where ``after(step, weights)`` says so.
    """
    w, pairs = start.astype(np.float64), []
    loss, g = value(w)
    fit = Fit(w, [loss])
    for step in range(1, steps + 1):
        d, used = -g, []
        for s, y in reversed(pairs):
            a = (s @ d) / (s @ y)
            d = d - a * y
            used.append(a)
        if pairs:
            s, y = pairs[-1]
            d = d * (s @ y) / (y @ y)
        else:
            d = d / max(1.0, float(np.sqrt(g @ g)))
        for (s, y), a in zip(pairs, reversed(used)):
            d = d + s * (a - (y @ d) / (s @ y))
        slope, rate = float(g @ d), 1.0
        if slope >= 0:
            break
        for _ in range(20):
            new, g_new = value(w + rate * d)
            if new <= loss + 1e-4 * rate * slope:
                break
            rate /= 2
        else:
            break
        s, y = rate * d, g_new - g
        if s @ y > 1e-12 * (y @ y):
            pairs = [*pairs, (s, y)][-history:]
        w, g, fell, loss = w + rate * d, g_new, loss - new, new
        fit.weights, fit.losses = w, [*fit.losses, loss]
        if (after is not None and after(step, w)) or fell < tolerance:
            break
    return fit
