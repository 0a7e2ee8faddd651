"""Linear models on normalised features, group losses, random baselines, configuration grids."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepool.functions.hashing import stable_uniform


def _assembled(df: DataFrame, features: Sequence[str]) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    return VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="keep").transform(df.fillna(0.0, list(features)))


def fit_linear(train: DataFrame, features: Sequence[str], label: str):
    """Ordinary least squares."""
    from pyspark.ml.regression import LinearRegression

    return LinearRegression(featuresCol="features", labelCol=label).fit(_assembled(train, features))


def fit_logistic(train: DataFrame, features: Sequence[str], label: str, c: float = 1.0, rounds: int = 500):
    """Logistic regression with an L2 penalty of strength 1 / (C n), as per-row losses are averaged here; no standardising."""
    from pyspark.ml.classification import LogisticRegression

    df = _assembled(train, features)
    n = df.count()
    return LogisticRegression(featuresCol="features", labelCol=label, regParam=1.0 / (c * max(n, 1)), maxIter=rounds, standardization=False).fit(df)


def predicted(model, df: DataFrame, features: Sequence[str]) -> DataFrame:
    """``df`` with prediction, and score where the model gives probabilities."""
    from pyspark.ml.functions import vector_to_array

    out = model.transform(_assembled(df, features)).drop("features", "rawPrediction")
    return out.withColumn("score", vector_to_array("probability")[1]).drop("probability") if "probability" in out.columns else out


def random_by_rate(df: DataFrame, key: str, rate: float, seed: int) -> Column:
    """1 with the probability of the rate, by hash of the key."""
    return (stable_uniform(seed, "rate", F.col(key)) < rate).cast("int")


def random_by_distribution(df: DataFrame, train: DataFrame, key: str, value: str, seed: int, out: str = "draw") -> DataFrame:
    """Draws from the training values' distribution: each row's hash picks one of 1,001 (approximate) quantiles."""
    q = train.agg(F.percentile_approx(value, [i / 1000 for i in range(1001)], 100_000).alias("q")).first()["q"]
    at = F.floor(stable_uniform(seed, "draw", F.col(key)) * 1001).cast("int") + 1
    return df.withColumn(out, F.element_at(F.array(*(F.lit(x) for x in q)), at))


def group_cross_entropy(df: DataFrame, group: str, logit: str, label: str) -> DataFrame:
    """group, loss: -log of the softmax mass on each group's positives, shared equally; groups without positives are left out."""
    w = Window.partitionBy(group)
    z = F.col(logit) - F.max(logit).over(w)
    x = df.withColumns({"__l": z - F.log(F.sum(F.exp(z)).over(w)), "__t": F.col(label) / F.sum(label).over(w)})
    return x.where("__t IS NOT NULL").groupBy(group).agg((-F.sum(F.col("__t") * F.col("__l"))).alias("loss"))


def contrastive_loss(pairs: DataFrame, query: str, item: str, score: str, positive: str, temperature: float = 0.07) -> DataFrame:
    """One row: the symmetric multi-positive in-batch loss of a long score matrix (query, item, score, positive)."""
    x = pairs.withColumn("__z", F.col(score) / temperature)

    def side(key: str) -> DataFrame:
        w = Window.partitionBy(key)
        m = F.max("__z").over(w)
        e = x.withColumn("__e", F.exp(F.col("__z") - m))
        g = e.groupBy(key).agg(F.sum("__e").alias("a"), F.sum(F.when(F.col(positive) == 1, F.col("__e")).otherwise(0.0)).alias("p"))
        return g.where("p > 0").select((F.log("a") - F.log("p")).alias("loss"))

    q, i = side(query).agg(F.avg("loss").alias("q")), side(item).agg(F.avg("loss").alias("i"))
    return q.join(i, F.lit(True)).select(((F.col("q") + F.col("i")) / 2).alias("loss"))


def configurations(grid: Mapping[str, Sequence]) -> list[dict]:
    """All combinations of a grid, in order."""
    return [dict(zip(grid, values)) for values in product(*grid.values())]


def grid_search(grid: Mapping[str, Sequence], run: Callable[..., DataFrame]) -> DataFrame:
    """``run(**config)`` for every configuration, as one frame with a column per parameter."""
    out = None
    for config in configurations(grid):
        one = run(**config).withColumns({k: F.lit(v) for k, v in config.items()})
        out = one if out is None else out.unionByName(one)
    return out
