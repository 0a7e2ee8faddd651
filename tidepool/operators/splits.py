"""Deterministic splits and samples."""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepool.functions.columns import named, require
from tidepool.functions.hashing import stable_uniform

SEED, SEED_VARIABLE = 2026, "TIDEPOOL_RANDOM_STATE"
MODES = ("random_stratified", "hybrid_user_temporal", "support_aware_user_temporal")


def seed() -> int:
    """The default seed, or the environment's."""
    return int(os.environ.get(SEED_VARIABLE, SEED))


def check_sizes(train: float, val: float) -> None:
    """ValueError unless sizes are not negative and leave some for test."""
    if train < 0 or val < 0 or train + val >= 1:
        raise ValueError("sizes must not be negative and sum to less than 1")


def by_ratio(u: Column, train: float, val: float) -> Column:
    return F.when(u < train, "train").when(u < train + val, "val").otherwise("test")


def split_random(df: DataFrame, id_col: str, strata: Column, train: float = 0.7, val: float = 0.15, seed: int = SEED) -> DataFrame:
    """Adds ``split`` by a hash of seed, stratum and id: no shuffle."""
    check_sizes(train, val)
    require(df, [id_col])
    u = F.when(named(id_col).isNotNull(), stable_uniform(seed, strata, named(id_col)))
    return df.withColumn("split", F.coalesce(F.when(u.isNotNull(), by_ratio(u, train, val)), F.lit("train")))


def _recency(user: str, ts: str, id_col: str):
    return Window.partitionBy(named(user)).orderBy(F.coalesce(named(ts).cast("double"), F.lit(-1.0)).desc(), named(id_col).desc_nulls_last())


def split_user_temporal(df: DataFrame, user: str, ts: str, id_col: str, strata: Column, n_val: int = 1, n_test: int = 1, threshold: int = 3, train: float = 0.7, val: float = 0.15, seed: int = SEED) -> DataFrame:
    """Users with ``threshold`` rows or more: the latest ``n_test`` rows test, the next ``n_val`` val; others by hash per row."""
    check_sizes(train, val)
    require(df, [user, ts, id_col])
    n = F.count(F.lit(1)).over(Window.partitionBy(named(user)))
    df = df.withColumns({"__n": n, "__nth": F.row_number().over(_recency(user, ts, id_col))})
    temporal = F.when(F.col("__nth") <= n_test, "test").when(F.col("__nth") <= n_test + n_val, "val").otherwise("train")
    split = F.when(named(user).isNull() | named(id_col).isNull(), "train").when(F.col("__n") < threshold, by_ratio(stable_uniform(seed, strata, named(id_col)), train, val)).otherwise(temporal)
    return df.withColumn("split", split).drop("__n", "__nth")


def split_support_aware(df: DataFrame, user: str, ts: str, id_col: str, train: float = 0.7, val: float = 0.15, seed: int = SEED) -> DataFrame:
    """One row: by the user's hash.  More: the latest rows go to one eval split per user, one of two rows, else

    min(n - 1, max(2, n * ratio rounded half to even)).  Null users and ids are train.  One shuffle, by user.
    """
    check_sizes(train, val)
    require(df, [user, ts, id_col])
    test = 1.0 - train - val
    n = F.count(F.lit(1)).over(Window.partitionBy(named(user)))
    # the count needs no order, so it comes after the rank, whose sort serves both
    df = df.withColumn("__nth", F.row_number().over(_recency(user, ts, id_col))).withColumn("__n", n)
    df = df.withColumns({"__main": stable_uniform(seed, "support-aware-main", named(user)), "__eval": stable_uniform(seed, "support-aware-eval", named(user))})
    to_val = F.col("__eval") < F.lit(val / (val + test))
    share = F.when(to_val, F.lit(val)).otherwise(F.lit(test))
    n_eval = F.when(F.col("__n") == 2, 1).otherwise(F.least(F.col("__n") - 1, F.greatest(F.lit(2), F.bround(F.col("__n") * share).cast("long"))))
    split = F.when(named(user).isNull(), "train").when(F.col("__n") == 1, by_ratio(F.col("__main"), train, val)).when(named(id_col).isNotNull() & (F.col("__nth") <= n_eval), F.when(to_val, "val").otherwise("test")).otherwise("train")
    return df.withColumn("split", split).drop("__n", "__nth", "__main", "__eval")


# -- samples: ordered by a hash of the key, so a seed fixes them on any cluster -------


def sample_rows(df: DataFrame, key: str, n: int, seed: int = SEED, group: str = "sample") -> DataFrame:
    """n rows without replacement; all where n is 0 or less, or not below the rows there are."""
    return df if n <= 0 else df.orderBy(stable_uniform(seed, group, named(key)), named(key)).limit(n)


def sample_per_group(df: DataFrame, groups: Sequence[str], key: str, n: Column | int, seed: int = SEED, group: str = "sample") -> DataFrame:
    """At most n rows of each group."""
    w = Window.partitionBy(*(named(g) for g in groups)).orderBy(stable_uniform(seed, group, named(key)), named(key))
    return df.withColumn("__nth", F.row_number().over(w)).where(F.col("__nth") <= n).drop("__nth")


def sample_strata(df: DataFrame, strata: Sequence[str], shares: dict[tuple, float], key: str, n: int, seed: int = SEED) -> DataFrame:
    """A quota of round(n * share) for each stratum, topped up to n from the rest, by hash."""
    u = stable_uniform(seed, "strata", named(key))
    quota = F.lit(0)
    for value, share in shares.items():
        hit = F.lit(True)
        for c, v in zip(strata, value):
            hit = hit & (named(c) == v)
        quota = F.when(hit, F.bround(F.lit(n * share)).cast("int")).otherwise(quota)
    nth = F.row_number().over(Window.partitionBy(*(named(s) for s in strata)).orderBy(u, named(key)))
    return df.withColumns({"__nth": nth, "__u": u}).withColumn("__over", (F.col("__nth") > quota).cast("int")).orderBy("__over", "__u", named(key)).limit(n).drop("__nth", "__u", "__over")


def sample_without(df: DataFrame, excluded: DataFrame, key: str, n: int, seed: int = SEED) -> DataFrame:
    """n rows whose key is not in ``excluded``; keys keep their values."""
    return sample_rows(df.join(excluded.select(key).distinct(), key, "left_anti"), key, n, seed, "label")


def fit_tune_split(df: DataFrame, stratum: str, key: str, fit: float, seed: int = SEED) -> DataFrame:
    """``part`` fit or tune: by stratum, greatest(1, n * fit rounded half to even) rows fit."""
    w = Window.partitionBy(named(stratum))
    nth = F.row_number().over(w.orderBy(stable_uniform(seed, "fit", named(key)), named(key)))
    return df.withColumn("part", F.when(nth <= F.greatest(F.lit(1), F.bround(F.count(F.lit(1)).over(w) * F.lit(fit)).cast("int")), "fit").otherwise("tune"))
