"""Data-quality and catalogue reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepool.functions import text as T
from tidepool.functions.columns import named
from tidepool.operators.windows import exact_quantiles


def missing_report(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """column, missing (share of nulls), n_unique (distinct values that are not null), in one aggregation."""
    cols = list(cols or df.columns)
    row = df.agg(*(F.avg(named(c).isNull().cast("double")).alias(f"m{i}") for i, c in enumerate(cols)), *(F.count_distinct(named(c)).alias(f"u{i}") for i, c in enumerate(cols)))
    return row.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"m{i}").alias("missing"), F.col(f"u{i}").alias("n_unique")) for i, c in enumerate(cols)))).alias("r")).select("r.*")


def value_counts(df: DataFrame, col: str, top: int | None = None) -> DataFrame:
    """Values (nulls too) with n and share, the most frequent first."""
    n = df.groupBy(named(col).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    total = df.agg(F.count(F.lit(1)).alias("__t"))
    out = n.join(F.broadcast(total), F.lit(True)).withColumn("share", F.col("n") / F.col("__t")).drop("__t")
    out = out.orderBy(F.col("n").desc(), F.col("value").asc_nulls_last())
    return out.limit(top) if top else out


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    """Keys with more than one row, and how many."""
    return df.groupBy(named(key).alias(key)).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def differing_columns(df: DataFrame, key: str, cols: Sequence[str]) -> DataFrame:
    """column, n_keys: how many duplicated keys have more than one value (null is one) in the column."""
    kinds = [(F.count_distinct(named(c)) + F.max(named(c).isNull().cast("int"))).alias(f"k{i}") for i, c in enumerate(cols)]
    per = df.groupBy(named(key)).agg(F.count(F.lit(1)).alias("n"), *kinds).where("n > 1")
    row = per.agg(*(F.count_if(F.col(f"k{i}") > 1).alias(f"k{i}") for i in range(len(cols))))
    return row.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"k{i}").alias("n_keys")) for i, c in enumerate(cols)))).alias("r")).select("r.*")


def group_rates(df: DataFrame, group: str, flag: str, top: int = 20) -> DataFrame:
    """Rows and the share of flagged ones per group, the largest groups first."""
    return df.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col(flag).cast("double")).alias("rate")).orderBy(F.col("n").desc(), group).limit(top)


def index_range(df: DataFrame, group: str, index: str) -> DataFrame:
    return df.groupBy(group).agg(F.min(index).alias("first_index"), F.max(index).alias("last_index"))


def group_quantiles(df: DataFrame, groups: Sequence[str], col: str, qs: Sequence[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """Exact quantiles (linear) per group as q0, q1, ..."""
    return exact_quantiles(df, col, qs, groups)


def describe(df: DataFrame, col: str, by: Sequence[str] = ()) -> DataFrame:
    c, by = named(col), list(by)
    out = df.groupBy(*by).agg(F.count(c).alias("n"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.min(c).alias("min"), F.max(c).alias("max"))
    q = exact_quantiles(df, col, (0.25, 0.5, 0.75), by)
    same = F.lit(True)
    for k in by:
        same = same & F.col(f"o.{k}").eqNullSafe(F.col(f"q.{k}"))
    out = out.alias("o").join(q.alias("q") if by else F.broadcast(q.alias("q")), same, "left")
    return out.select(*(F.col(f"o.{k}").alias(k) for k in by), "n", "mean", "std", "min", F.col("q0").alias("q25"), F.col("q1").alias("q50"), F.col("q2").alias("q75"), "max")


def outlier_share(df: DataFrame, cols: Sequence[str], z: float = 4.0) -> DataFrame:
    """column, outlier_share: the share of rows more than z standard deviations from the mean."""
    stats = df.agg(*(F.avg(c).alias(f"m{i}") for i, c in enumerate(cols)), *(F.stddev_samp(c).alias(f"s{i}") for i, c in enumerate(cols)))
    x = df.join(F.broadcast(stats), F.lit(True))
    row = x.agg(*(F.avg((F.abs(F.col(c) - F.col(f"m{i}")) > z * F.col(f"s{i}")).cast("double")).alias(f"o{i}") for i, c in enumerate(cols)))
    return row.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"o{i}").alias("outlier_share")) for i, c in enumerate(cols)))).alias("r")).select("r.*")


def strata(df: DataFrame, cols: Sequence[str], n: int = 10, largest: bool = True) -> DataFrame:
    c = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("n"))
    return c.orderBy(F.col("n").desc() if largest else F.col("n").asc(), *cols).limit(n)


def user_mix(df: DataFrame, user: str, item: str, flag: str) -> DataFrame:
    """Per user: rows, distinct items, positives, negatives, and the class all_pos, all_neg or mixed."""
    f = F.col(flag)
    per = df.groupBy(user).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(item).alias("n_items"), F.count_if(f == 1).alias("n_pos"), F.count_if(f == 0).alias("n_neg"))
    return per.withColumn("mix", F.when(F.col("n_neg") == 0, "all_pos").when(F.col("n_pos") == 0, "all_neg").otherwise("mixed"))


def mix_summary(per_user: DataFrame) -> DataFrame:
    total = per_user.agg(F.count(F.lit(1)).alias("__t"))
    g = per_user.groupBy("mix").agg(F.count(F.lit(1)).alias("n_users"), F.median("n").alias("median_n"))
    return g.join(F.broadcast(total), F.lit(True)).withColumn("share", F.col("n_users") / F.col("__t")).drop("__t")


def overlap(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """One row: distinct keys of each side, common and all, and the common share of all."""
    both = a.select(key, F.lit(1).alias("a"), F.lit(0).alias("b")).unionAll(b.select(key, F.lit(0).alias("a"), F.lit(1).alias("b"))).groupBy(key).agg(F.max("a").alias("a"), F.max("b").alias("b"))
    return both.agg(F.count_if(F.col("a") == 1).alias("n_a"), F.count_if(F.col("b") == 1).alias("n_b"), F.count_if((F.col("a") == 1) & (F.col("b") == 1)).alias("n_both"), F.count(F.lit(1)).alias("n_any")).withColumn("share", F.col("n_both") / F.col("n_any"))


def temporal_violations(df: DataFrame, user: str, ts: str, split: str = "split") -> DataFrame:
    """Users whose latest training row is later than their earliest val or test row."""
    t, s = F.col(ts), F.col(split)
    per = df.groupBy(user).agg(F.max(F.when(s == "train", t)).alias("train_max"), F.min(F.when(s != "train", t)).alias("eval_min"))
    return per.where("train_max > eval_min")


def longest_text(df: DataFrame, item: str, name: str, text: str, order: str, clip: int = 800) -> DataFrame:
    """item, text: each item's name and longest text (the first in ``order`` of equals), clipped."""
    best = df.groupBy(item).agg(F.max_by(F.struct(name, text), F.struct(F.length(text), -F.col(order))).alias("b"))
    return best.select(item, F.substring(F.concat_ws(". ", f"b.{name}", f"b.{text}"), 1, clip).alias("text"))


def search(df: DataFrame, name: str, tie: str, needle: str, limit: int = 20) -> DataFrame:
    """Rows whose name contains the needle, ignoring case and taking it literally, by name."""
    return df.where(F.contains(F.lower(named(name)), F.lit(needle.lower()))).orderBy(name, tie).limit(limit)


def populated_rates(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """column, coverage: the share of rows whose value says something."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    row = df.agg(*(F.avg(T.populated(named(c), kinds[c]).cast("double")).alias(f"c{i}") for i, c in enumerate(cols)))
    return row.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"c{i}").alias("coverage")) for i, c in enumerate(cols)))).alias("r")).select("r.*")


def melt(df: DataFrame, ids: Sequence[str], cols: Sequence[str]) -> DataFrame:
    return df.unpivot(list(ids), list(cols), "feature", "value")


def running_share(counts: DataFrame, by: Column) -> DataFrame:
    """Shares of a small table of counts (``n``) and their running sum in the given order."""
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy())).withColumn("running", F.sum("share").over(Window.orderBy(by)))
