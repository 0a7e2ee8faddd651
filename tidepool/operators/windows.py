"""Ranks, caps, running aggregates, quantile bins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepool.functions.columns import named

EPS = 1e-12


def cap_per_group(df: DataFrame, group: str | Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """The first n rows of each group in ``order``; a partial cap runs before the shuffle."""
    groups = [group] if isinstance(group, str) else list(group)
    w = Window.partitionBy(*(named(g) for g in groups)).orderBy(*order)
    return df.withColumn("__nth", F.row_number().over(w)).where(F.col("__nth") <= n).drop("__nth")


def ranked(df: DataFrame, group: str | Sequence[str], score: Column, tie: Sequence[Column], name: str = "rank") -> DataFrame:
    """Ranks from 1 by falling score, then the tie columns; NaN and null scores come last."""
    groups = [group] if isinstance(group, str) else list(group)
    low = F.coalesce(F.when(F.isnan(score), F.lit(float("-inf"))).otherwise(score), F.lit(float("-inf")))
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*(named(g) for g in groups)).orderBy(low.desc(), *tie)))


def minmax(x: Column, group: Sequence[str] | str) -> Column:
    """(x - min) / (max - min) within the group; 0 where the range is 1e-12 or less."""
    w = Window.partitionBy(*([group] if isinstance(group, str) else group))
    low, high = F.min(x).over(w), F.max(x).over(w)
    return F.when(high - low <= EPS, F.lit(0.0)).otherwise((x - low) / (high - low))


def prior_aggregates(df: DataFrame, key: str, ts: str, flag: str, prefix: str = "prior") -> DataFrame:
    """Counts and positives of the key's rows strictly before this timestamp, their rate, and seconds since the last (-1 if none).

    Rows of one timestamp share the values.
    """
    w = Window.partitionBy(named(key)).orderBy(named(ts)).rangeBetween(Window.unboundedPreceding, -1)
    n, pos = F.count(F.lit(1)).over(w), F.coalesce(F.sum(named(flag)).over(w), F.lit(0))
    last = F.max(named(ts)).over(w)
    return df.withColumns({f"{prefix}_n": n, f"{prefix}_pos": pos, f"{prefix}_rate": F.when(n > 0, pos / n).otherwise(F.lit(0.0)), f"{prefix}_since": F.coalesce(named(ts) - last, F.lit(-1))})


def with_position(df: DataFrame, group: str, order: Sequence[Column]) -> DataFrame:
    """``position`` (from 0) and ``group_size`` within the group."""
    w = Window.partitionBy(named(group))
    return df.withColumns({"position": F.row_number().over(w.orderBy(*order)) - 1, "group_size": F.count(F.lit(1)).over(w)})


def running_before(df: DataFrame, order: str, sums: dict[str, str], by: Sequence[str] = (), buckets: int = 256) -> DataFrame:
    """Adds, for each name, the sum of a column over all rows (of the same ``by``) with a smaller ``order``, whose values are distinct.

    A window over all rows, or over a hot group, would run in one task.  Here rows
    fall in buckets between approximate quantiles; a group has few buckets, whose
    totals are joined back, and each bucket is summed apart.
    """
    by = list(by)
    edges = df.agg(F.percentile_approx(order, [i / buckets for i in range(1, buckets)]).alias("e")).first()["e"] or []
    edges = sorted(set(edges))
    bucket = F.size(F.filter(F.array(*(F.lit(e) for e in edges)), lambda e: e <= F.col(order))) if edges else F.lit(0)
    df = df.withColumn("__b", bucket)
    before = Window.partitionBy(*by).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy(*by, "__b").agg(*(F.sum(c).alias(f"__t_{n}") for n, c in sums.items()))  # at most ``buckets`` rows a group
    totals = totals.select(*by, "__b", *(F.coalesce(F.sum(f"__t_{n}").over(before), F.lit(0)).alias(f"__s_{n}") for n in sums))
    same = F.col("a.__b") == F.col("t.__b")
    for c in by:
        same = same & F.col(f"a.{c}").eqNullSafe(F.col(f"t.{c}"))
    df = df.alias("a").join(totals.alias("t"), same).select("a.*", *(f"t.__s_{n}" for n in sums))
    w = Window.partitionBy(*by, "__b").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumns({n: F.col(f"__s_{n}") + F.coalesce(F.sum(c).over(w), F.lit(0)) for n, c in sums.items()}).drop("__b", *(f"__s_{n}" for n in sums))


def exact_quantiles(df: DataFrame, col: str, qs: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """``by``, q0, q1, ...: exact quantiles (linear) of the values that are not null, without a group in one task.

    Distinct values are counted, and those that hold the two order statistics of a
    quantile are picked by the counts before them.
    """
    by = list(by)
    per = df.where(named(col).isNotNull()).groupBy(*by, named(col).cast("double").alias("__v")).agg(F.count(F.lit(1)).alias("__n"))
    size = per.groupBy(*by).agg(F.sum("__n").alias("__size"))
    at = running_before(per, "__v", {"__before": "__n"}, by)
    same = F.lit(True)
    for c in by:
        same = same & F.col(f"x.{c}").eqNullSafe(F.col(f"s.{c}"))
    at = at.alias("x").join(size.alias("s") if by else F.broadcast(size.alias("s")), same).select("x.*", "s.__size")
    made = []
    for k, q in enumerate(qs):
        place = F.lit(float(q)) * (F.col("__size") - 1)
        holds = lambda i: (F.col("__before") <= i) & (i < F.col("__before") + F.col("__n"))
        made += [F.max(F.when(holds(F.floor(place)), F.col("__v"))).alias(f"__l{k}"), F.max(F.when(holds(F.ceil(place)), F.col("__v"))).alias(f"__h{k}"), F.max(place - F.floor(place)).alias(f"__f{k}")]
    got = at.groupBy(*by).agg(*made)
    return got.select(*by, *((F.col(f"__l{k}") + (F.col(f"__h{k}") - F.col(f"__l{k}")) * F.col(f"__f{k}")).alias(f"q{k}") for k in range(len(qs))))


def with_average_rank(df: DataFrame, col: str, name: str) -> DataFrame:
    """``name``: ranks from 1 where ties share their mean; null values have none."""
    per = df.where(F.col(col).isNotNull()).groupBy(F.col(col).alias("__v")).agg(F.count(F.lit(1)).alias("__n"))
    per = running_before(per, "__v", {"__before": "__n"}).select("__v", (F.col("__before") + (F.col("__n") + 1) / 2.0).alias(name))
    return df.join(per, F.col(col) == F.col("__v"), "left").drop("__v")


def quantile_edges(df: DataFrame, col: str, q: int) -> list[float]:
    """Distinct exact quantile edges at 0, 1/q, ... 1 (linear), of the values that are not null."""
    edges = exact_quantiles(df, col, [i / q for i in range(q + 1)]).first()
    return sorted({e for e in edges if e is not None}) if edges else []


def binned(x: Column, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Right-closed bins between edges, the lowest edge included; null outside."""
    out = F.lit(None).cast("string")
    for k in range(len(edges) - 1, 0, -1):
        out = F.when((x <= edges[k]) & ((x > edges[k - 1]) if k > 1 else (x >= edges[0])), F.lit(labels[k - 1])).otherwise(out)
    return out


def deciles(df: DataFrame, col: str, name: str = "decile") -> DataFrame:
    """D1 to D10 by exact quantiles; equal values share a bin, so there may be fewer."""
    edges = quantile_edges(df, col, 10)
    return df.withColumn(name, binned(named(col), edges, [f"D{i}" for i in range(1, 11)]))


def causal_anchors(df: DataFrame, user: str, ts: str, id_col: str) -> DataFrame:
    """For each row, how many of the user's rows lie strictly before and after it by (ts, id), and its neighbours' ids."""
    w = Window.partitionBy(named(user)).orderBy(named(ts), named(id_col))
    nth = F.row_number().over(w)
    return df.withColumns({
        "n_before": nth - 1,
        "n_after": F.count(F.lit(1)).over(Window.partitionBy(named(user))) - nth,
        "previous_id": F.lag(named(id_col)).over(w),
        "next_id": F.lead(named(id_col)).over(w),
    })


def within_history(events: DataFrame, queries: DataFrame, user: str, ts: str, seconds: int) -> DataFrame:
    """Pairs of a query and its user's events with query_ts - seconds < ts <= query_ts.

    Time is cut into slots of that length: a query meets the events of its slot and of
    the one before, and a user's rows are dealt over the slots.
    """
    slot = lambda t: F.floor(t / F.lit(seconds))
    q = queries.withColumnRenamed(ts, "query_ts")
    q = q.withColumn("__slot", F.explode(F.array(slot(F.col("query_ts")), slot(F.col("query_ts")) - 1)))
    e = events.withColumn("__slot", slot(named(ts)))
    return q.join(e, [user, "__slot"]).where((named(ts) > F.col("query_ts") - seconds) & (named(ts) <= F.col("query_ts"))).drop("__slot")
