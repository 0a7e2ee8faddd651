"""Evaluation cohorts: records with support counts, examples with positives, support rows, disjointness."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidepool.functions.columns import named
from tidepool.functions.hashing import stable_uniform
from tidepool.operators.splits import SEED


def eval_records(queries: DataFrame, train: DataFrame, user: str, item: str, flag: str) -> DataFrame:
    """Positive query rows with their user's counts and cohort names.

    Counts are one row per user, so the join keeps the query rows one to one.
    """
    support = train.groupBy(user).agg(F.count(F.lit(1)).alias("n_train_support"), F.count_if(F.col(flag) == 1).alias("n_train_pos_support"))
    pos = queries.where(F.col(flag) == 1)
    own = pos.groupBy(user).agg(F.count(F.lit(1)).alias("n_val_pos_rows"), F.count_distinct(item).alias("n_val_pos_apps"))
    out = pos.join(support, user, "left").join(own, user, "left").fillna(0, ["n_train_support", "n_train_pos_support", "n_val_pos_rows", "n_val_pos_apps"])
    n, p, a = F.col("n_train_support"), F.col("n_train_pos_support"), F.col("n_val_pos_apps")
    return out.withColumns({
        "eval_pos_cohort": F.when(a >= 2, "val_multi_pos_eval").when(a == 1, "val_single_pos_eval").otherwise("val_no_pos_eval"),
        "cohort": F.when(p >= 2, "val_multi_pos_train").when(p == 1, "val_pos_train").when(n >= 1, "val_train").otherwise("val_no_train"),
    })


def examples(records: DataFrame, queries: DataFrame, key: str, user: str, item: str, flag: str) -> DataFrame:
    """Records whose user has another positive item in the query split: with ``positives`` (sorted) and ``n_eval_targets``."""
    items = queries.where(F.col(flag) == 1).groupBy(user).agg(F.array_sort(F.collect_set(item)).alias("__items"))  # a user's distinct items
    out = records.join(items, user).withColumn("positives", F.array_remove("__items", F.col(item))).drop("__items")
    return out.withColumn("n_eval_targets", F.size("positives")).where("n_eval_targets > 0")


def dropped(records: DataFrame, made: DataFrame) -> dict[str, int]:
    """How many records became examples, and how many had no other positive item."""
    n, m = records.count(), made.count()
    return {"sampled_rows": n, "evaluable_examples": m, "no_other_positive_app": n - m}


def support_rows(ex: DataFrame, train: DataFrame, key: str, user: str, item: str, flag: str, mode: str = "query_only") -> DataFrame:
    """The positive training rows of each example's user, without its query item (query_only), or its positives either (strict)."""
    if mode not in ("query_only", "strict"):
        raise ValueError(f"unknown mode: {mode}")
    pos = train.where(F.col(flag) == 1).select(user, *(named(c).alias(f"support_{c}") for c in train.columns if c != user))
    j = ex.select(key, user, item, "positives").join(pos, user).where(F.col(f"support_{item}") != F.col(item))
    return j.where(~F.array_contains("positives", F.col(f"support_{item}"))) if mode == "strict" else j


def cap_support(rows: DataFrame, group: str, key: str, n: int, seed: int = SEED) -> DataFrame:
    """At most n rows of each group, chosen by hash, so the choice is the same every time."""
    w = Window.partitionBy(group).orderBy(stable_uniform(seed, "support", named(key)), named(key))
    return rows.withColumn("__nth", F.row_number().over(w)).where(F.col("__nth") <= n).drop("__nth")


def contrastive_rows(ex: DataFrame, items: DataFrame, key: str, item: str) -> DataFrame:
    """A row per example and positive of the catalogue: group_id, positive, and the example's columns."""
    rows = ex.select(F.col(key).alias("group_id"), *(c for c in ex.columns if c not in (key, "positives")), F.explode("positives").alias("positive"))
    return rows.join(items.select(F.col(item).alias("positive")).distinct(), "positive", "left_semi")


def require_disjoint(a: DataFrame, b: DataFrame, keys: list[str]) -> None:
    """ValueError with samples if two cohorts share a key."""
    both = a.select(*keys).intersect(b.select(*keys)).limit(5).collect()
    if both:
        raise ValueError(f"cohorts overlap: {both}")


def reindexed(df: DataFrame, n: int, key: str, seed: int = SEED) -> DataFrame:
    """n rows by hash with a new ``ex_idx`` from 0; ValueError if there are fewer."""
    if df.count() < n:
        raise ValueError(f"fewer than {n} rows")
    u = stable_uniform(seed, "subsample", named(key))
    top = df.drop("ex_idx").orderBy(u, named(key)).limit(n)  # n rows: what follows is as small
    return top.withColumn("ex_idx", F.row_number().over(Window.orderBy(u, named(key))) - 1)


def cohort_json(ex: DataFrame, key: str) -> DataFrame:
    """Examples with their nested columns as JSON strings, for files."""
    return ex.withColumn("validation_positive_app_ids_json", F.to_json("positives")).drop("positives")


def cohort_from_json(df: DataFrame) -> DataFrame:
    return df.withColumn("positives", F.from_json("validation_positive_app_ids_json", "array<bigint>")).drop("validation_positive_app_ids_json")


def with_lookup(df: DataFrame, texts: DataFrame, keys: list[str], text: str = "query_text") -> DataFrame:
    """``df`` with the text of its keys; KeyError naming some keys that have none."""
    lost = df.select(*keys).distinct().join(texts.select(*keys), keys, "left_anti").limit(5).collect()
    if lost:
        raise KeyError(f"no {text} for {[tuple(r) for r in lost]}")
    return df.join(texts.select(*keys, text).dropDuplicates(keys), keys)


def cohort_summary(ex: DataFrame, user: str, slice_col: str = "slice", bucket_col: str = "bucket") -> DataFrame:
    """Examples and distinct users of every slice and support bucket."""
    return ex.groupBy(slice_col, bucket_col).agg(F.count(F.lit(1)).alias("n_examples"), F.count_distinct(user).alias("n_users"))
