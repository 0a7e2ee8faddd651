"""The ETL job: CSV to clean, split and normalised tables in one lazy plan."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.functions.columns import named
from tidepool.functions.text import stratify_key
from tidepool.operators import reviews as V
from tidepool.operators import splits as S
from tidepool.sources import tables as IO

NORMALIZED = {"author.playtime_at_review": "cap_log1p", "author.num_games_owned": "cap_log1p", "author.num_reviews": "cap_log1p", "review_word_count": "log1p"}


def clean(raw: DataFrame, language: str | None = "english") -> DataFrame:
    """Filters, one row per review_id (the earliest), projection, flags as integers."""
    kept = V.filter_reviews(raw, language)
    order = [named(c) for c in ("timestamp_created", "review") if c in raw.columns]
    return V.flags_to_int(V.select_features(V.keep_first(kept, "review_id", order or [named("review_id")])))


def split(df: DataFrame, mode: str = "support_aware_user_temporal", train: float = 0.7, val: float = 0.15, seed: int | None = None, user: str = "author.steamid", ts: str = "timestamp_created", id_col: str = "review_id", folder: str | None = None) -> DataFrame:
    """Adds ``split`` by one of the modes, text counts, and the age before the latest training row.

    With a ``folder``, the split rows are written there once, and what follows reads them.
    """
    if mode not in S.MODES:
        raise ValueError(f"unknown mode: {mode}")
    seed = S.seed() if seed is None else seed
    strata = stratify_key(named("app_name"), named("recommended"), named("is_helpful")) if mode != "support_aware_user_temporal" else None
    if mode == "random_stratified":
        out = S.split_random(df, id_col, strata, train, val, seed)
    elif mode == "hybrid_user_temporal":
        out = S.split_user_temporal(df, user, ts, id_col, strata, train=train, val=val, seed=seed)
    else:
        out = S.split_support_aware(df, user, ts, id_col, train, val, seed)
    out = V.with_text_counts(out)
    if folder is not None:
        out.write.mode("overwrite").parquet(folder)
        out = df.sparkSession.read.schema(out.schema).parquet(folder)
    return out.withColumn("review_age_seconds", V.review_age(named(ts), F.lit(V.max_train_timestamp(out, ts))))


def run(raw: DataFrame, path: str, language: str | None = "english", normalized: Mapping[str, str] = NORMALIZED, **options) -> dict:
    """Clean, split, fit on train, normalise all, and write one folder per split; returns counts and parameters.

    The raw rows are read once: the split rows are kept in a scratch folder for the passes that follow.
    """
    df = split(clean(raw, language), **{"folder": IO.scratch(raw.sparkSession, "split"), **options})
    params = V.fit_caps(df.where("split = 'train'"), normalized)
    return {"rows": IO.write_splits(V.with_normalized(df, params), path), "params": params}
