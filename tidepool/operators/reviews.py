"""Cleaning of interaction rows: filters, keep-first dedupe, projection, derived features, normalisation.

Rules for a column that is absent are no-ops, so the operators fit tables with
fewer columns.  All are column expressions; only the dedupe shuffles.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepool.functions import text as T
from tidepool.functions.columns import named, present
from tidepool.operators.windows import exact_quantiles

VOTE_SENTINEL = 4294967295
VOTES = ("votes_helpful", "votes_funny")
PLAYTIMES = ("author.playtime_last_two_weeks", "author.playtime_at_review", "author.playtime_forever")
FLAGS = ("recommended", "steam_purchase", "received_for_free", "written_during_early_access", "is_helpful")
FEATURES = (
    "review_id", "app_id", "app_name", "author.steamid", "language", "review", "recommended", "votes_helpful",
    "author.num_games_owned", "author.num_reviews", "author.playtime_last_two_weeks", "author.last_played",
    "author.playtime_at_review", "steam_purchase", "received_for_free", "written_during_early_access", "timestamp_created",
)


def drop_vote_sentinels(df: DataFrame, cols: Sequence[str] = VOTES, sentinel: int = VOTE_SENTINEL) -> DataFrame:
    """Rows whose votes are below the sentinel; null votes go."""
    for c in present(df, cols):
        df = df.where(named(c) < sentinel)
    return df


def where_language(df: DataFrame, language: str | None, col: str = "language") -> DataFrame:
    return df.where(named(col) == language) if language is not None and col in df.columns else df


def drop_short_text(df: DataFrame, col: str = "review", least: int = 4) -> DataFrame:
    """Rows with at least ``least`` characters after stripping; null goes."""
    return df.where(F.length(T.strip(named(col))) >= least) if col in df.columns else df


def drop_negative(df: DataFrame, cols: Sequence[str] = PLAYTIMES) -> DataFrame:
    """Rows without a negative value; null stays."""
    for c in present(df, cols):
        df = df.where(F.coalesce(named(c) >= 0, F.lit(True)))
    return df


def drop_null(df: DataFrame, cols: Sequence[str] = ("author.last_played",)) -> DataFrame:
    for c in present(df, cols):
        df = df.where(named(c).isNotNull())
    return df


def filter_reviews(df: DataFrame, language: str | None = "english") -> DataFrame:
    """All row filters, in order: votes, language, text, playtime, last played."""
    return drop_null(drop_negative(drop_short_text(where_language(drop_vote_sentinels(df), language))))


def keep_first(df: DataFrame, key: str | Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """One row per key, the first in ``order``; rows with a null key are one group.

    A partial top-1 runs before the shuffle, so a hot key sends a row per task.
    """
    keys = [key] if isinstance(key, str) else list(key)
    w = Window.partitionBy(*(named(k) for k in keys)).orderBy(*order)
    return df.withColumn("__nth", F.row_number().over(w)).where("__nth = 1").drop("__nth")


def select_features(df: DataFrame, features: Sequence[str] = FEATURES) -> DataFrame:
    """Wanted columns that are present, ``is_helpful`` (votes_helpful >= 1), and null playtimes as 0."""
    cols = []
    for c in present(df, features):
        cols.append((F.coalesce(named(c).cast("double"), F.lit(0.0)) if c in PLAYTIMES else named(c)).alias(c))
    if "votes_helpful" in df.columns:
        cols.append((named("votes_helpful") >= 1).alias("is_helpful"))
    return df.select(*cols)


def flags_to_int(df: DataFrame, cols: Sequence[str] = FLAGS) -> DataFrame:
    return df.withColumns({c: named(c).cast("int") for c in present(df, cols)})


def with_text_counts(df: DataFrame, col: str = "review") -> DataFrame:
    return df.withColumns({"review_word_count": T.word_count(named(col)), "review_length_chars": T.char_length(named(col))})


def max_train_timestamp(df: DataFrame, ts: str, split: str = "split", train: str = "train") -> float:
    """The largest timestamp of the training rows; ValueError if there is none."""
    top = df.where(F.col(split) == train).agg(F.max(named(ts)).alias("m")).first()["m"]
    if top is None:
        raise ValueError("no training row has a timestamp")
    return top


def review_age(ts: Column, reference: Column) -> Column:
    """Seconds before the reference, not below 0; null for a null timestamp."""
    return F.when(ts.isNotNull(), F.greatest(F.lit(0), reference - ts))


# -- normalisation ---------------------------------------------------------------


def norm_name(col: str) -> str:
    return "_norm_" + col.replace(".", "__")


def fit_caps(train: DataFrame, cols: Mapping[str, str], quantile: float = 0.99) -> dict[str, dict]:
    """Parameters by column for kinds ``log1p`` and ``cap_log1p``; a cap is the exact quantile (linear) of max(0, null as 0).

    All quantiles come from one pass over (column, value) rows.  Absent columns are skipped; an unknown kind is a ValueError.
    """
    if bad := set(cols.values()) - {"log1p", "cap_log1p"}:
        raise ValueError(f"unknown kinds: {sorted(bad)}")
    use = present(train, cols)
    capped = [c for c in use if cols[c] == "cap_log1p"]
    caps = {}
    if capped:
        values = F.array(*(F.greatest(F.coalesce(named(c).cast("double"), F.lit(0.0)), F.lit(0.0)) for c in capped))
        rows = exact_quantiles(train.select(F.posexplode(values).alias("column", "value")), "value", [quantile], ["column"]).collect()  # one row a column
        caps = {capped[r["column"]]: r["q0"] for r in rows}
    return {c: {"kind": cols[c]} | ({"quantile": quantile, "cap": caps.get(c)} if c in capped else {}) for c in use}


def normalized(x: Column, cap: float | Column | None = None) -> Column:
    x = F.greatest(F.coalesce(x.cast("double"), F.lit(0.0)), F.lit(0.0))
    return F.log1p(x if cap is None else F.least(x, cap if isinstance(cap, Column) else F.lit(float(cap))))


def denormalized(y: Column, cap: float | None = None) -> Column:
    """The inverse, clipped to [0, cap]."""
    x = F.greatest(F.expm1(y), F.lit(0.0))
    return x if cap is None else F.least(x, F.lit(float(cap)))


def with_normalized(df: DataFrame, params: Mapping[str, Mapping]) -> DataFrame:
    return df.withColumns({norm_name(c): normalized(named(c), params[c].get("cap")) for c in present(df, params)})
