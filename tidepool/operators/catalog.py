"""Catalogue and taxonomy: joins of titles and ids, arrays of foreign keys, upserts, texts of candidates."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepool.functions import text as T
from tidepool.functions import vectors as V
from tidepool.functions.columns import named
from tidepool.operators.reviews import keep_first


def load_catalog(df: DataFrame, id_col: str, name_col: str) -> DataFrame:
    """id, name, title_norm: one row per id (the first name), without nulls."""
    df = df.where(named(id_col).isNotNull() & named(name_col).isNotNull()).select(named(id_col).cast("long").alias("app_id"), named(name_col).alias("app_name"))
    return df.groupBy("app_id").agg(F.min("app_name").alias("app_name")).withColumn("title_norm", T.normalized_title(F.col("app_name")))


def id_list(col: str):
    """A foreign-key array without nulls; empty for null."""
    return F.filter(F.coalesce(named(col).cast("array<bigint>"), F.array().cast("array<bigint>")), lambda x: x.isNotNull())


def unique_ids(df: DataFrame, col: str) -> DataFrame:
    return df.select(F.explode(id_list(col)).alias("id")).distinct()


def lookup_table(df: DataFrame) -> DataFrame:
    """id, name: one row per id, an absent name as ''."""
    return df.where(F.col("id").isNotNull()).groupBy("id").agg(F.coalesce(F.min("name"), F.lit("")).alias("name"))


def resolve(df: DataFrame, key: str, col: str, lookup: DataFrame, value: str, out: str) -> DataFrame:
    """Adds ``out``: the values of the keys in the array, in its order; ids without an entry are skipped."""
    long = df.select(key, F.posexplode(id_list(col)).alias("__p", "id"))
    got = long.join(lookup.select("id", F.col(value).alias("__v")), "id").groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("__p", "__v"))), lambda s: s["__v"]).alias(out))
    kind = lookup.schema[value].dataType.simpleString()
    return df.join(got, key, "left").withColumn(out, F.coalesce(out, F.array().cast(f"array<{kind}>")))


def enrich(df: DataFrame, key: str, fields: Sequence[str], lookups: dict[str, DataFrame]) -> DataFrame:
    """For each field: names, vectors, and the mean vector of the entities its array refers to."""
    for f in fields:
        df = resolve(df, key, f, lookups[f], "name", f"{f}_names")
        if "vector" in lookups[f].columns:
            df = resolve(df, key, f, lookups[f], "vector", f"{f}_vectors").withColumn(f"{f}_pooled", V.unit(V.mean_vector(F.col(f"{f}_vectors"))))
    return df


def with_text_vectors(df: DataFrame, fields: Sequence[str], encode: Callable[[Column], Column], clip: int | None = 8000, suffix: str = "_vector") -> DataFrame:
    """``df`` with a vector of each text field, to length one; null texts count as empty, and at most ``clip`` characters are encoded.

    ``encode``: a text column to a vector column, such as ``prompts.batch_encoder`` gives for a model; KeyError for a field that is not there.
    """
    if lost := [f for f in fields if f not in df.columns]:
        raise KeyError(f"no text fields {lost}")
    text = lambda f: F.coalesce(F.col(f).cast("string"), F.lit("")) if clip is None else F.substring(F.coalesce(F.col(f).cast("string"), F.lit("")), 1, clip)
    return df.withColumns({f"{f}{suffix}": V.unit(encode(text(f))) for f in fields})


def match_waterfall(catalog: DataFrame, external: DataFrame, titles: DataFrame, hits: int = 8, cap: int | None = None) -> DataFrame:
    """app_id, match_id, join_method: by external id first, else by an exact normalised title among the first ``hits``.

    ``external``: app_id, match_id; ``titles``: title_norm, match_id, hit (its place, from 1); ``cap``: at most so
    many titles are looked up, the smallest app_ids first.
    """
    one = external.select("app_id", "match_id", F.lit("external_id").alias("join_method"), F.lit(0).alias("p"))
    rest = catalog.join(external.select("app_id").distinct(), "app_id", "left_anti")
    if cap is not None:
        rest = rest.orderBy("app_id").limit(cap)
    two = rest.join(titles.where(F.col("hit") <= hits), "title_norm").select("app_id", "match_id", F.lit("title_exact").alias("join_method"), F.col("hit").alias("p"))
    return keep_first(one.unionByName(two), "app_id", ["p", "match_id"]).drop("p")


def joined_details(matches: DataFrame, catalog: DataFrame, details: DataFrame) -> DataFrame:
    """Matches with catalogue and detail columns; the detail's name becomes match_name."""
    d = details.withColumnRenamed("name", "match_name").withColumnRenamed("id", "match_id")
    return matches.join(catalog, "app_id", "left").join(d, "match_id", "left")


def upsert_mocks(df: DataFrame, mocks: DataFrame, catalog: DataFrame) -> DataFrame:
    """Adds mock rows for items that are absent, and replaces those a mock overrides (``override``).

    A mock without match_id gets -app_id, without join_method manual_mock, without app_name the catalogue's.
    """
    names = catalog.select("app_id", F.col("app_name").alias("__name"))
    m = mocks.join(names, "app_id", "left")
    have = set(mocks.columns)
    col = lambda c, default: F.coalesce(F.col(c), default) if c in have else default
    m = m.withColumns({"match_id": col("match_id", -F.col("app_id")), "join_method": col("join_method", F.lit("manual_mock")), "app_name": col("app_name", F.col("__name")), "override": col("override", F.lit(False))}).drop("__name")
    kept = df.join(m.where("override").select("app_id"), "app_id", "left_anti")
    return kept.unionByName(m.join(kept.select("app_id"), "app_id", "left_anti").drop("override"), allowMissingColumns=True)


def join_report(catalog: DataFrame, joined: DataFrame, fields: Sequence[str]) -> DataFrame:
    """One row: items, matched, their share, and the share with each field populated."""
    kinds = {f.name: f.dataType.simpleString() for f in joined.schema}
    per = joined.agg(F.count_distinct("app_id").alias("n_matched"), *(F.avg(T.populated(named(f), kinds[f]).cast("double")).alias(f"coverage_{f}") for f in fields))
    return catalog.agg(F.count_distinct("app_id").alias("n_items")).join(per, F.lit(True)).withColumn("match_rate", F.col("n_matched") / F.col("n_items"))


def candidate_text(df: DataFrame, name: str, summary: str, storyline: str | None = None):
    """Adds ``candidate_text``: name, summary (and storyline) with blank lines between; blank parts are left out."""
    parts = [c for c in (name, summary, storyline) if c]
    return df.withColumn("candidate_text", F.concat_ws("\n\n", *(F.when(F.length(T.strip(named(c))) > 0, T.strip(named(c))) for c in parts)))


def require_ids(df: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """The rows of the wanted ids; KeyError naming some that are absent."""
    lost = wanted.select(key).distinct().join(df.select(key), key, "left_anti").limit(10).collect()
    if lost:
        raise KeyError(f"no rows for ids: {sorted(r[0] for r in lost)}")
    return df.join(wanted.select(key).distinct(), key, "left_semi")


def tag_vocabulary(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """The distinct tags of some array columns."""
    tags = F.concat(*(F.coalesce(named(c), F.array().cast("array<string>")) for c in cols))
    return df.select(F.explode(tags).alias("tag")).where("tag IS NOT NULL").distinct()


def review_chunks(reviews: DataFrame, item: str, text: str, votes: str, review_id: str, cap: int = 50, least: int = 30) -> DataFrame:
    """Chunk rows of each item's ``cap`` most helpful texts of at least ``least`` characters; of equals the smaller id."""
    from tidepool.operators.windows import cap_per_group

    kept = reviews.where(F.length(T.strip(named(text))) >= least)
    return cap_per_group(kept, item, [named(votes).desc_nulls_last(), named(review_id).asc()], cap)


def profile_reviews(reviews: DataFrame, item: str, text: str, flag: str, review_id: str, cap: int = 200, least: int = 30) -> DataFrame:
    """Each item's first ``cap`` positive texts by id, with their length."""
    from tidepool.operators.windows import cap_per_group

    kept = reviews.where((named(flag) == 1) & (F.length(T.strip(named(text))) >= least)).withColumn("review_len", F.length(named(text)))
    return cap_per_group(kept, item, [named(review_id).asc()], cap)


def chunk_table(reviews: DataFrame, descriptions: DataFrame, names: DataFrame, item: str = "app_id") -> DataFrame:
    """Review and description chunks as one table, reviews' ids with nulls first.

    ``reviews``: item, app_name, review_id, text, votes_helpful, recommended; ``descriptions``: item, summary, storyline.
    """
    d = descriptions.withColumn("text", T.description(F.col("summary"), F.col("storyline"))).where("text IS NOT NULL").join(names, item, "left")
    r = reviews.withColumn("chunk_type", F.lit("review"))
    d = d.select(item, "app_name", F.lit("description").alias("chunk_type"), "text")
    both = r.unionByName(d, allowMissingColumns=True).withColumn("text_len", F.length("text"))
    return both.orderBy(item, "chunk_type", F.col("review_id").asc_nulls_first())
