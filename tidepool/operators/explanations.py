"""Scores of generated explanations, their summaries, and calibration against hand labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepool.functions import text as T
from tidepool.functions import vectors as V
from tidepool.operators.classification import spearman
from tidepool.operators.windows import exact_quantiles

PROXIES = ("content_overlap_ratio", "relevance_cosine", "relevance_cosine_query_game")
JUDGED = ("judge_faithfulness", "judge_relevance")


def score_explanations(df: DataFrame, vocabulary: Column, *, text: str = "explanation", source: str = "candidate_text", tags: str = "tags", vector: str = "explanation_vector", query_vector: str = "query_vector", game_vector: str = "query_game_vector") -> DataFrame:
    """Adds is_degenerate, content_overlap_ratio, ungrounded_tags and the two relevance cosines.

    Vectors come from an encoder; ``tags`` are those the candidate has, ``vocabulary`` the catalogue's.
    """
    return df.withColumns({
        "is_degenerate": T.degenerate(F.col(text)),
        "content_overlap_ratio": T.overlap_ratio(F.col(text), F.col(source)),
        "ungrounded_tags": T.ungrounded(F.col(text), vocabulary, F.coalesce(F.col(tags), F.array().cast("array<string>"))),
        "relevance_cosine": V.cosine(F.col(vector), F.col(query_vector)),
        "relevance_cosine_query_game": V.cosine(F.col(vector), F.col(game_vector)),
    })


def _means_and_medians(df: DataFrame, cols: Sequence[str], extra: Sequence[Column] = ()) -> DataFrame:
    out = df.agg(F.count(F.lit(1)).alias("n_examples"), *extra, *(F.avg(c).alias(f"{c}_mean") for c in cols))
    for c in cols:
        out = out.join(F.broadcast(exact_quantiles(df, c, [0.5]).select(F.col("q0").alias(f"{c}_median"))), F.lit(True), "left")
    return out


def summarize_explanations(scored: DataFrame) -> DataFrame:
    """One row: n_examples, the rates of degenerate texts and of any ungrounded tag, and mean and median of the proxies."""
    rates = [F.avg(F.col("is_degenerate").cast("double")).alias("degenerate_rate"), F.avg((F.size("ungrounded_tags") > 0).cast("double")).alias("any_ungrounded_tag_rate")]
    return _means_and_medians(scored, PROXIES, rates)


def summarize_judge(scored: DataFrame) -> DataFrame:
    """One row: n_examples, mean and median of the judge's two scores."""
    return _means_and_medians(scored, JUDGED)


def calibration(labels: DataFrame, heuristics: DataFrame, judged: DataFrame, key: str = "example_id") -> DataFrame:
    """Hand labels with the proxies and the judge's scores of the same example; ValueError naming examples that either lacks."""
    for name, other in (("heuristic", heuristics), ("judge", judged)):
        lost = labels.select(key).join(other.select(key), key, "left_anti").orderBy(key).limit(10).collect()
        if lost:
            raise ValueError(f"examples without {name} scores: {[r[0] for r in lost]}")
    left = labels.join(heuristics.select(key, *PROXIES, "is_degenerate"), key)
    return left.join(judged.select(key, *JUDGED), key)


def summarize_calibration(df: DataFrame) -> DataFrame:
    """One row: agreement of the hand labels with the judge (exact, within one, rank correlation) and with the proxies; a correlation with a constant is null."""
    made = [F.count(F.lit(1)).alias("n_examples")]
    pairs = []
    for side in ("faithfulness", "relevance"):
        apart = F.abs(F.col(f"human_{side}") - F.col(f"judge_{side}"))
        made += [F.avg((apart == 0).cast("double")).alias(f"judge_{side}_exact_agreement_rate"), F.avg((apart <= 1).cast("double")).alias(f"judge_{side}_within_1_rate")]
        pairs.append((f"judge_{side}_spearman", f"human_{side}", f"judge_{side}"))
    pairs += [("heuristic_groundedness_spearman", "human_faithfulness", PROXIES[0]), ("heuristic_relevance_vs_review_spearman", "human_relevance", PROXIES[1]), ("heuristic_relevance_vs_query_game_spearman", "human_relevance", PROXIES[2])]
    out = df.agg(*made)
    for name, a, b in pairs:
        one = spearman(df, a, b).select(F.when(F.isnan("spearman"), None).otherwise(F.col("spearman")).alias(name))
        out = out.join(F.broadcast(one), F.lit(True), "left")
    return out
