"""Explanations of recommendations: generated once per pair, judged, scored by heuristics and summarised.

A model is a function over an iterator of batches of prompts, so that a task loads it once
and streams batches through it.  Its answers are kept (``ScoreMemo``): a pair that was
answered is not asked again, by a later run either.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepool.functions import prompts
from tidepool.functions import text as T
from tidepool.sources.memo import ScoreMemo

def _text(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


#: Batches of prompts to batches of answers, of the same lengths.
Model = Callable[[Iterator[pd.Series]], Iterator[pd.Series]]


def answered(df: DataFrame, prompt: Column, model: Model, out: str) -> DataFrame:
    """``df`` with the model's answer to each row's prompt."""

    @F.pandas_udf("string")
    def ask(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from model(batches)

    return df.withColumn(out, ask(prompt))


def explain(pairs: DataFrame, model: Model, memo: ScoreMemo, clip: int = 600) -> DataFrame:
    """``pairs`` (the memo's keys, query_text, candidate_text; null texts are empty) with ``explanation``."""
    prompt = prompts.explanation_prompt(_text("query_text"), _text("candidate_text"), clip)

    def score(keys: DataFrame) -> DataFrame:
        todo = pairs.join(keys, memo.keys)
        return answered(todo, prompt, model, "explanation").select(*memo.keys, "explanation")

    return pairs.join(memo.scores(pairs, score), memo.keys, "left")


#: What a judge scores, from 1 to 5; fixed names.
JUDGED = ("relevance", "faithfulness")


def judge(explained: DataFrame, model: Model, memo: ScoreMemo, clip: int = 600) -> DataFrame:
    """``explained`` with judge_relevance and judge_faithfulness; null where the answer cannot be read."""
    prompt = prompts.judge_prompt(_text("query_text"), _text("candidate_text"), _text("explanation"), clip)

    def score(keys: DataFrame) -> DataFrame:
        todo = answered(explained.join(keys, memo.keys), prompt, model, "answer")
        return todo.select(*memo.keys, T.judged(F.col("answer"), JUDGED).alias("j")).select(*memo.keys, *(F.col(f"j.{c}").alias(f"judge_{c}") for c in JUDGED))

    return explained.join(memo.scores(explained, score), memo.keys, "left")


def echo_model(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """A deterministic stand-in for a language model: says what the prompt recommends."""
    for b in batches:
        yield b.map(lambda p: "It has " + p.split("\n\nRecommended:\n")[1].split("\n\nIn two sentences")[0])


def length_judge(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """A deterministic stand-in for a judge: scores by the explanation's length; some answers are out of range."""
    for b in batches:
        said = b.map(lambda p: len(p.split("\n\nExplanation:\n")[1].split("\n\nAnswer with JSON")[0]))
        yield said.map(lambda n: f'```json\n{{"relevance": {1 + n % 5}, "faithfulness": {1 + n % 6}}}\n```')
