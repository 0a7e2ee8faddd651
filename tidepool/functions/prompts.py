"""Prompts for a language model, and the interfaces that stand for one."""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidepool.functions.text import clipped


def ranking_prompt(query: Column, candidates: Column, k: int, clip: int = 600) -> Column:
    """Asks for the k best ids as a JSON list; ``candidates``: array of id and text structs."""
    lines = F.array_join(F.transform(candidates, lambda c: F.concat_ws(": ", c["id"].cast("string"), F.substring(c["text"], 1, 200))), "\n")
    return F.concat(F.lit("A player writes:\n"), clipped(query, clip), F.lit("\n\nCandidates:\n"), lines, F.lit(f"\n\nAnswer with a JSON list of the {k} best ids, best first."))


def explanation_prompt(query: Column, candidate: Column, clip: int = 600) -> Column:
    return F.concat(F.lit("A player writes:\n"), clipped(query, clip), F.lit("\n\nRecommended:\n"), clipped(candidate, clip), F.lit("\n\nIn two sentences, and from these texts alone, say why it fits."))


def judge_prompt(query: Column, candidate: Column, explanation: Column, clip: int = 600) -> Column:
    return F.concat(F.lit("Review:\n"), clipped(query, clip), F.lit("\n\nGame:\n"), clipped(candidate, clip), F.lit("\n\nExplanation:\n"), clipped(explanation, clip), F.lit('\n\nAnswer with JSON: {"relevance": 1-5, "faithfulness": 1-5}.'))


class Backend(ABC):
    """A language model that ranks candidates."""

    @abstractmethod
    def generate_ranking(self, query: str, candidates: Sequence[tuple[int, str]], k: int) -> list[int]: ...


class OverlapBackend(Backend):
    """A deterministic stand-in: candidates by the words they share with the query, then by id."""

    def generate_ranking(self, query: str, candidates: Sequence[tuple[int, str]], k: int) -> list[int]:
        words = set(query.lower().split())
        return [i for _, i in sorted((-len(words & set(t.lower().split())), i) for i, t in candidates)][:k]


def batch_encoder(load: Callable[[], Callable[[list[str]], Sequence[Sequence[float]]]], batch: int = 64) -> Callable[[Column], Column]:
    """A text encoder as a function of columns: ``load`` gives the model, once a task, and texts go through it ``batch`` at a time.

    This is the place for a real encoder: an iterator pandas UDF, so neither rows nor batches load it again.
    """

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def encode(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for s in series:
            texts = s.fillna("").astype(str).tolist()
            vectors = [np.asarray(v, dtype=float).tolist() for a in range(0, len(texts), batch) for v in model(texts[a : a + batch])]
            yield pd.Series(vectors, dtype=object)

    return encode


def hashed_embedding(dims: int = 64):
    """A deterministic stand-in for a text encoder: signed hashed words, to length one (a pandas UDF, text by text; for a model, see ``batch_encoder``)."""

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def embed(text: pd.Series) -> pd.Series:
        import zlib

        def one(t: str | None) -> list[float]:
            v = np.zeros(dims)
            for w in (t or "").lower().split():
                h = zlib.crc32(w.encode())
                v[h % dims] += 1 if h >> 31 else -1
            n = np.linalg.norm(v)
            return (v / n if n > 1e-12 else v).tolist()

        return text.map(one)

    return embed
