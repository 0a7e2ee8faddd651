"""The serving API as functions: what its routes check, return and log."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.functions import vectors as V
from tidepool.operators import ranking as R
from tidepool.operators.reports import search
from tidepool.operators.retrieval import CATALOG_CELLS, best_of_block
from tidepool.operators.windows import ranked
from tidepool.plans.recommend import recommend
from tidepool.sources.tables import log_event


class BadRequest(ValueError):
    """A request that a server answers with status 422."""


#: Explanations that a service keeps; the one that was asked for longest ago goes first.
EXPLAINED = 10_000


class Service:
    """Recommendations for single queries over a catalogue (item, name, vector, pop).

    A catalogue of at most ``cells`` numbers is held as a matrix, so a query scans no table; of a larger one,
    each query is a Spark job over the catalogue.
    """

    def __init__(self, spark: SparkSession, catalog: DataFrame, embed: Callable[[str], list[float]], item: str = "item", name: str = "name", k_final: int = 10, log: str | None = None, cells: int = CATALOG_CELLS):
        self.spark, self.catalog, self.embed, self.item, self.name, self.k_final, self.log = spark, catalog.persist(), embed, item, name, k_final, log
        self.explained: OrderedDict[tuple[str, int], str] = OrderedDict()
        size = self.catalog.agg(F.coalesce(F.sum(F.size("vector").cast("long")), F.lit(0))).first()[0]
        self.held = self.catalog.select(F.col(item).cast("long").alias("i"), V.unit(F.col("vector")).alias("v"), "pop").orderBy("i").collect() if size <= cells else None
        if self.held:
            self.items, self.matrix = np.array([r["i"] for r in self.held]), np.array([r["v"] for r in self.held])

    def close(self) -> None:
        """Let the catalogue go from the executors' memory."""
        self.catalog.unpersist()

    def health(self) -> dict:
        return {"status": "ok", "n_items": self.catalog.count()}

    def games(self, q: str = "", limit: int = 20) -> list[dict]:
        if not 1 <= limit <= 100:
            raise BadRequest("limit must be from 1 to 100")
        return [r.asDict() for r in search(self.catalog.select(self.item, self.name), self.name, self.item, q, limit).collect()]

    def recommendations(self, query: str, exclude: int | None, k: int = 10) -> list[dict]:
        if exclude is None:
            raise BadRequest("the item to leave out is missing")
        if not 1 <= k <= self.k_final:
            raise BadRequest(f"k must be from 1 to {self.k_final}")
        if not query.strip():
            raise BadRequest("the query is empty")
        top = self._top(exclude, self.embed(query), k)
        rows = [r.asDict() for r in top.join(self.catalog.select(self.item, self.name), self.item).orderBy("rank").collect()]
        if self.log:
            log_event(self.log, {"event_type": "recommendation", "query": query, "exclude_app_id": exclude, "k": k, "app_ids": [r[self.item] for r in rows], "scores": [r["final"] for r in rows]})
        return rows

    def _top(self, exclude: int, vector: list[float], k: int, k_retrieval: int = 100) -> DataFrame:
        """query, item, rank, final of the k best."""
        if not self.held:
            asked = self.spark.createDataFrame([(0, exclude, vector)], f"query long, {self.item} long, vector array<double>")
            return recommend(asked, self.catalog, "query", self.item, k=k, k_retrieval=k_retrieval)
        v = np.asarray(vector, dtype=np.float64)
        n = np.linalg.norm(v)
        _, items, scores = best_of_block(pa.array([0]), pa.array([exclude]), (v / n if n > V.EPS else v)[None], self.items, self.matrix, True, k_retrieval)
        at = np.searchsorted(self.items, items.to_numpy())
        rows = [(0, i, s, float(self.held[a]["pop"])) for i, s, a in zip(items.to_pylist(), scores.to_pylist(), at.tolist())]
        pool = self.spark.createDataFrame(rows, f"query long, {self.item} long, score double, pop double")
        scored = R.RERANKERS["logpop_blend"](pool, "query")
        return ranked(scored, "query", F.col("final"), [F.col(self.item)]).where(F.col("rank") <= k).select("query", self.item, "rank", "final")

    def explain(self, query: str, item: int, generate: Callable[[str, str], str]) -> dict:
        """The explanation of a pair, generated once."""
        known = (query, item) in self.explained
        if not known:
            row = self.catalog.where(F.col(self.item) == item).first()
            if row is None:
                raise BadRequest(f"no item {item}")
            self.explained[query, item] = generate(query, row[self.name])
            if len(self.explained) > EXPLAINED:
                self.explained.popitem(last=False)
        self.explained.move_to_end((query, item))
        if self.log:
            log_event(self.log, {"event_type": "explanation", "query": query, "app_id": item, "cached": known})
        return {"text": self.explained[query, item], "cached": known}
