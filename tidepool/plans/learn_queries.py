"""Rankers and towers learnt on the shop's pools; what fixed weights give has SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tidepool.functions.hashing import stable_uniform
from tidepool.operators import metrics as M
from tidepool.operators import rankers as L
from tidepool.operators import towers as W
from tidepool.operators.retrieval import tower_pool
from tidepool.operators.windows import ranked
from tidepool.plans import shop as S
from tidepool.plans.shop import K_FINAL, K_POOL, SHOP
from tidepool.sources.tables import scratch

Q, SQL = {}, {}
LENGTH, STEPS = 40, 6


def query(sql: str | None = None):
    def put(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def written(df, name):
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _pool(spark, d):
    """The raw method's pools with features and labels."""
    pool = S.pools(spark, d, methods=("raw",))["raw"].join(S.items(spark, d).select("item", "pop"), "item")
    return L.labelled(L.pool_features(pool), S.positives(spark, d), "user", "item").select("user", "item", "rank", "score", "pop", *L.FEATURES, "label")


_ROWS = f"WITH {SHOP}, r AS (SELECT p.user, p.item, p.rank, p.score AS retr_score, ln(1 + pop) AS log_pop, (pos.item IS NOT NULL)::INT::DOUBLE AS label FROM pools p JOIN it USING (item) LEFT JOIN pos ON pos.user = p.user AND pos.item = p.item WHERE method = 'raw')"


@query(f"""{_ROWS}, u AS (SELECT r.user, count(*)::INT AS list_len FROM r GROUP BY r.user)
SELECT u.user, list_len, place, coalesce(item, -1) AS item, round(coalesce(retr_score, 0), 6) AS retr_score, round(coalesce(log_pop, 0), 6) AS log_pop, coalesce(label, 0) AS label
FROM u CROSS JOIN (SELECT unnest(range(1, {LENGTH + 1}))::INT AS place) p LEFT JOIN r ON r.user = u.user AND r.rank = p.place""")
def listwise_rows(spark, d):
    """Padded lists of pools, a row for each position."""
    lists = L.padded_lists(_pool(spark, d), "user", "item", "label", L.FEATURES, LENGTH)
    at = lists.select("user", "list_len", "items", "x", F.posexplode("y").alias("p", "label"))
    x = lambda k: F.round(F.col("x")[2 * F.col("p") + k], 6)
    return at.select("user", "list_len", (F.col("p") + 1).alias("place"), F.coalesce(F.get("items", F.col("p")), F.lit(-1)).alias("item"), x(0).alias("retr_score"), x(1).alias("log_pop"), "label")


#: Fixed weights of a network with four hidden units, by a rule.
_FIXED = L.Network(L.FEATURES, 4, np.array([((7 * i) % 11 - 5) / 10 for i in range(L.n_weights(2, 4))]), np.array([0.5, 1.0]), np.array([0.25, 2.0]))


def _sql_score(net) -> str:
    a, b, c, d = (x.tolist() if hasattr(x, "tolist") else x for x in net.parts())
    x = [f"(({f} - {m}) / {s})" for f, m, s in zip(net.features, net.shift.tolist(), net.scale.tolist())]
    return " + ".join(f"{v} * greatest(0.0::DOUBLE, {' + '.join(f'{w} * {t}' for w, t in zip(row, x))} + {bias})" for row, bias, v in zip(a, b, c)) + f" + {d}"


@query(f"{_ROWS} SELECT r.user, item, round({_sql_score(_FIXED)}, 6) AS final, row_number() OVER (PARTITION BY r.user ORDER BY round({_sql_score(_FIXED)}, 9) DESC, item)::INT AS rank FROM r")
def ranker_scores(spark, d):
    """The scores of a network with given weights, as an expression."""
    return ranked(_pool(spark, d).withColumn("final", _FIXED.column()), "user", F.round("final", 9), [F.col("item")]).select("user", "item", F.round("final", 6).alias("final"), "rank")


def _learnt(spark, d, kind):
    """Fitted on the lists of a part of the users, measured on the others' beside the pools' own order."""
    pool = written(_pool(spark, d), "pool")
    fit = stable_uniform(2026, "ranker", F.col("user")) < 0.7
    rows = pool.where(fit)
    lists = written(L.padded_lists(rows, "user", "item", "label", L.FEATURES, K_POOL), "lists")
    net = L.train_ranker(lists, rows, kind, steps=STEPS)
    held = pool.where(~fit)
    both = held.select("user", "item", F.lit("raw").alias("method"), F.col("score").alias("final")).unionByName(held.select("user", "item", F.lit(f"two_tower_v1_ranker_{kind}").alias("method"), net.column().alias("final")))
    lists = ranked(both, ["method", "user"], F.col("final"), [F.col("item")])
    return M.ranking_metrics(lists, S.positives(spark, d), "user", "item", K_FINAL, ["method"])


@query()
def listwise_ranker(spark, d):
    return _learnt(spark, d, "listwise")


@query()
def pointwise_ranker(spark, d):
    return _learnt(spark, d, "pointwise")


@query()
def learnt_towers(spark, d):
    """Pools by towers that learn from what customers bought in train."""
    q, it = S.queries(spark, d), S.items(spark, d)
    bought = S.support(spark, d).select("user", "item").distinct().join(q.select("user", F.col("vector").alias("q")), "user").join(it.select("item", F.col("vector").alias("v")), "item")
    blocks = written(W.contrastive_blocks(bought, "user", "q", "v", ["user", "item"]), "blocks")
    towers = W.train_towers(blocks, 8, steps=STEPS)
    return tower_pool(q, it, "user", "item", towers.query.tolist(), towers.item.tolist(), K_POOL)
