"""Several interests, decayed windows and grids over what customers bought, each with the same in SQL."""

from __future__ import annotations

from itertools import product

from pyspark.sql import functions as F

from tidepool.functions import vectors as V
from tidepool.operators import pooling as P
from tidepool.operators import ranking as R
from tidepool.operators import retrieval as T
from tidepool.operators.history_grid import history_grid_metrics
from tidepool.plans import shop as S
from tidepool.plans.shop import _MM, _UNIT, K_FINAL, K_POOL, SHOP
from tidepool.plans.tables import table

Q, SQL = {}, {}
ROUNDS = 2


def query(sql: str | None = None):
    def put(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def _components(df, *ids):
    return df.select(*ids, F.posexplode("vector").alias("i", "x")).select(*ids, (F.col("i") + 1).alias("i"), F.round("x", 6).alias("x"))


# -- interests ----------------------------------------------------------------------------------

_D = "list_sum(list_transform(list_zip(r.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"


def _interests(k: int = 3, rounds: int = ROUNDS) -> str:
    """CTEs from rows r (key, v) to centroids ci (key, i, v)."""
    out = "c0 AS MATERIALIZED (SELECT key, 0 AS i, v FROM r QUALIFY row_number() OVER (PARTITION BY key ORDER BY v) = 1)"
    for j in range(1, k):
        held = " UNION ALL ".join(f"SELECT * FROM c{h}" for h in range(j))
        out += f""",
c{j} AS MATERIALIZED (SELECT key, {j} AS i, v FROM (SELECT r.key, r.v, min({_D}) AS d FROM r JOIN ({held}) c ON c.key = r.key GROUP BY r.key, r.v) WHERE d > 0 QUALIFY row_number() OVER (PARTITION BY key ORDER BY d DESC, v) = 1)"""
    out += f",\nl0 AS MATERIALIZED ({' UNION ALL '.join(f'SELECT * FROM c{h}' for h in range(k))})"
    for n in range(rounds):
        out += f""",
a{n} AS (SELECT n, key, v, min(struct_pack(d := d, i := i)).i AS i FROM (SELECT r.n, r.key, r.v, c.i, {_D} AS d FROM r JOIN l{n} c ON c.key = r.key) GROUP BY n, key, v),
y{n} AS (SELECT key, i, list(x ORDER BY p) AS v FROM (SELECT key, i, p, avg(x) AS x FROM (SELECT key, i, unnest(v) AS x, generate_subscripts(v, 1) AS p FROM a{n}) GROUP BY ALL) GROUP BY key, i),
l{n + 1} AS MATERIALIZED (SELECT l.key, l.i, coalesce(m.v, l.v) AS v FROM l{n} l LEFT JOIN y{n} m ON m.key = l.key AND m.i = l.i)"""
    return out + f",\nci AS (SELECT * FROM l{rounds})"


@query(f"WITH r AS (SELECT vec_id AS n, label AS key, embedding::DOUBLE[] AS v FROM embeddings), {_interests()} SELECT key AS item, i AS cluster, generate_subscripts(v, 1)::INT AS i, round(unnest(v), 6) AS x FROM ci")
def interest_centroids(spark, d):
    """Three centroids of each label's vectors."""
    e = table(spark, d, "embeddings").withColumn("item", F.col("label"))
    return _components(P.interest_centroids(e, "item", "embedding", 3, ROUNDS), "item", "cluster")


@query(f"""WITH {SHOP}, r AS (SELECT row_number() OVER () AS n, b.user AS key, v FROM (SELECT qv.user, v FROM qv UNION ALL SELECT su.user, it.v FROM su JOIN it USING (item)) b), {_interests()},
s AS (SELECT ci.key AS user, it.item, round(max(list_inner_product({_UNIT.format('ci.v')}, it.v)), 12) AS score FROM ci JOIN own ON own.user = ci.key JOIN it ON it.item <> own.own GROUP BY ALL)
SELECT s.user, item, round(score, 6) AS score, row_number() OVER (PARTITION BY s.user ORDER BY score DESC, item)::INT AS rank FROM s QUALIFY rank <= {K_FINAL}""")
def interest_pool(spark, d):
    """Pools by a customer's nearest interest: centroids of the query and of all that was bought in train."""
    q = S.queries(spark, d)
    rows = q.select("user", "vector").union(S.support_vectors(spark, d).select("user", "vector"))
    interests = P.interest_centroids(rows, "user", "vector", 3, ROUNDS).join(q.select("user", "item"), "user")
    return T.interest_pool(interests, S.items(spark, d), "user", "item", K_FINAL).select("user", "item", F.round("score", 6).alias("score"), "rank")


# -- decayed windows -------------------------------------------------------------------------------

DAY, TAU_DAYS = 86400, 180


def _window_sql(days: int) -> str:
    return f"""WITH {SHOP}, q AS (SELECT DISTINCT sp.user || ':' || item || ':' || ts AS query, sp.user, sp.ts, it.v FROM sp JOIN it USING (item) WHERE split = 'val'),
h AS (SELECT su.user, ts, it.v FROM su JOIN it USING (item)),
p AS (SELECT q.query, h.v, exp(-(q.ts - h.ts) / {TAU_DAYS * DAY}.0::DOUBLE) AS w FROM q JOIN h ON h.user = q.user AND h.ts > q.ts - {days * DAY} AND h.ts <= q.ts),
a AS (SELECT query, v, 1.0::DOUBLE AS w, 0 AS past FROM q UNION ALL SELECT query, v, w, 1 FROM p),
n AS (SELECT query, sum(past)::BIGINT AS n_history, sum(w) AS weight FROM a GROUP BY query),
s AS (SELECT query, i, sum(w * x) AS x FROM (SELECT query, w, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM a) GROUP BY query, i)
SELECT s.query, n_history, round(weight, 6) AS weight, i::INT AS i, round(x / sqrt(sum(x * x) OVER (PARTITION BY s.query)), 6) AS x FROM s JOIN n ON n.query = s.query"""


def _window(days: int):
    def run(spark, d):
        it = S.items(spark, d).select("item", "vector")
        asked = S.split(spark, d).where("split = 'val'").select("user", "item", "ts").distinct().join(it, "item").withColumn("query", F.concat_ws(":", "user", "item", "ts"))
        past = P.within_reach(S.support(spark, d).select("user", "ts", "item"), S.split(spark, d).where("split = 'val'"), "user", "ts", days * DAY)
        got = P.decayed_windows(asked, past.join(it, "item"), "user", "ts", "query", "vector", days * DAY, float(TAU_DAYS * DAY))
        return _components(got.withColumn("weight", F.round("weight", 6)), "query", "n_history", "weight")

    return run


for _days in (30, 365):
    Q[f"tw_train_mean_{_days}d"], SQL[f"tw_train_mean_{_days}d"] = _window(_days), _window_sql(_days)


# -- grids -------------------------------------------------------------------------------------------

_BLENDS = [{"value": v} for v in (0.0, 0.5, 1.0)]


@query(f"""WITH {SHOP}, m AS (SELECT p.user, p.item, {_MM('score')} AS a, {_MM('ln(1 + pop)')} AS b FROM pools p JOIN it USING (item) WHERE method = 'raw' WINDOW w AS (PARTITION BY p.user)),
g AS (SELECT value, m.user, m.item, row_number() OVER (PARTITION BY value, m.user ORDER BY value * a + (1 - value) * b DESC, item) AS rank FROM m, (VALUES (0.0::DOUBLE), (0.5), (1.0)) t(value) QUALIFY rank <= {K_FINAL}),
h AS (SELECT g.value, g.user, sum(CASE WHEN pos.item IS NULL THEN 0 ELSE 1 / log2(rank + 1) END) AS dcg FROM g LEFT JOIN pos ON pos.user = g.user AND pos.item = g.item GROUP BY ALL)
SELECT value, round(avg(dcg / list_sum(list_transform(range(1, least(n_eval_targets, {K_FINAL}) + 1), lambda r: 1 / log2(r + 1)))), 6) AS ndcg, count(*) AS n FROM h JOIN ex ON ex.user = h.user WHERE n_eval_targets > 0 GROUP BY value""")
def blend_grid(spark, d):
    """Weights of the log-popularity blend, all in one ranking."""
    pool = T.cosine_pool(S.queries(spark, d), S.items(spark, d), "user", "item", K_POOL).join(S.items(spark, d).select("item", "pop"), "item")
    got = R.grid_metrics(pool, S.positives(spark, d), "user", "item", _BLENDS, lambda value: R.logpop_blend("user", value), K_FINAL)
    return got.select("value", F.round("ndcg", 6).alias("ndcg"), "n")


#: The history blend's grid; fixed values.
GRID = [{"alpha": a, "min_similarity": s, "top_k": t} for a, s, t in product((0.05, 0.1, 0.2, 0.3, 0.4), (0.0, 0.1, 0.2, 0.3, 0.4), (1, 2, 3, 5))]
_VALUES = ", ".join(f"({i}, {c['alpha']}::DOUBLE, {c['min_similarity']}::DOUBLE, {c['top_k']})" for i, c in enumerate(GRID))


@query(f"""WITH {SHOP}, g(config, alpha, min_similarity, top_k) AS (VALUES {_VALUES}),
h AS (SELECT u.user, it.item, it.v, list_inner_product(qv.v, it.v) AS c, row_number() OVER (PARTITION BY u.user ORDER BY round(list_inner_product(qv.v, it.v), 9) DESC, it.item) AS nth FROM (SELECT DISTINCT su.user, item FROM su) u JOIN it USING (item) JOIN qv ON qv.user = u.user QUALIFY nth <= 5),
w AS (SELECT h.user, config, i, sum(c * x) AS x FROM (SELECT h.user, c, nth, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM h) h JOIN g ON c >= min_similarity AND nth <= top_k GROUP BY ALL),
hv AS (SELECT w.user, config, list(x ORDER BY i) AS raw FROM w GROUP BY ALL),
b0 AS (SELECT qv.user, g.config, CASE WHEN hv.raw IS NULL THEN qv.v ELSE list_transform(qv.v, lambda z, i: (1 - alpha) * z + alpha * hv.raw[i] / sqrt(list_inner_product(hv.raw, hv.raw))) END AS raw FROM qv CROSS JOIN g LEFT JOIN hv ON hv.user = qv.user AND hv.config = g.config),
p AS (SELECT pools.user, item, b0.config, round(list_inner_product(b0.raw, it.v) / sqrt(list_inner_product(b0.raw, b0.raw)), 9) AS score FROM pools JOIN it USING (item) JOIN b0 ON b0.user = pools.user WHERE method = 'raw'),
k AS (SELECT p.config, p.user, p.item, row_number() OVER (PARTITION BY config, p.user ORDER BY score DESC, item) AS rank FROM p QUALIFY rank <= {K_FINAL}),
e AS (SELECT k.config, k.user, sum(CASE WHEN pos.item IS NULL THEN 0 ELSE 1 / log2(rank + 1) END) AS dcg, count(pos.item) AS held FROM k LEFT JOIN pos ON pos.user = k.user AND pos.item = k.item GROUP BY ALL)
SELECT g.alpha, g.min_similarity, g.top_k, round(avg((held > 0)::INT), 6) AS hit, round(avg(dcg / list_sum(list_transform(range(1, least(n_eval_targets, {K_FINAL}) + 1), lambda r: 1 / log2(r + 1)))), 6) AS ndcg, count(*) AS n
FROM e JOIN g USING (config) JOIN ex ON ex.user = e.user WHERE n_eval_targets > 0 GROUP BY ALL""")
def history_blend_grid(spark, d):
    """A hundred blends of the query with its history, scored on the pools of the customers that have positives, all in one pass."""
    it = S.items(spark, d).select("item", F.col("vector").alias("item_vector"))
    positives = S.positives(spark, d)
    q = S.queries(spark, d).join(positives.select("user"), "user", "left_semi")
    held = S.support(spark, d).select("user", "item").distinct().join(it, "item")
    pool = T.cosine_pool(q, S.items(spark, d), "user", "item", K_POOL)
    got = history_grid_metrics(q.select("user", "vector"), held, pool, it, positives, "user", "item", GRID, K_FINAL)
    return got.select("alpha", "min_similarity", "top_k", F.round("hit", 6).alias("hit"), F.round("ndcg", 6).alias("ndcg"), "n")
