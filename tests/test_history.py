"""Interests, decayed windows, vector means and grids against plain NumPy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidepool.functions import vectors as V
from tidepool.operators import pooling as P
from tidepool.operators import ranking as R
from tidepool.operators.history_grid import history_grid_metrics
from tidepool.operators.retrieval import interest_pool


def unit(v):
    return np.asarray(v) / np.linalg.norm(v)


def lloyd(x, k, rounds):
    x = np.array(sorted(map(tuple, x)))
    c = [x[0]]
    while len(c) < k:
        far = np.min([((x - z) ** 2).sum(axis=1) for z in c], axis=0)
        if far.max() == 0:
            break
        c.append(x[int(far.argmax())])
    c = np.array(c)
    for _ in range(rounds):
        own = ((x[:, None] - c[None]) ** 2).sum(axis=2).argmin(axis=1)
        c = np.array([x[own == j].mean(axis=0) if (own == j).any() else c[j] for j in range(len(c))])
    return c


@pytest.mark.parametrize("cells", [4_000_000, 0])
def test_interests_of_many_keys_at_once(spark, cells):
    rnd = np.random.default_rng(1)
    users = {u: rnd.normal(size=(n, 4)).round(3) for u, n in enumerate([1, 2, 3, 40, 5, 2000])}
    users[1][1] = users[1][0]  # equal vectors: one interest
    rows = [(u, v.tolist()) for u, x in users.items() for v in x] + [(None, [1.0, 0.0, 0.0, 0.0]), (0, None)]
    got = {}
    for r in P.interest_centroids(spark.createDataFrame(rows, "u long, v array<double>"), "u", "v", 3, 4, cells=cells).collect():
        got.setdefault(r["u"], {})[r["cluster"]] = r["vector"]
    assert set(got) == {*users, None} and len(got[1]) == 1
    for u, x in users.items():
        want = lloyd(x, 3, 4)
        assert np.allclose([got[u][j] for j in range(len(want))], want) and len(got[u]) == len(want)


def test_interests_of_keys_with_many_vectors_lie_in_no_bucket(spark):
    rnd = np.random.default_rng(4)
    users = {u: rnd.normal(size=(n, 3)).round(3) for u, n in enumerate([4, 30, 200, 7])}
    df = spark.createDataFrame([(u, v.tolist()) for u, x in users.items() for v in x], "u long, v array<double>")
    got = {}
    for r in P.interest_centroids(df, "u", "v", 3, 2, cells=0, most=25).collect():
        got.setdefault(r["u"], {})[r["cluster"]] = r["vector"]
    assert all(np.allclose([got[u][j] for j in range(3)], lloyd(x, 3, 2)) for u, x in users.items()) and len(got) == 4
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("interests_")]


def test_rounds_of_interests_shuffle_nothing(spark, tmp_path):
    plans = []

    def kept(x):
        plans.append(x._jdf.queryExecution().executedPlan().toString())
        name = f"kept_{len(plans)}"
        x.repartition(4, "__k").write.bucketBy(4, "__k").option("path", str(tmp_path / name)).saveAsTable(name)
        return spark.table(name)

    rows = kept(spark.createDataFrame([((u % 7,), [float(u), float(u * u % 5)]) for u in range(50)], "__k struct<k: long>, __v array<double>"))
    P._centroids(rows, lambda c: c.hint("shuffle_hash"), kept, 3, 2, "u")
    for i in range(len(plans)):
        spark.sql(f"DROP TABLE kept_{i + 1}")
    assert len(plans) == 5 and not any("Exchange hashpartitioning" in p for p in plans[1:])


def test_interest_pool_is_the_best_of_all_interests(spark):
    rnd = np.random.default_rng(2)
    cat, asked = rnd.normal(size=(50, 4)), rnd.normal(size=(8, 3, 4))
    items = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(cat)], "item long, vector array<double>")
    rows = [(q, j, q, v.tolist()) for q, x in enumerate(asked) for j, v in enumerate(x)]
    got = {}
    for r in interest_pool(spark.createDataFrame(rows, "query long, cluster int, item long, vector array<double>"), items, "query", "item", 5).orderBy("rank").collect():
        got.setdefault(r["query"], []).append((r["item"], r["score"]))
    for q, x in enumerate(asked):
        s = (np.array([unit(v) for v in x]) @ np.array([unit(v) for v in cat]).T).max(axis=0)
        want = sorted(((i, v) for i, v in enumerate(s) if i != q), key=lambda z: -z[1])[:5]
        assert [i for i, _ in got[q]] == [i for i, _ in want] and np.allclose([v for _, v in got[q]], [v for _, v in want])


def test_decayed_windows(spark):
    rnd = np.random.default_rng(3)
    window, tau = 100, 37.0
    past = [(u, int(t), rnd.normal(size=3).tolist()) for u, n in ((1, 400), (2, 3), (None, 5)) for t in rnd.integers(-250, 600, n)]
    past += [(1, 200, [1.0, 0.0, 0.0]), (1, 100, [0.0, 1.0, 0.0]), (1, None, [9.0, 9.0, 9.0]), (1, 150, None)]
    asked = [(f"q{i}", u, t, rnd.normal(size=3).tolist()) for i, (u, t) in enumerate([(1, 200), (1, 100), (1, 99), (1, 300), (1, -249), (2, 10_000), (3, 5), (1, 200), (None, 50)] + [(1, int(t)) for t in rnd.integers(-300, 700, 60)])]
    h = spark.createDataFrame(past, "user long, ts long, vector array<double>").repartition(3)
    q = spark.createDataFrame([*asked, ("none", 1, None, [1.0, 0.0, 0.0])], "query string, user long, ts long, vector array<double>")
    got = {r["query"]: r for r in P.decayed_windows(q, h, "user", "ts", "query", "vector", window, tau).collect()}
    assert set(got) == {n for n, *_ in asked}
    for name, u, t, v in asked:
        mine = [(x, math.exp(-(t - s) / tau)) for k, s, x in past if k == u and s is not None and x is not None and t - window < s <= t]
        total = np.array(v) + sum((w * np.array(x) for x, w in mine), np.zeros(3))
        r = got[name]
        assert r["n_history"] == len(mine) and np.isclose(r["weight"], 1 + sum(w for _, w in mine)) and np.allclose(r["vector"], unit(total))


def test_windows_take_two_rows_for_each_row(spark):
    """A user with all the history: rows grow with history and queries, not with their pairs, and lie in many slots."""
    h = spark.range(3000).select(F.lit(1).alias("user"), (F.col("id") % 1000).alias("ts"), F.array(F.lit(1.0)).alias("vector"))
    q = spark.range(500).select(F.lit(1).alias("user"), (F.col("id") * 2).alias("ts"), F.col("id").alias("query"), F.array(F.lit(1.0)).alias("vector"))
    rows = P.window_rows(q, h, "user", "ts", "query", "vector", 50)
    assert rows.count() == 2 * (3000 + 500) and rows.select("key", "slot", "way").distinct().count() >= 40


def test_means_of_vectors(spark):
    rows = [(1, [1.0, 2.0], 0.0), (1, [3.0, 0.0], 0.0), (2, [1.0, None], 2.0), (2, [0.0, 4.0], 6.0), (2, None, 9.0), (3, [5.0, 5.0], None), (4, [1.0, 1.0], -3.0), (4, [2.0, 4.0], 1.0)]
    df = spark.createDataFrame(rows, "k long, v array<double>, w double")
    got = {r["k"]: r["vector"] for r in P.pool_vectors(df, ["k"], "v", F.col("w"), normalize=False).collect()}
    assert {k: np.round(v, 9).tolist() for k, v in got.items()} == {1: [2.0, 1.0], 2: [0.25, 3.0], 3: [5.0, 5.0], 4: [2.0, 4.0]}
    plan = P.pool_vectors(df, ["k"], "v", F.col("w"))._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan  # no row per component


def test_a_grid_reads_the_pool_once(spark, tmp_path):
    spark.createDataFrame([(q, i, float((7 * i + q) % 5), float(i)) for q in range(4) for i in range(9)], "q long, i long, score double, pop double").write.parquet(f"{tmp_path}/pool")
    pool, pos = spark.read.parquet(f"{tmp_path}/pool"), spark.createDataFrame([(0, 3), (1, 8), (2, 2), (2, 5)], "q long, i long")
    configs = [{"alpha": a, "name": n} for a in (0.0, 0.3, 1.0) for n in ("x", "y")]
    got = R.grid_metrics(pool, pos, "q", "i", configs, lambda alpha, name: R.logpop_blend("q", alpha), 3)
    assert got._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    from tidepool.operators import metrics as M

    one = R.grid(pool, "q", [0.0, 0.3, 1.0], lambda a: R.logpop_blend("q", a), lambda p: M.mean_table(M.ranking_metrics(R.ranked(p, "q", F.col("final"), [F.col("i")]), pos, "q", "i", 3), [], ["ndcg"]))
    want = {r["value"]: r["ndcg"] for r in one.collect()}
    rows = got.collect()
    assert {(r["alpha"], r["name"]) for r in rows} == {(c["alpha"], c["name"]) for c in configs} and all(np.isclose(r["ndcg"], want[r["alpha"]]) for r in rows)


def test_history_blends_are_those_of_one_configuration(spark):
    rnd = np.random.default_rng(5)
    q = spark.createDataFrame([(i, rnd.normal(size=3).tolist()) for i in range(6)], "query long, vector array<double>")
    h = spark.createDataFrame([(i % 5, k, rnd.normal(size=3).tolist()) for k, i in enumerate(range(40))], "query long, item long, item_vector array<double>")
    configs = [{"alpha": a, "min_similarity": s, "top_k": t} for a in (0.1, 0.4) for s in (-1.0, 0.3) for t in (1, 4)]
    many = {r["query"]: r["blends"] for r in P.history_blends(q, h, "query", configs).collect()}
    for n, c in enumerate(configs):
        for r in P.history_blend(q, h, "query", c["alpha"], c["min_similarity"], c["top_k"]).collect():
            assert np.allclose(many[r["query"]][n], unit(r["vector"]))


def test_a_history_grid_has_no_row_for_a_configuration_and_is_the_grid_of_blends(spark):
    rnd = np.random.default_rng(6)
    q = spark.createDataFrame([(i, rnd.normal(size=3).tolist()) for i in range(12)], "query long, vector array<double>")
    v = spark.createDataFrame([(i, np.round(rnd.normal(size=3), 1).tolist()) for i in range(40)] + [(40 + i, [1.0, 0.0, 0.5]) for i in range(4)], "item long, item_vector array<double>")
    h = spark.createDataFrame([(i % 11, k) for k, i in enumerate(range(40))], "query long, item long").join(v, "item")
    pool = spark.createDataFrame([(i, (7 * i + 3 * j) % 44) for i in range(12) for j in range(9 + i)], "query long, item long")
    pos = spark.createDataFrame([(i, (7 * i + 3 * j) % 44) for i in range(0, 12, 2) for j in range(1, 9, 3)] + [(1, 99)], "query long, item long")
    configs = [{"alpha": a, "min_similarity": s, "top_k": t} for a in (0.0, 0.1, 0.4) for s in (-1.0, 0.3) for t in (1, 4)]
    got = history_grid_metrics(q, h, pool, v, pos, "query", "item", configs, 4)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan  # no row for a configuration's pool
    blends = P.history_blends(q, h, "query", configs).select("query", "blends")
    both = pool.join(v, "item").join(blends, "query")
    scores = F.transform("blends", lambda b: F.round(V.dot(b, F.col("item_vector")), 9))
    want = {r["config"]: r for r in R.grid_metrics(both, pos, "query", "item", configs, scores, 4).collect()}
    rows = got.collect()
    assert len(rows) == len(configs) == len(want) and all(r["n"] == 7 for r in rows)
    assert all(np.isclose(r[m], want[r["config"]][m]) for r in rows for m in ("alpha", "hit", "precision", "recall", "ap", "ndcg", "mrr"))


def test_support_is_told_by_the_split_and_unknown_parts_are_passed_over(spark, tmp_path):
    from pyspark.sql import functions as F

    from tidepool.operators import pooling as P
    from tidepool.plans import shop as S

    d, small = str(tmp_path), "/root/testdata/sf0.001"
    for t in ("orders", "lineitem"):
        spark.read.parquet(f"{small}/{t}.parquet").write.parquet(f"{d}/{t}.parquet")
    spark.read.parquet(f"{small}/part.parquet").where("p_partkey % 5 <> 0").write.parquet(f"{d}/part.parquet")  # line items name parts that are not there
    rows = S.split(spark, d)
    asked = rows.where("split = 'val' AND flag = 1").where(F.col("item") != F.col("own")).select("user", "item").distinct()
    held = rows.where("split = 'train' AND flag = 1").join(asked, ["user", "item"], "left_anti").select("user", "item", "ts", "id")
    tuples = lambda df: sorted(tuple(r) for r in df.collect())
    assert tuples(S.positives(spark, d)) == tuples(asked) and tuples(S.support(spark, d)) == tuples(held)
    assert "Join" not in S.support(spark, d)._jdf.queryExecution().executedPlan().toString()
    whole = P.train_mean_query(S.queries(spark, d), S.support_vectors(spark, d), "user", ["ts", "id", "item"], 3)
    rounded = lambda df: sorted((r["user"], *(round(x, 9) for x in r["vector"])) for r in df.collect())
    assert rounded(S.train_mean_queries(spark, d)) == rounded(whole)
