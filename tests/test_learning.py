"""Descent, rankers and towers against plain NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidepool.operators import rankers as L
from tidepool.operators import towers as T
from tidepool.operators.descent import minimize, summed
from tidepool.operators.retrieval import tower_pool


def pools(seed=1, n=60, length=20):
    """Pool rows whose positives follow a mixture of score and popularity."""
    rnd = np.random.default_rng(seed)
    rows, positives = [], []
    for q in range(n):
        size = int(rnd.integers(3, length + 6))
        score, pop = rnd.random(size), rnd.integers(0, 50, size)
        good = np.argsort(-(2 * np.log1p(pop) - score + rnd.normal(0, 0.3, size)))[: q % 3]
        rows += [(q, i, float(score[i]), float(pop[i]), int(r) + 1) for i, r in zip(range(size), np.argsort(np.argsort(-score)))]
        positives += [(q, int(i)) for i in good]
    return rows, positives


@pytest.fixture(scope="module")
def learnt(spark, tmp_path_factory):
    rows, positives = pools()
    pos = spark.createDataFrame(positives, "query long, item long")
    pool = L.labelled(L.pool_features(spark.createDataFrame(rows, "query long, item long, score double, pop double, rank int")), pos, "query", "item")
    path = str(tmp_path_factory.mktemp("lists") / "lists")
    L.padded_lists(pool, "query", "item", "label", L.FEATURES, 20).repartition(3, "query").write.parquet(path)
    return pool, pos, spark.read.parquet(path), rows, positives


def test_padded_lists(learnt):
    _, _, lists, rows, positives = learnt
    for r in lists.collect():
        mine = sorted((x for x in rows if x[0] == r["query"]), key=lambda x: x[4])[:20]
        assert r["items"] == [x[1] for x in mine] and r["list_len"] == len(mine)
        assert np.allclose(r["x"], [z for x in mine for z in (x[2], np.log1p(x[3]))] + [0.0] * 2 * (20 - len(mine)))
        assert r["y"] == [float((r["query"], x[1]) in positives) for x in mine] + [0.0] * (20 - len(mine))


def test_padded_lists_are_those_of_the_table_function_without_python(spark):
    rows = [(1, 7, 2, 1.0, None), (1, 5, 2, None, 0.5), (1, 9, 1, 0.0, 2.0), (2, 3, 1, 1.0, 1.5), (None, 4, 1, 0.0, 3.0)]
    pool = spark.createDataFrame(rows, "q long, i long, rank int, label double, f double")
    for length in (2, 4):
        got = L.padded_lists(pool, "q", "i", "label", ["f", "rank"], length)
        want = L.PaddedLists(pool.asTable(), F.lit("q"), F.lit("i"), F.lit("label"), F.lit("f,rank"), F.lit(length))
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
        assert "PythonUDTF" not in got._jdf.queryExecution().toString()


def test_picks_make_the_pool_once(spark):
    from tidepool.plans.eval_queries import rerank_picks

    plan = rerank_picks(spark, "/root/testdata/sf0.001")._jdf.queryExecution().analyzed().toString()
    assert plan.count("MapInArrow") == 1


def test_table_function_names_what_is_wrong(spark):
    pool = spark.createDataFrame([(1, 2, 1, 0.5)], "q long, i long, rank int, label double")
    with pytest.raises(Exception, match="lacks"):
        L.PaddedLists(pool.asTable(), F.lit("q"), F.lit("i"), F.lit("label"), F.lit("other"), F.lit(3)).collect()
    with pytest.raises(Exception, match="positive"):
        L.PaddedLists(pool.asTable(), F.lit("q"), F.lit("i"), F.lit("label"), F.lit("label"), F.lit(0)).collect()


@pytest.mark.parametrize("kind", L.KINDS)
def test_each_step_is_that_of_plain_numpy(spark, learnt, kind):
    pool, pos, lists, *_ = learnt
    net = L.train_ranker(lists, pool, kind, steps=6, hidden=8)
    # the same descent on arrays in memory, losses written out anew
    got = lists.toPandas()
    x = np.array(got["x"].tolist()).reshape(len(got), 20, 2)
    y, n = np.array(got["y"].tolist()), got["list_len"].to_numpy()
    x = (x - net.shift) / net.scale
    labels = pool.toPandas()["label"]
    w1 = (labels == 0).sum() / (labels == 1).sum()

    def loss_of(w):
        a, b, c, d = w[:16].reshape(8, 2), w[16:24], w[24:32], w[32]
        total, terms = 0.0, 0
        for i in range(len(x)):
            z = np.maximum(x[i, : n[i]] @ a.T + b, 0) @ c + d
            t = y[i, : n[i]]
            if kind == "listwise":
                if t.sum():
                    total += -((t / t.sum()) * (z - np.log(np.exp(z).sum()))).sum()
                    terms += 1
            else:
                p = 1 / (1 + np.exp(-z))
                total += -(w1 * t * np.log(p) + (1 - t) * np.log(1 - p)).sum()
                terms += n[i]
        return total / terms + 0.5e-4 * w @ w

    def value(w):
        g = np.zeros_like(w)
        for k in range(len(w)):
            e = np.zeros_like(w)
            e[k] = 1e-6
            g[k] = (loss_of(w + e) - loss_of(w - e)) / 2e-6
        return loss_of(w), g

    start = L.start_weights(2, 8)
    assert np.isclose(net.losses[0], loss_of(start)) and np.isclose(net.losses[-1], loss_of(net.weights))
    plain = minimize(value, start, 6)
    assert np.allclose(net.losses, plain.losses, atol=1e-4) and net.losses[-1] < net.losses[0]
    # the expression gives the network's scores
    a, b, c, d = net.parts()
    for r in pool.withColumn("z", net.column()).limit(50).collect():
        z = np.maximum(a @ ((np.array([r["retr_score"], r["log_pop"]]) - net.shift) / net.scale) + b, 0) @ c + d
        assert np.isclose(r["z"], z)


def test_a_learnt_ranker_beats_the_pools_order(learnt):
    pool, pos, lists, *_ = learnt
    quality = L.mean_ndcg(pool, pos, "query", "item", 5)
    net = L.train_ranker(lists, pool, "listwise", steps=12, hidden=8, tune=quality)
    flat = L.Network(("retr_score",), 1, np.array([1.0, 10.0, 1.0, 0.0]), np.zeros(1), np.ones(1))  # the score itself
    assert max(net.tuned) == quality(net) > quality(flat) + 0.2


def test_unknown_kind(learnt):
    with pytest.raises(ValueError, match="kind"):
        L.train_ranker(learnt[2], learnt[0], "other")


def test_sums_do_not_depend_on_attempts(spark):
    df = spark.range(0, 10_000, 1, 90).select((F.rand(3) * 1e9).alias("x"))
    of = lambda b: np.array([b.column(0).to_numpy().sum(), 1.0])
    one, two = (summed(df, of, 2) for _ in range(2))
    assert (one == two).all() and np.isclose(one[0], df.agg(F.sum("x")).first()[0])
    assert (summed(df.limit(0), of, 2) == 0).all()


def test_tower_gradient_is_that_of_finite_differences():
    rnd = np.random.default_rng(2)
    q, v, g = rnd.normal(size=(9, 5)), rnd.normal(size=(9, 5)), np.array([1, 1, 2, 3, 3, 3, 4, 5, 6])
    a, b = rnd.normal(size=(3, 5)), rnd.normal(size=(3, 5))
    _, da, db = T.block_loss(q, v, g, a, b, 0.5)
    for m, d in ((a, da), (b, db)):
        for i in np.ndindex(m.shape):
            old, ends = m[i], []
            for e in (1e-6, -1e-6):
                m[i] = old + e
                ends.append(T.block_loss(q, v, g, a, b, 0.5)[0])
            m[i] = old
            assert np.isclose(d[i], (ends[0] - ends[1]) / 2e-6, atol=1e-5)


def test_learnt_towers_find_more_of_what_was_held_out(spark, tmp_path):
    """Queries are their item's vector under a fixed mixing; a part of the pairs is held out."""
    rnd = np.random.default_rng(4)
    items = rnd.normal(size=(60, 6))
    mix = rnd.normal(size=(6, 6))
    pairs = [(k, int(i), (mix @ items[i] + rnd.normal(0, 0.1, 6)).tolist()) for k, i in enumerate(rnd.integers(0, 60, 500))]
    cat = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(items)], "item long, vector array<double>")
    asked = spark.createDataFrame(pairs, "query long, target long, vector array<double>")
    fit = asked.where("query < 350").join(cat.select(F.col("item").alias("target"), F.col("vector").alias("v")), "target")
    blocks = T.contrastive_blocks(fit, "query", "vector", "v", ["query", "target"], 64)
    assert blocks.count() == 6
    blocks.write.parquet(f"{tmp_path}/blocks")
    towers = T.train_towers(spark.read.parquet(f"{tmp_path}/blocks"), 6, steps=15)
    held = asked.where("query >= 350").withColumn("item", F.lit(-1))
    a, b = T.start_towers(6, 6)

    def hits(x, y):
        pool = tower_pool(held, cat, "query", "item", x.tolist(), y.tolist(), 3)
        return pool.join(held.select("query", F.col("target").alias("item")), ["query", "item"]).count()

    assert towers.losses[-1] < towers.losses[0] / 2
    assert hits(towers.query, towers.item) > 3 * hits(a, b)
    assert T.start_towers(6, 3)[0].shape == (3, 6) and T.start_towers(3, 6)[0].shape == (6, 3)


def test_fixed_scores_are_rounded_once(spark, monkeypatch):
    """A score whose ninth digit rounds up to a half of the sixth."""
    from tidepool.plans import learn_queries as Q

    net = Q._FIXED
    x = np.stack([np.linspace(0.3, 0.9, 4_000_000), np.full(4_000_000, 1.5)], axis=1)
    z = L.scores((x - net.shift) / net.scale, net.weights, net.hidden)[0]
    part = np.abs(z) * 1e6 % 1
    at = np.flatnonzero((part > 0.4999996) & (part < 0.4999999))[:3]
    assert len(at)
    rows = [(1, int(i), 0.0, float(x[i, 0]), 1.5) for i in at]
    monkeypatch.setattr(Q, "_pool", lambda spark, d: spark.createDataFrame(rows, "user long, item long, score double, retr_score double, log_pop double"))
    got = {r["item"]: r["final"] for r in Q.ranker_scores(spark, "").collect()}
    assert got == {int(i): round(float(z[i]), 6) for i in at}


@pytest.mark.parametrize("temperature", [0.02, 0.07, 1.0])
def test_shared_exponentials_lose_nothing(temperature):
    rnd = np.random.default_rng(5)
    q, v, g = rnd.normal(size=(64, 4)), rnd.normal(size=(64, 4)), rnd.integers(0, 40, 64)
    v[0] = -q[0]
    a, b = T.start_towers(4, 4)
    got = T.block_loss(q, v, g, a, b, temperature)
    z = T._unit(q @ a.T)[0] @ T._unit(v @ b.T)[0].T / temperature
    assert np.isclose(got[0], T._far_loss(z, g[:, None] == g[None, :])[0], rtol=1e-12)
