"""Operators on small hand-made frames."""

import hashlib
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidepool.functions import preferences as Pref
from tidepool.functions import prompts
from tidepool.functions import text as T
from tidepool.functions import vectors as V
from tidepool.functions.hashing import stable_uniform
from tidepool.operators import catalog as C
from tidepool.operators import classification as K
from tidepool.operators import cohorts as H
from tidepool.operators import explanations as X
from tidepool.operators import metrics as M
from tidepool.operators import models
from tidepool.operators import pooling as P
from tidepool.operators import ranking as R
from tidepool.operators import retrieval as Ret
from tidepool.operators import reviews as Rev
from tidepool.operators import splits as S
from tidepool.operators import windows as W
from tidepool.plans import etl
from tidepool.plans import evaluation as Ev
from tidepool.plans.recommend import recommend, regression_gate
from tidepool.plans.serve import BadRequest, Service
from tidepool.sources import http
from tidepool.sources import tables as IO

RAW = "language string, review string, recommended boolean, votes_helpful long, votes_funny long, app_id long, app_name string, review_id long, `author.steamid` long, `author.playtime_at_review` double, `author.last_played` double, timestamp_created long, `Unnamed: 0` long"


def raw(spark, **changes):
    rows = [["english", "Good game.", True, 0, 0, 1, "A", 10, 1, 5.0, 9.0, 100, 0], ["english", "Okay.", False, 1, 0, 1, "A", 11, 1, None, 9.0, 200, 1], ["spanish", "Buen juego.", True, 0, 0, 2, "B", 12, 2, 1.0, 9.0, 300, 2], ["english", "x", True, 0, 0, 2, "B", 13, 2, 1.0, 9.0, 400, 3]]
    names = [c.split(" ")[0] for c in RAW.replace("`Unnamed: 0`", "Unnamed").replace("`", "").split(", ")]
    for c, values in changes.items():
        for r, v in zip(rows, values):
            r[names.index(c)] = v
    return spark.createDataFrame([tuple(r) for r in rows], RAW)


def ids(df):
    return sorted(r["review_id"] for r in df.collect())


def test_filters(spark):
    assert ids(Rev.filter_reviews(raw(spark))) == [10, 11]
    assert ids(Rev.filter_reviews(raw(spark, votes_helpful=[4294967295, 1], votes_funny=[0, 4294967295]))) == []
    assert ids(Rev.filter_reviews(raw(spark, **{"author.playtime_at_review": [-1.0]}))) == [11]
    assert ids(Rev.filter_reviews(raw(spark, **{"author.last_played": [None]}))) == [11]
    plain = spark.createDataFrame([(1, "text")], "review_id long, review string")
    assert ids(Rev.filter_reviews(plain)) == [1]


def test_select_features(spark):
    got = Rev.flags_to_int(Rev.select_features(raw(spark)))
    assert "Unnamed: 0" not in got.columns
    r = {x["review_id"]: x for x in got.collect()}
    assert r[11]["is_helpful"] == 1 and r[10]["is_helpful"] == 0 and r[11]["author.playtime_at_review"] == 0.0


def test_keep_first(spark):
    df = spark.createDataFrame([(1, 3, "c"), (1, 1, "a"), (2, 2, "b"), (1, 1, "b")], "k long, o long, v string").repartition(3)
    assert sorted((r["k"], r["v"]) for r in Rev.keep_first(df, "k", ["o", "v"]).collect()) == [(1, "a"), (2, "b")]


def test_age_and_train_maximum(spark):
    df = spark.createDataFrame([("train", 100), ("train", 200), ("val", 999)], "split string, ts long")
    assert Rev.max_train_timestamp(df, "ts") == 200
    with pytest.raises(ValueError):
        Rev.max_train_timestamp(df.where("split = 'val'"), "ts")
    x = spark.createDataFrame([(1000,), (1500,), (None,), (2500,)], "ts long")
    assert [r[0] for r in x.select(Rev.review_age(F.col("ts"), F.lit(2000))).collect()] == [1000, 500, None, 0]


def test_normalisation(spark):
    df = spark.createDataFrame([(float(i),) for i in range(101)], "`author.playtime_at_review` double")
    p = Rev.fit_caps(df, {"author.playtime_at_review": "cap_log1p", "absent": "log1p"})
    assert p == {"author.playtime_at_review": {"kind": "cap_log1p", "quantile": 0.99, "cap": 99.0}}
    assert Rev.norm_name("author.playtime_at_review") == "_norm_author__playtime_at_review"
    top = Rev.with_normalized(df, p).agg(F.max("_norm_author__playtime_at_review")).first()[0]
    assert math.isclose(top, math.log1p(99))
    with pytest.raises(ValueError):
        Rev.fit_caps(df, {"author.playtime_at_review": "other"})
    back = spark.createDataFrame([(0.0,), (1.0,), (5.0,), (20.0,)], "x double").select(Rev.denormalized(Rev.normalized(F.col("x")), 10.0)).collect()
    assert np.allclose([r[0] for r in back], [0, 1, 5, 10])


def test_stable_uniform_is_md5(spark):
    df = spark.range(200).select("id", stable_uniform(2026, "g", F.col("id")).alias("u"))
    for r in df.collect():
        assert r["u"] == int.from_bytes(hashlib.md5(f"2026|g|{r['id']}".encode()).digest()[:4], "little") / 2**32


@pytest.mark.parametrize("n", [1, 2, 3, 10, 30])
def test_support_aware_split(spark, n):
    rows = [(u, u * 100 + i, i // 2) for u in range(1, 40) for i in range(n)] + [(None, 7, 1)]
    df = spark.createDataFrame(rows, "u long, rid long, ts long")
    got = S.split_support_aware(df, "u", "ts", "rid").toPandas()
    assert len(got) == len(rows) and got[got["u"].isna()]["split"].tolist() == ["train"]
    for _, g in got.dropna().groupby("u"):
        held = g[g["split"] != "train"]
        if n == 1:
            continue
        kind = held["split"].iloc[0]
        want = 1 if n == 2 else min(n - 1, max(2, round(n * (0.15 if kind == "val" else 1 - 0.7 - 0.15))))
        assert held["split"].nunique() == 1 and len(held) == want
        assert set(held["rid"]) == set(g.sort_values(["ts", "rid"])["rid"].tail(want))


def test_split_arguments(spark):
    df = spark.createDataFrame([(1, 1, 1)], "u long, rid long, ts long")
    with pytest.raises(ValueError):
        S.split_support_aware(df, "u", "ts", "rid", 0.9, 0.2)
    with pytest.raises(KeyError):
        S.split_support_aware(df, "who", "ts", "rid")


def test_caps_and_ranks(spark):
    df = spark.createDataFrame([(1, 10, 5), (1, 11, 5), (1, 12, 1), (2, 20, None), (2, 21, 0)], "app long, rid long, v long")
    got = W.cap_per_group(df, "app", [F.col("v").desc_nulls_last(), F.col("rid")], 1)
    assert sorted(r["rid"] for r in got.collect()) == [10, 21]
    s = spark.createDataFrame([(1, 1, 0.5), (1, 2, float("nan")), (1, 3, None), (1, 4, 0.9)], "q long, i long, s double")
    assert [r["i"] for r in W.ranked(s, "q", F.col("s"), [F.col("i")]).orderBy("rank").collect()] == [4, 1, 2, 3]


def test_running_before_over_many_buckets(spark):
    df = spark.range(5000).select(F.col("id").alias("x"), (F.col("id") % 3).alias("n")).repartition(7)
    got = W.running_before(df, "x", {"before": "n"}).orderBy("x").toPandas()
    assert (got["before"] == got["n"].cumsum() - got["n"]).all()


def test_pooling(spark):
    rows = [(1, 9, 1, [1.0, 0.0, 0.0]), (1, 1, 0, [0.0, 1.0, 0.0]), (2, 0, 1, [0.0, 0.0, 1.0])]
    df = spark.createDataFrame(rows, "app long, votes long, rec int, v array<double>")
    pooled = {k: {r["app"]: r for r in P.pool_reviews(df, "app", "v", "votes", "rec", k).collect()} for k in P.VARIANTS}
    assert np.allclose(pooled["flat"][1]["vector"], [0.5**0.5, 0.5**0.5, 0]) and pooled["flat"][1]["recommended_rate"] == 0.5
    x = pooled["log_weighted"][1]["vector"]
    assert x[0] > x[1] > 0 and np.allclose(pooled["log_weighted"][2]["vector"], [0, 0, 1])
    assert pooled["recommended_only"][1]["n_reviews_pooled"] == 1


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0]), ([1.0, 0.0], [0.0, 1.0])], "a array<double>, b array<double>")
    r = df.select(V.unit(F.col("a")).alias("u"), V.cosine(F.col("a"), F.col("b")).alias("c"), V.blend(F.col("a"), F.col("b"), 0.5).alias("m"), V.unit(F.col("b")).alias("z")).collect()
    assert np.allclose(r[0]["u"], [0.6, 0.8]) and r[0]["c"] == 0.0 and r[0]["z"] == [0.0, 0.0] and np.allclose(r[1]["m"], [0.5**0.5] * 2)
    e = spark.createDataFrame([([[1.0, 2.0], [3.0, 4.0]],), ([],)], "v array<array<double>>")
    assert [x[0] for x in e.select(V.mean_vector(F.col("v"))).collect()] == [[2.0, 3.0], []]
    assert [x[0] for x in e.select(V.max_cosine(F.col("v"), F.col("v"))).collect()][1] == 0.0


def test_metric_example(spark):
    ranked = spark.createDataFrame([("q", i, i) for i in range(1, 6)], "q string, i long, rank int")
    pos = spark.createDataFrame([("q", 1), ("q", 3), ("q", 5)], "q string, i long")
    m = M.ranking_metrics(ranked, pos, "q", "i", 5).first()
    assert math.isclose(m["ap"], 0.7556, abs_tol=1e-4) and math.isclose(m["ndcg"], 1.8869 / 2.1309, abs_tol=1e-4) and m["hit"] == m["mrr"] == 1.0
    o = M.oracle_metrics(ranked.where("i <= 2"), pos, "q", "i", 5).first()
    assert o["held"] == 1 and o["oracle_hit"] == 1.0 and o["oracle_ndcg"] < 1
    with pytest.raises(ValueError):
        M.require_subset(ranked, ranked.where("i < 3"), "q", "i")


def test_blends(spark):
    pool = spark.createDataFrame([(1, 1, 0.1, 1.0), (1, 2, 0.5, 10.0), (1, 3, 0.9, 100.0)], "q long, i long, score double, pop double")
    at = lambda a: [r[0] for r in pool.select(R.logpop_blend("q", a), "i").orderBy("i").collect()]
    assert np.allclose(at(1.0), [0, 0.5, 1]) and np.argmax(at(0.0)) == 2
    flat = pool.withColumn("score", F.lit(1.0)).select(W.minmax(F.col("score"), "q")).collect()
    assert {r[0] for r in flat} == {0.0}
    g = R.grid(pool, "q", [0.0, 1.0], lambda a: R.logpop_blend("q", a), lambda p: p.agg(F.avg("final").alias("m")))
    assert g.count() == 2
    picks = pool.withColumn("picks", F.array(F.lit(3).cast("long"), F.lit(1).cast("long")))
    assert [r["i"] for r in R.scores_from_picks(picks, "q", "i").orderBy(F.desc("final")).collect()] == [3, 1, 2]


def test_blocked_and_broadcast_scores_agree(spark):
    rng = np.random.default_rng(1)
    cat = spark.createDataFrame([(i, rng.standard_normal(6).tolist()) for i in range(20)], "i long, vector array<double>")
    q = spark.createDataFrame([(k, k, rng.standard_normal(6).tolist()) for k in range(5)], "q long, i long, vector array<double>")
    one = {(r["q"], r["i"]): r["score"] for r in Ret.cosine_pairs(q, cat, "q", "i").collect()}
    two = {(r["q"], r["i"]): r["score"] for r in Ret.cosine_pairs(q, cat, "q", "i", cells=30).collect()}
    top = [{(r["q"], r["rank"]): r["i"] for r in Ret.cosine_pool(q, cat, "q", "i", 4, cells=c).collect()} for c in (10**6, 30)]
    want = {(k, n + 1): i for k in range(5) for n, i in enumerate(sorted((i for q_, i in one if q_ == k), key=lambda i: (-one[k, i], i))[:4])}
    assert top[0] == top[1] == want
    same = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(9)], "i long, vector array<double>")  # ties go to the smaller id
    asked = spark.createDataFrame([(0, 1, [1.0, 0.0]), (1, None, [1.0, 1.0]), (2, 2, [0.0, 0.0])], "q long, i long, vector array<double>")
    for c in (100, 4):
        got = Ret.cosine_pool(asked, same, "q", "i", 3, cells=c).orderBy("q", "rank").collect()
        assert [(r["q"], r["i"]) for r in got] == [(0, 0), (0, 2), (0, 3), (1, 0), (1, 1), (1, 2), (2, 0), (2, 1), (2, 3)]
    assert Ret.cosine_pool(asked.limit(0), same, "q", "i", 3, cells=4).count() == Ret.cosine_pool(asked, same.limit(0), "q", "i", 3).count() == 0
    items = spark.createDataFrame([(i, float(i % 3)) for i in range(9)], "i long, pop double")
    every = {(r["q"], r["i"], r["score"]) for r in Ret.constant_scores(asked, items, "q", "i", F.col("pop")).collect()}
    assert every == {(r["q"], r["i"], r["score"]) for r in Ret.constant_scores(asked, items, "q", "i", F.col("pop"), cells=128).collect()} and len(every) == 25
    assert [r["i"] for r in Ret.constant_pool(asked, items, "q", "i", "pop", 3).where("q = 2").orderBy("rank").collect()] == [5, 8, 1]
    assert one.keys() == two.keys() and len(one) == 95 and all(math.isclose(one[k], two[k], abs_tol=1e-12) for k in one)


def test_rerankers_name_registered_scorers():
    assert {r.base_method for r in R.RERANKERS.values()} <= set(Ret.SCORERS)


def test_evaluation_refuses_support_that_is_to_be_predicted(spark):
    rows = spark.createDataFrame([(0, 1), (0, 2)], "query long, item long")
    ex = spark.createDataFrame([(0, 2, 1)], "query long, n_eval_targets long, n_support long")
    pools = {m: rows.withColumn("score", F.lit(0.0)) for m in ("raw", "popularity_train", "multi_mean_train")}
    with pytest.raises(ValueError, match="overlap"):
        Ev.evaluate(ex, rows, rows, pools, [], "query", "item", support=rows)


def test_shipped_rerankers_run_in_the_job(spark, tmp_path):
    eye = np.eye(4)
    cat = [(i, eye[i].tolist(), float(10 - i), eye[i].tolist(), eye[i].tolist(), [1.0, float(i)], [float(i), 1.0], [0.0, 0.0]) for i in range(4)]
    cat = spark.createDataFrame(cat, "item long, vector array<double>, pop double, tower_vector array<double>, profile_vector array<double>, genres array<double>, themes array<double>, keywords array<double>")
    q = spark.createDataFrame([(0, 0, [0.1, 0.9, 0.2, 0.0]), (1, 1, [0.9, 0.1, 0.8, 0.0])], "query long, item long, vector array<double>")
    q = q.withColumns({c: F.col("vector") for c in ("train_mean_vector", "tower_vector", "described_vector")})
    q = P.blended_with_own(q, spark.createDataFrame([(0, [0.0, 0.0, 1.0, 0.0])], "item long, description array<double>"), "item", 0.5)
    assert [r["blended_vector"] for r in q.where("query = 1").collect()] == [[0.9, 0.1, 0.8, 0.0]]  # its item has no description
    pos = spark.createDataFrame([(0, 1), (1, 0), (1, 2)], "query long, item long")
    ex = q.join(pos.groupBy("query").agg(F.count("item").alias("n_eval_targets")), "query").select("query", "n_eval_targets", F.lit(1).alias("n_support"), F.col("item").alias("own"))
    pools = Ret.registered_pools(q, cat, "query", "item", [m for m in Ret.SCORERS if m != "fusion_c_raw_plus_behavior"], 3)
    out = Ev.evaluate(ex, pos, cat, pools, list(R.RERANKERS.values()), "query", "item", k_final=2, k_retrieval=3, k_personalization=2, own="own", folder=f"file://{tmp_path}/eval")
    assert {r["method"] for r in out["ranking_overall"].collect()} == {*pools, *R.RERANKERS}
    with pytest.raises(ValueError, match="own items"):
        Ev.evaluate(ex, pos, cat, pools, list(R.RERANKERS.values()), "query", "item", k_final=2, k_retrieval=3)


def test_evaluation_job_and_service(spark, tmp_path):
    eye = np.eye(4)
    cat = spark.createDataFrame([(i, f"Game {i}", eye[i].tolist(), float(10 - i)) for i in range(4)], "item long, name string, vector array<double>, pop double")
    q = spark.createDataFrame([(0, 0, [0.1, 0.9, 0.2, 0.0], 0), (1, 1, [0.9, 0.1, 0.8, 0.0], 2)], "query long, item long, vector array<double>, n_support int")
    pos = spark.createDataFrame([(0, 1), (1, 0), (1, 2)], "query long, item long")
    ex = q.join(pos.groupBy("query").agg(F.count("item").alias("n_eval_targets")), "query").select("query", "n_eval_targets", "n_support")
    pools = Ret.registered_pools(q.withColumn("train_mean_vector", F.col("vector")), cat, "query", "item", ["raw", "popularity_train", "multi_mean_train", "random"], 3)
    blend = R.PoolReranker("logpop_blend", "raw", lambda p, k: p.withColumn("final", R.logpop_blend(k)))
    out = Ev.evaluate(ex, pos, cat, pools, [blend], "query", "item", k_final=2, k_retrieval=3, k_personalization=2, folder=f"file://{tmp_path}/eval", metadata=True)
    meta = out.pop("run_meta")
    raw = {r["query"]: r["hit"] for r in out["ranking"].where("method = 'raw'").collect()}
    assert raw == {0: 1.0, 1: 1.0} and all((df.count() > 0) == ("pop_" not in n) for n, df in out.items())  # all means are equal, so there are no deciles
    assert {r["method"] for r in out["retrieval"].collect()} == set(pools)  # one row for each retrieval method, none for re-rankings
    assert {(r["method"], r["retrieval_method"]) for r in out["ranking_overall"].collect()} == {(p, p) for p in pools} | {("logpop_blend", "raw")}
    assert meta["coverage"]["n_total"] == 2 and meta["counts_by_support_bucket"] == {"0": 1, "1": 0, "2-3": 1, "4-7": 0, "8+": 0} and meta["methods_run"][-1] == "logpop_blend"
    with pytest.raises(ValueError, match="k_retrieval"):
        Ev.evaluate(ex, pos, cat, pools, [], "query", "item", k_final=5, k_retrieval=3)
    with pytest.raises(ValueError, match="multi_mean_train"):
        Ev.evaluate(ex, pos, cat, {"raw": pools["raw"]}, [], "query", "item")
    with pytest.raises(ValueError, match="logpop_blend"):
        Ev.rank_frozen(Ret.pool_rows(pools["random"], "query", "item", "random"), ex, pos, cat, ["random"], [blend], "query", "item", reference=pools["popularity_train"])
    with pytest.raises(KeyError, match="other"):
        Ret.registered_pools(q, cat, "query", "item", ["other"])
    assert [r["item"] for r in recommend(q, cat, "query", "item", R.RERANKERS["bare"], 1, 3).orderBy("query").collect()] == [1, 0]
    s = Service(spark, cat, lambda t: [0.1, 0.9, 0.2, 0.0], log=f"{tmp_path}/log/events.jsonl")
    assert len(s.recommendations("fun", 0, 2)) == 2 and s.games("GAME 1")[0]["item"] == 1 and s.health()["n_items"] == 4
    by_job = Service(spark, cat, lambda t: [0.1, 0.9, 0.2, 0.0], cells=0)
    assert by_job.held is None and by_job.recommendations("fun", 0, 3) == s.recommendations("fun", 0, 3) != s.recommendations("fun", 1, 3)
    assert not s.explain("fun", 1, lambda a, b: b)["cached"] and s.explain("fun", 1, lambda a, b: b)["cached"]
    for bad in ({"exclude": None}, {"exclude": 0, "k": 99}):
        with pytest.raises(BadRequest):
            s.recommendations("fun", **bad)
    from tidepool.streaming import events as E

    stream = E.item_impressions(E.read_log(spark, f"{tmp_path}/log"))
    E.run_to_table(E.distinct_requests(E.read_log(spark, f"{tmp_path}/log")), f"{tmp_path}/out", f"{tmp_path}/check")
    assert stream.isStreaming and spark.read.parquet(f"{tmp_path}/out").count() >= 1


def test_gate():
    assert regression_gate({"a": {"ndcg": 0.5}}, {"a": {"ndcg": 0.5005}}) == []
    assert len(regression_gate({"a": {"ndcg": 0.4, "hit": 2.0}}, {"a": {"ndcg": 0.5}, "b": {}})) == 3


def test_etl_job(spark, tmp_path):
    rows = [(i, "english", f"Review number {i}", i % 2 == 0, i, 0, i % 3, f"App {i % 3}", i % 7, float(i), 9.0, 1000 + i) for i in range(60)]
    df = spark.createDataFrame(rows + rows[:5], "review_id long, language string, review string, recommended boolean, votes_helpful long, votes_funny long, app_id long, app_name string, `author.steamid` long, `author.playtime_at_review` double, `author.last_played` double, timestamp_created long")
    for mode in S.MODES:
        out = etl.run(df, f"{tmp_path}/{mode}", mode=mode)
        assert sum(out["rows"].values()) == 60 and out["params"]["author.playtime_at_review"]["cap"] > 0
    back = spark.read.parquet(f"{tmp_path}/{S.MODES[0]}")
    assert "_norm_author__playtime_at_review" in back.columns
    with pytest.raises(ValueError):
        etl.split(df, mode="other")


def test_csv_with_newlines(spark, tmp_path):
    (tmp_path / "a.csv").write_text('review_id,app_id,extra,review\n1,5,x,"two\nlines, ""quoted"""\n2,6,y,plain\n')
    got = IO.read_csv(spark, f"{tmp_path}/a.csv", columns=["review_id", "review"], multiline=True)
    assert [tuple(r) for r in got.orderBy("review_id").collect()] == [(1, 'two\nlines, "quoted"'), (2, "plain")]
    with pytest.raises(KeyError):
        IO.read_csv(spark, f"{tmp_path}/a.csv", columns=["none"])


def test_files(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "method string, ndcg double")
    IO.write_jsonl(df, f"{tmp_path}/j")
    assert IO.read_jsonl(spark, f"{tmp_path}/j", "method string, ndcg double", "b").count() == 1
    with pytest.raises(ValueError):
        IO.read_jsonl(spark, f"{tmp_path}/j", "method string, ndcg double", "c")
    IO.merge_baseline(f"{tmp_path}/base.json", "retrieval", {"a": 1})
    assert IO.merge_baseline(f"{tmp_path}/base.json", "ranking", {"b": 2}) == {"retrieval": {"a": 1}, "ranking": {"b": 2}}
    v = spark.createDataFrame([(1, [1.0], "x"), (2, [2.0], "y")], "app_id long, vector array<double>, variant string")
    IO.write_vectors(v, f"{tmp_path}/v")
    assert IO.read_vectors(spark, f"{tmp_path}/v", {"variant": "y"}).first()["app_id"] == 2
    with pytest.raises(ValueError):
        IO.write_vectors(v.union(v), f"{tmp_path}/w")
    (tmp_path / "m.json").write_text(json.dumps({"experiments": [{"name": "x", "method": "a"}, {"name": "y", "method": "zz"}]}))
    notes = {r["name"]: r["join_note"] for r in IO.registry(spark, IO.read_manifest(f"{tmp_path}/m.json"), df).collect()}
    assert notes["x"] is None and "zz" in notes["y"]
    (tmp_path / "run").mkdir()
    IO.archive_run(f"{tmp_path}/run", str(tmp_path), "t", "a b")
    with pytest.raises(FileExistsError):
        IO.archive_run(f"{tmp_path}/run", str(tmp_path), "t", "a b")
    assert IO.split_path("r", "val", lambda p: "train" in p)[1] == "train"


def test_http_pages():
    table = [{"id": i, "name": str(i)} for i in range(7)]
    asked = []

    def post(body):
        asked.append(body)
        if "where" in body:
            want = {int(x) for x in body.split("(")[1].split(")")[0].split(",")}
            return [r for r in table if r["id"] in want]
        o = int(body.split("offset ")[1].rstrip(";"))
        return table[o : o + 3]

    assert len(http.fetch_pages(post, ["id", "name"], page=3, sleep=lambda s: None)) == 7
    assert [r["id"] for r in http.fetch_pages(post, ["id"], ids=[5, 1, 5], page=1, sleep=lambda s: None)] == [1, 5]
    answers = iter([(401, []), (200, [{"id": 1}])])
    assert http.with_retry(lambda b, t: next(answers), lambda: "t")("x") == [{"id": 1}]


def test_catalogue(spark):
    lookup = spark.createDataFrame([(8, "P", [1.0, 0.0]), (31, "I", [0.0, 1.0])], "id long, name string, vector array<double>")
    df = spark.createDataFrame([(1, [8, 99, 31]), (2, []), (3, None)], "app_id long, genres array<long>")
    r = {x["app_id"]: x for x in C.enrich(df, "app_id", ["genres"], {"genres": lookup}).collect()}
    assert r[1]["genres_names"] == ["P", "I"] and np.allclose(r[1]["genres_pooled"], [0.5**0.5] * 2) and r[2]["genres_names"] == r[3]["genres_names"] == []
    with pytest.raises(KeyError):
        C.require_ids(df, spark.createDataFrame([(99,)], "app_id long"), "app_id")
    d = spark.createDataFrame([("S", "T"), ("S", None), (None, " ")], "a string, b string").select(T.description(F.col("a"), F.col("b"))).collect()
    assert [x[0] for x in d] == ["S\n\nT", "S", None]


def test_cohorts(spark):
    q = spark.createDataFrame([("u1", 1, 1, 1.0, 1), ("u1", 2, 2, 2.0, 1)], "u string, app long, rid long, ts double, rec int")
    t = spark.createDataFrame([("u1", 3, 3, 0.5, 1), ("u1", 2, 4, 0.1, 1)], "u string, app long, rid long, ts double, rec int")
    rec = H.eval_records(q, t, "u", "app", "rec")
    assert rec.count() == 2 and {r["cohort"] for r in rec.collect()} == {"val_multi_pos_train"}
    ex = H.examples(rec, q, "rid", "u", "app", "rec")
    assert {r["app"]: r["positives"] for r in ex.collect()} == {1: [2], 2: [1]}
    assert [r["support_app"] for r in H.support_rows(ex, t, "rid", "u", "app", "rec", "strict").where("rid = 1").collect()] == [3]
    with pytest.raises(ValueError):
        H.require_disjoint(ex, ex, ["rid"])
    back = H.cohort_from_json(H.cohort_json(ex, "rid"))
    assert sorted(back.select("rid", "positives").collect()) == sorted(ex.select("rid", "positives").collect())
    assert sorted(r["ex_idx"] for r in H.reindexed(ex, 2, "rid").collect()) == [0, 1]
    with pytest.raises(ValueError):
        H.reindexed(ex, 9, "rid")


def test_degenerate_texts_of_any_length(spark, tmp_path):
    from tidepool.plans.catalog_queries import degenerate_text

    prose = " ".join(f"word{i}" for i in range(200))
    texts = [prose, f"{prose} I cannot say.", "loop " * 201 + prose, "loop " * 200 + prose, " \n" * 300, "", None, "b a b a b b", "a b a b a b", "a a a a a"]
    rows = [(i, t, len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r[0]: r[1] for r in degenerate_text(spark, str(tmp_path)).collect()}
    assert [got[i] for i in range(len(texts))] == [False, True, True, False, True, True, True, True, False, False]


def test_models(spark):
    df = spark.createDataFrame([(i, float(i), float(2 * i + 1), int(i >= 25)) for i in range(50)], "id long, x double, y double, c int")
    got = models.predicted(models.fit_linear(df, ["x"], "y"), df, ["x"])
    assert got.where("abs(prediction - y) > 1e-6").count() == 0
    auc = K.roc_auc(models.predicted(models.fit_logistic(df, ["x"], "c"), df, ["x"]), "c", "score").first()[0]
    assert auc == 1.0
    assert 5 < df.select(models.random_by_rate(df, "id", 0.4, 1).alias("p")).agg(F.sum("p")).first()[0] < 35
    assert models.random_by_distribution(df, df, "id", "y", 1).where("draw BETWEEN 1 AND 99").count() == 50
    pairs = spark.createDataFrame([(a, b, 1.0 if a == b else 0.0, int(a == b)) for a in range(3) for b in range(3)], "q long, i long, s double, p int")
    want = -math.log(math.exp(1 / 0.5) / (math.exp(1 / 0.5) + 2))
    assert math.isclose(models.contrastive_loss(pairs, "q", "i", "s", "p", 0.5).first()[0], want)
    assert math.isclose(models.group_cross_entropy(pairs.withColumn("z", F.col("s") * 2), "q", "z", "p").first()["loss"], want)
    assert models.configurations({"a": [1, 2], "b": [3, 4]})[1] == {"a": 1, "b": 4}


def test_preferences_and_prompts(spark):
    df = spark.createDataFrame([("I love farms",), (None,)], "t string")
    assert len(df.select(prompts.hashed_embedding(8)(F.col("t"))).first()[0]) == 8
    assert prompts.OverlapBackend().generate_ranking("cozy farm", [(1, "war"), (2, "a farm"), (3, "cozy farm")], 2) == [3, 2]
    text = df.select(prompts.judge_prompt(F.col("t"), F.lit("g"), F.lit("e"))).first()[0]
    assert "I love farms" in text and "faithfulness" in text


@pytest.mark.parametrize(("said", "want"), [
    ("I loved it and I like stealth, but I hated the long grind, and bugs.", {"likes": ["stealth", "it and i like stealth"], "dislikes": ["the long grind", "and bugs"], "constraints": ["shorter pacing preferred", "low grind preferred"], "confidence": "normal"}),
    ("I want co-op; must have fishing, cozy. I don't like pvp.", {"likes": ["co-op", "multiplayer/co-op interaction"], "must_have": ["fishing"], "style_tone": ["cozy"], "avoid": ["heavy pvp focus"]}),
    ("too grindy. Too  GRINDY", {"dislikes": ["grindy"], "avoid": ["grindy or repetitive progression loops"], "confidence": "normal"}),
    ("I enjoy solo play", {"constraints": ["single-player preference"], "likes": ["solo play"], "confidence": "low"}),
    ("looking for: - long games -", {"likes": ["long games"], "dislikes": []}),
    ("i like " + "a" * 200, {"likes": ["a" * 119]}),
    (" ", {"likes": [], "confidence": "low", "raw_query": ""}),
    (None, {"avoid": [], "confidence": "low", "raw_query": ""}),
])
def test_preferences(spark, said, want):
    df = spark.createDataFrame([(said, 1)], "t string, preferences int")
    got = Pref.with_preferences(df, "t")
    p = got.first()["preferences"].asDict()
    assert got.columns == ["t", "preferences"] and {k: p[k] for k in want} == want


def test_embedding_text(spark):
    df = Pref.with_preferences(spark.createDataFrame([("I loved Chess, but I hated the grind",), (None,)], "t string"), "t")
    made = [r[0] for r in df.select(Pref.embedding_text(F.col("preferences"))).collect()]
    assert made[0].startswith("WANTS: chess. AVOIDS: grindy or repetitive progression loops, the grind. MUST_HAVE: none. DISLIKES: the grind.")
    assert made[0].endswith("CONFIDENCE: normal. OPTIONAL_CONTEXT: i hated the grind.") and made[1].endswith("CONFIDENCE: low.")
    assert df.select(Pref.embedding_text(F.col("preferences"), 5)).first()[0].endswith("OPTIONAL_CONTEXT: i hat.")


def test_calibration_names_lost_examples(spark):
    labels = spark.createDataFrame([(0, 5, 4), (1, 3, 2), (2, 1, 1)], "example_id long, human_faithfulness int, human_relevance int")
    proxies = spark.createDataFrame([(i, 0.1 * i, 0.2, 0.3 * i, False) for i in range(3)], "example_id long, content_overlap_ratio double, relevance_cosine double, relevance_cosine_query_game double, is_degenerate boolean")
    judged = spark.createDataFrame([(0, 5, 4), (1, 4, 2), (2, 1, 3)], "example_id long, judge_faithfulness int, judge_relevance int")
    row = X.summarize_calibration(X.calibration(labels, proxies, judged)).first().asDict()
    assert row["n_examples"] == 3 and math.isclose(row["judge_faithfulness_exact_agreement_rate"], 2 / 3) and row["judge_faithfulness_within_1_rate"] == 1 and math.isclose(row["judge_faithfulness_spearman"], 1)
    assert row["heuristic_relevance_vs_review_spearman"] is None and math.isclose(row["heuristic_groundedness_spearman"], -1)
    assert X.summarize_judge(judged).first()["judge_relevance_median"] == 3
    with pytest.raises(ValueError, match="judge"):
        X.calibration(labels, proxies, judged.where("example_id < 2"))
    with pytest.raises(ValueError, match="heuristic"):
        X.calibration(labels, proxies.where("example_id < 2"), judged)


def test_explanations_are_scored(spark):
    df = spark.createDataFrame([("A cozy farm game", "farm game", ["farm"], [1.0, 0.0], [1.0, 0.0], [0.0, 1.0]), ("", "x", None, [0.0, 0.0], [1.0, 0.0], [1.0, 0.0])], "explanation string, candidate_text string, tags array<string>, explanation_vector array<double>, query_vector array<double>, query_game_vector array<double>")
    a, b = X.score_explanations(df, F.array(F.lit("farm"), F.lit("cozy"))).collect()
    assert (a["is_degenerate"], a["ungrounded_tags"], a["relevance_cosine"], a["relevance_cosine_query_game"]) == (False, ["cozy"], 1.0, 0.0) and b["is_degenerate"] and b["relevance_cosine"] == 0
    assert X.summarize_explanations(X.score_explanations(df, F.array(F.lit("cozy")))).first()["any_ungrounded_tag_rate"] == 0.5


def test_npz_and_moves(spark, tmp_path):
    df = spark.createDataFrame([(3, [1.0, 2.0]), (1, [0.5, 0.25])], "app_id long, vector array<float>")
    IO.write_npz(df, f"{tmp_path}/a/m.npz")
    assert [tuple(r) for r in IO.read_npz(spark, f"{tmp_path}/a/m.npz").collect()] == [(1, [0.5, 0.25]), (3, [1.0, 2.0])]
    (tmp_path / "old").mkdir()
    plan = IO.plan_moves({"old": "new/place", "absent": "x", "a": "a"}, str(tmp_path))
    assert [p["action"] for p in plan] == ["move", "skip", "conflict"]
    with pytest.raises(FileExistsError):
        IO.move_planned(plan, str(tmp_path))
    assert IO.move_planned(plan[:2], str(tmp_path)) == 1 and (tmp_path / "new" / "place").is_dir()


def test_http_client_renews_its_token_and_keeps_pace():
    import contextlib
    import json
    import urllib.error
    from types import SimpleNamespace

    asked, now = [], [0.0]

    def opener(request):
        asked.append((request.full_url, request.get_header("Authorization")))
        if "token" in request.full_url:
            return contextlib.nullcontext(SimpleNamespace(status=200, read=lambda: json.dumps({"access_token": f"t{len(asked)}", "expires_in": 1000}).encode()))
        if request.get_header("Authorization") == "Bearer t1" and len(asked) > 2:
            raise urllib.error.HTTPError(request.full_url, 401, "old", None, None)
        return contextlib.nullcontext(SimpleNamespace(status=200, read=lambda: b'[{"id": 7}]'))

    def sleep(s):
        now[0] += s

    c = http.Client("http://x/games", "http://x/token", "me", "s", opener=opener, clock=lambda: now[0], sleep=sleep)
    assert c.post("fields id;") == [{"id": 7}] and c.post("fields id;") == [{"id": 7}]
    assert [u.rsplit("/", 1)[1] for u, _ in asked] == ["token", "games", "games", "token", "games"] and asked[-1][1] == "Bearer t4" and now[0] >= 0.52


def test_lookups_and_histories(spark):
    df = spark.createDataFrame([(1, 2)], "user long, item long")
    texts = spark.createDataFrame([(1, 2, "a"), (1, 3, "b")], "user long, item long, query_text string")
    assert H.with_lookup(df, texts, ["user", "item"]).first()["query_text"] == "a"
    with pytest.raises(KeyError, match="query_text"):
        H.with_lookup(df, texts.where("item = 3"), ["user", "item"])
    runs = Ev.run_history({"b": df, "a": texts}, {"a": "2024-01-01 00:00:00", "b": "2024-02-01 00:00:00"}).collect()
    assert [r["run"] for r in runs] == ["a", "a", "b"] and runs[2]["query_text"] is None


@pytest.mark.parametrize("shape", ["spread", "tied"])
def test_pruned_pool_is_exact_and_scores_few_pairs(spark, shape, monkeypatch):
    from tidepool.operators import pruned

    monkeypatch.setattr(pruned, "LEAF", 32)
    rng = np.random.default_rng(3)
    x = rng.standard_normal((3000, 3)) if shape == "spread" else rng.integers(0, 3, (3000, 3)).astype(float)  # tied: few directions, some of length zero
    cat = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(3000, [float("nan"), 1.0, 1.0])], "i long, vector array<double>")
    asked = [(k, k * 7 if k % 9 else None, x[k * 7].tolist() if k % 2 else rng.standard_normal(3).tolist()) for k in range(200)]
    q = spark.createDataFrame(asked, "q long, i long, vector array<double>")
    got = {}
    for r in Ret.cosine_pool(q, cat, "q", "i", 5, cells=3000).collect():
        got.setdefault(r["q"], {})[r["rank"]] = (r["i"], r["score"])
    unit = lambda v: v / n if (n := np.linalg.norm(v)) > 1e-12 else v
    u = np.array([unit(v) for v in x])
    for k, own, v in asked:
        s = np.round(u @ unit(np.array(v)), 12)
        want = sorted((i for i in range(3000) if i != own), key=lambda i: (-s[i], i))[:5]
        assert [got[k][n + 1][0] for n in range(5)] == want and np.allclose([got[k][n + 1][1] for n in range(5)], s[want], atol=1e-11)
    if shape == "spread":
        tree = pruned.grow(u, 64)
        leaf = tree.leaves(u)
        of = [u[leaf == n] for n in range(tree.n_leaves)]
        boxes = pruned.Boxes(np.array([y.min(axis=0) for y in of]), np.array([y.max(axis=0) for y in of]), np.ones(len(of)), np.arange(len(of)), np.ones(len(of), int))
        least = np.sort(u[:300] @ u.T, axis=1)[:, -5]
        row, _ = boxes.reached(u[:300], least, -1)
        assert len(row) < 300 * len(of) / 8


def test_constant_sums_are_those_of_all_pairs(spark):
    items = spark.createDataFrame([(i, float(i % 3) or 1e-6) for i in range(9)] + [(4, 2.0)], "i long, pop double")
    asked = spark.createDataFrame([(0, 1), (1, None), (2, 4), (2, 8), (3, 99)], "q long, i long")
    pairs = Ret.constant_scores(asked, items, "q", "i", F.col("pop")).groupBy("q").agg(F.count(F.lit(1)).alias("n"), F.sum("i").alias("items"), F.sum("score").alias("s"))
    want = {r["q"]: (r["n"], r["items"], round(r["s"], 9)) for r in pairs.collect()}
    sums = Ret.constant_sums(asked, items, "q", "i", "pop")
    assert {r["q"]: (r["n"], r["items"], round(float(r["score"]), 9)) for r in sums.collect()} == want
    assert Ret.constant_sums(asked.where("q = 0"), items.where("i = 1"), "q", "i", "pop").count() == 0


@pytest.mark.parametrize("sizes", [(1, 1 << 20), (40, 16)])
def test_pruned_queries_meet_leaves_by_blocks(spark, sizes, monkeypatch):
    """No row per query and leaf is sent, whether all queries are one block or a leaf's queries are several."""
    from tidepool.operators import pruned

    for name, value in (("LEAF", 32), ("BLOCKS", sizes[0]), ("LEAST_QUERIES", 1), ("MOST_QUERIES", sizes[1]), ("AT_ONCE", 600)):
        monkeypatch.setattr(pruned, name, value)
    rng, written, kept = np.random.default_rng(5), {}, pruned._kept
    monkeypatch.setattr(pruned, "_kept", lambda df, name: written.setdefault(name, kept(df, name)) if name == "asks" else kept(df, name))
    x = rng.standard_normal((2000, 3)) + [2.0, 0.0, 0.0]
    near = np.concatenate([x[:200] + rng.normal(0, 0.05, (200, 3)), x[:1] + rng.normal(0, 0.001, (100, 3))])  # a hundred in one leaf
    cat = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "i long, vector array<double>")
    q = spark.createDataFrame([(k, k % 200, v.tolist()) for k, v in enumerate(near)], "q long, i long, vector array<double>")
    got = {}
    for r in Ret.cosine_pool(q, cat, "q", "i", 5, cells=1500).collect():
        got.setdefault(r["q"], []).append((r["rank"], r["i"]))
    u = x / np.linalg.norm(x, axis=1)[:, None]
    s = np.round((near / np.linalg.norm(near, axis=1)[:, None]) @ u.T, 12)
    s[np.arange(300), np.arange(300) % 200] = -np.inf
    assert {k: [i for _, i in sorted(v)] for k, v in got.items()} == {k: np.lexsort((np.arange(2000), -s[k]))[:5].tolist() for k in range(300)}
    asks = written["asks"].agg(F.count_distinct("__b").alias("b"), F.count(F.lit(1)).alias("n"), F.max("__s").alias("s")).first()
    assert asks["b"] == 1 and asks["n"] <= 64 and asks["s"] >= 1 if sizes[0] == 1 else asks["b"] > 20


def test_dealt_blocks_are_bounded_and_in_order():
    from tidepool.operators.pruned import Best, dealt

    first, parts = dealt(np.array([3, 4, 9, 25, 0, 2, 8]), 10)
    assert first.tolist() == [0, 0, 1, 2, 5, 5, 5] and parts.tolist() == [1, 1, 1, 3, 1, 1, 1]
    best = Best(np.full(2, -np.inf), 2)
    best.add(np.array([1, 0, 1]), np.array([5, 6, 3]), np.array([0.5, 0.1, 0.5]))
    best.add(np.array([1]), np.array([1]), np.array([0.4]))
    r, i, s = best.cut()
    assert r.tolist() == [0, 1, 1] and i.tolist() == [6, 3, 5] and best.least.tolist() == [-np.inf, 0.5]


def test_retrieval_tables_need_no_lists(spark, tmp_path):
    """Retrieval is evaluated without ranking anything, a pool's own rank is kept, and the whole evaluation goes on from there."""
    from tidepool.plans import evaluation as E

    ex = spark.createDataFrame([(0, 1, 2, 3), (1, 2, 1, 0), (2, 3, 0, 1)], "u long, own long, n_eval_targets int, n_support int")
    pos = spark.createDataFrame([(0, 4), (0, 5), (1, 6)], "u long, i long")
    cat = spark.createDataFrame([(i, [1.0, float(i)], float(i)) for i in range(8)], "i long, vector array<double>, pop double")
    made = lambda by: spark.createDataFrame([(u, i, by(i)) for u in range(3) for i in range(8) if i != u + 1], "u long, i long, score double")
    pools = {"raw": made(float), "popularity_train": made(lambda i: 1.0), "multi_mean_train": made(lambda i: -float(i)).withColumn("rank", F.lit(1) + F.col("i"))}
    assert {(r["rank"], r["i"]) for r in E.long_pools(pools, "u", "i").where("method = 'multi_mean_train'").collect()} == {(i + 1, i) for i in range(8)}
    given = (ex, pos, cat, pools)
    got = E.evaluate_retrieval(*given, "u", "i", k_final=2, k_retrieval=4, folder=f"{tmp_path}/a")
    assert not (tmp_path / "a" / "lists").exists() and (tmp_path / "a" / "pools").exists()
    whole = E.evaluate(*given, [], "u", "i", k_final=2, k_retrieval=4, k_personalization=2, folder=f"{tmp_path}/b")
    again = E.evaluate(*given, [], "u", "i", k_final=2, k_retrieval=4, k_personalization=2, folder=f"{tmp_path}/a", retrieved=got)
    rows = lambda t: sorted(map(str, t.collect()))
    for name in ("retrieval", "retrieval_by_slice", "retrieval_pop_delta"):
        assert rows(got[name]) == rows(whole[name]) == rows(again[name]) and rows(got[name])
    assert rows(whole["ranking_overall"]) == rows(again["ranking_overall"])
