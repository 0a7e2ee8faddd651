"""The index of a collection, the service as a data source, keys accepted over chunks, and kept scores."""

import json
import re
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidepool.operators import cells
from tidepool.operators.retrieval import cosine_pool
from tidepool.operators.reviews import keep_first
from tidepool.sources.accepted import AcceptedKeys
from tidepool.sources.memo import ScoreMemo
from tidepool.sources.service import ServiceReader, service_rows


def best(df):
    out = {}
    for r in df.orderBy("rank").collect():
        out.setdefault(r["query"], []).append((r["item"], r["score"]))
    return out


def test_index_finds_what_the_exact_search_finds(spark, tmp_path):
    rnd = np.random.default_rng(1)
    centre = rnd.normal(size=(20, 8))
    x = centre[rnd.integers(0, 20, 1500)] + rnd.normal(0, 0.4, (1500, 8))
    x[:500] = x[0]  # a third of all rows in one cell
    x[:500] += rnd.normal(0, 1e-3, (500, 8))
    df = spark.createDataFrame([(i, v.tolist(), f"n{i}") for i, v in enumerate(x)] + [(9000, None, "none")], "item long, vector array<double>, name string")
    path = f"{tmp_path}/index"
    assert cells.build_index(df, path, "item", "vector", 30, sample=800) == 30
    q = df.where("item % 29 = 0 AND vector IS NOT NULL").select(F.col("item").alias("query"), "item", "vector")
    want = best(cosine_pool(q, df.where("vector IS NOT NULL"), "query", "item", 10))
    found = cells.search_index(spark, path, q, "query", "item", "vector", 10, probes=6)
    near = best(found)
    recall = np.mean([len({i for i, _ in near[k]} & {i for i, _ in w}) / len(w) for k, w in want.items()])
    assert recall >= 0.9
    exact = best(cells.search_index(spark, path, q, "query", "item", "vector", 10, probes=30, cells=1000))
    assert exact.keys() == want.keys() and all([i for i, _ in exact[k]] == [i for i, _ in w] for k, w in want.items())
    # a search reads the partitions of its cells only
    one = cells.search_index(spark, path, q.limit(1), "query", "item", "vector", 5, probes=1)
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*cell#\d+ (IN|=)", plan), plan
    assert spark.read.parquet(f"{path}/vectors").where("cell = 0").count() + spark.read.parquet(f"{path}/vectors").where("cell > 0").count() == 1501


def test_the_exact_search_copies_no_query_for_each_cell(spark, tmp_path, monkeypatch):
    rnd = np.random.default_rng(2)
    x = rnd.normal(size=(900, 8))
    x[300:600] = x[:300]  # ties
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "item long, vector array<double>")
    cells.build_index(df, f"{tmp_path}/index", "item", "vector", 12)
    q = df.select(F.col("item").alias("query"), "item", "vector")
    want = best(cosine_pool(q, df, "query", "item", 7))
    monkeypatch.setattr(cells, "probed", lambda *a: pytest.fail("a row for each query and cell"))
    for size in (1000, 4_000_000):  # eight blocks, and one
        assert best(cells.search_index(spark, f"{tmp_path}/index", q, "query", "item", "vector", 7, probes=12, cells=size)) == want


class Games(BaseHTTPRequestHandler):
    """A stub of the service: its token is refused after a few requests."""

    rows = [{"id": i, "name": f"g{i}", "genres": [i % 3], "rating": i} for i in range(25)]
    served, tokens, starts = {}, [], []

    def do_POST(self):  # noqa: N802
        import time

        body = self.rfile.read(int(self.headers["Content-Length"])).decode()
        if self.path == "/token":
            Games.tokens.append(f"t{len(Games.tokens)}")
            return self.answer(200, {"access_token": Games.tokens[-1], "expires_in": 3600})
        own = self.headers["Authorization"].split()[1]
        Games.served[own] = Games.served.get(own, 0) + 1
        if Games.served[own] > 2:
            return self.answer(401, [])
        Games.starts.append(time.monotonic())
        parts = dict(p.strip().split(" ", 1) for p in body.strip().rstrip(";").split(";"))
        got = self.rows
        if "where" in parts:
            want = {int(x) for x in parts["where"].split("(")[1].split(")")[0].split(",")}
            got = [r for r in got if r["id"] in want]
        at, n = int(parts["offset"]), int(parts["limit"])
        return self.answer(200, got[max(0, at - 1) : at + n] if "where" not in parts else got)  # pages overlap by a row

    def do_GET(self):  # noqa: N802
        self.answer(200, {"count": len(self.rows)})

    def answer(self, status, value):
        raw = json.dumps(value).encode()
        self.send_response(status)
        self.send_header("Content-Length", str(len(raw)))
        self.end_headers()
        self.wfile.write(raw)

    def log_message(self, *args):
        pass


@pytest.fixture
def service():
    server = ThreadingHTTPServer(("127.0.0.1", 0), Games)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    Games.served, Games.tokens, Games.starts = {}, [], []
    url = f"http://127.0.0.1:{server.server_port}"
    yield {"url": f"{url}/games", "token_url": f"{url}/token", "client_id": "me", "secret": "s", "count_url": f"{url}/count"}
    server.shutdown()


SCHEMA = "id long, name string, genres array<long>, rating double"


def test_service_pages(spark, service):
    got = service_rows(spark, SCHEMA, page="3", partitions="3", pace="300", **service).orderBy("id").collect()
    assert [r["id"] for r in got] == list(range(25)) and got[4].asDict() == {"id": 4, "name": "g4", "genres": [1], "rating": 4.0}
    assert len(Games.tokens) > 3  # each partition renews its token when it is refused


def test_service_ids_and_pace(spark, service):
    service.pop("count_url")
    got = service_rows(spark, SCHEMA, ids="7,1,7,99,3", page="1", partitions="1", pace="10", **service)
    assert [r["id"] for r in got.orderBy("id").collect()] == [1, 3, 7]
    gaps = np.diff(Games.starts)
    assert len(gaps) == 3 and min(gaps) > 0.09  # four ids, one after another
    assert got.rdd.getNumPartitions() >= 1 and service_rows(spark, SCHEMA, ids="", **service).count() == 0


def test_service_needs_a_schema_with_ids(spark):
    from tidepool.sources.service import ServiceSource

    with pytest.raises(ValueError, match="id"):
        ServiceSource({}).reader(spark.createDataFrame([], "name string").schema)
    bodies = ServiceReader(spark.createDataFrame([], "id long, name string").schema, {"rows": "1200", "where": "rating > 3", "partitions": "2"}).partitions()
    assert [len(p.bodies) for p in bodies] == [2, 1] and bodies[1].bodies == ["fields id,name; where rating > 3; sort id asc; limit 500; offset 1000;"]


def test_chunks_give_the_rows_of_one_run(spark, tmp_path):
    rnd = np.random.default_rng(2)
    rows = [(n, None if k == 0 else f"k{k}", float(n)) for n, k in enumerate(rnd.integers(0, 300, 900))]
    chunks = [rows[:400], rows[400:700], rows[:100], rows[700:], []]
    store = AcceptedKeys(spark, f"file://{tmp_path}/keys", buckets=8, bits=1 << 10)
    got, looked = [], []
    for c in chunks:
        df = spark.createDataFrame(c, "n long, key string, x double").repartition(2)
        got += [tuple(r) for r in AcceptedKeys(spark, store.folder, 8, 1 << 10).admit(df, "key", ["n"]).collect()]
    want = keep_first(spark.createDataFrame(rows, "n long, key string, x double"), "key", ["n"]).collect()
    assert sorted(got) == sorted(map(tuple, want))
    assert len(store.versions()) == 5


def test_new_keys_need_no_look_up_and_broken_runs_leave_nothing(spark, tmp_path):
    store = AcceptedKeys(spark, f"file://{tmp_path}/keys", buckets=4, bits=1 << 16)
    make = lambda a, b: spark.range(a, b).select(F.col("id").alias("key"))
    assert store.admit(make(0, 200), "key", ["key"]).count() == 200 and store.looked_up == 0
    assert store.admit(make(200, 220), "key", ["key"]).count() == 20 and store.looked_up <= 1
    bad = make(500, 510).withColumn("key", F.when(F.col("key") == 505, F.raise_error(F.lit("broken"))).otherwise(F.col("key")))
    with pytest.raises(Exception, match="broken"):
        store.admit(bad, "key", ["key"])
    assert store.admit(make(495, 515), "key", ["key"]).count() == 20 and store.admit(make(0, 515), "key", ["key"]).count() == 275


def test_a_second_run_scores_no_row(spark, tmp_path):
    calls = []

    def score(keys):
        calls.append(sorted((r["user"], r["app"]) for r in keys.collect()))
        return keys.withColumn("score", F.coalesce(F.col("app"), F.lit(-1)) * 2.0).where("app IS NULL OR app <> 3")  # one key has no rows

    memo = ScoreMemo(spark, f"file://{tmp_path}/memo", ["user", "app"], 8)
    first = spark.createDataFrame([(1, 1), (1, 2), (2, None), (1, 1), (4, 3)], "user long, app long")
    got = sorted(tuple(r) for r in memo.scores(first, score).select("user", "app", "score").collect())
    assert got == [(1, 1, 2.0), (1, 2, 4.0), (2, None, -2.0)] and memo.n_scored == 4
    assert sorted(tuple(r) for r in memo.scores(first, score).select("user", "app", "score").collect()) == got and memo.n_scored == 0 and len(calls) == 1
    more = spark.createDataFrame([(1, 2), (9, 9)], "user long, app long")
    assert sorted(tuple(r) for r in memo.scores(more, score).select("user", "app", "score").collect()) == [(1, 2, 4.0), (9, 9, 18.0)]
    assert memo.n_scored == 1 and calls[1] == [(9, 9)]


def test_explanations_are_generated_once(spark, tmp_path):
    from tidepool.plans import explain

    pairs = spark.createDataFrame([(1, 7, "likes ships", "A game of ships"), (2, 7, None, "A game of ships"), (3, 8, "x", "Z" * 900)], "user long, item long, query_text string, candidate_text string")
    said, rated = (ScoreMemo(spark, f"file://{tmp_path}/{n}", ["user", "item"], 4) for n in ("said", "rated"))
    rows = {r["user"]: r for r in explain.judge(explain.explain(pairs, explain.echo_model, said), explain.length_judge, rated).collect()}
    assert rows[1]["explanation"] == "It has A game of ships" and (rows[1]["judge_relevance"], rows[1]["judge_faithfulness"]) == (3, 5)
    assert len(rows[3]["explanation"]) < 640 and said.n_scored == rated.n_scored == 3
    broken = lambda batches: (b.map(lambda p: "no JSON") for b in batches)
    again = explain.judge(explain.explain(pairs, broken, said), broken, rated).collect()
    assert {r["user"]: r["explanation"] for r in again} == {u: r["explanation"] for u, r in rows.items()} and said.n_scored == 0
    fresh = ScoreMemo(spark, f"file://{tmp_path}/other", ["user", "item"], 4)
    assert {r["judge_relevance"] for r in explain.judge(explain.explain(pairs, broken, said), broken, fresh).collect()} == {None}


def test_single_files_and_bounds(spark, tmp_path):
    from tidepool.operators import classification as K
    from tidepool.sources import tables as IO

    a, b = spark.createDataFrame([(1, "x")], "i int, s string"), spark.createDataFrame([("y", 2, 0)], "s string, i long, more int")
    assert IO.write_single([a, b], f"{tmp_path}/one") == 2
    back = spark.read.parquet(f"{tmp_path}/one")
    assert back.schema.simpleString() == "struct<i:int,s:string>" and len(back.inputFiles()) == 1
    with pytest.raises(KeyError):
        IO.write_single([a, spark.createDataFrame([(1,)], "i int")], f"{tmp_path}/two")
    v = spark.createDataFrame([(1, [1.0, 2.0])], "app_id long, vector array<double>")
    with pytest.raises(ValueError, match="components"):
        IO.write_npz(v, f"{tmp_path}/v.npz", most=1)
    df = spark.createDataFrame([(float(x), x % 2, 1) for x in range(10)], "x double, y int, p int")
    got = {r["bin"]: (r["n"], r["precision"]) for r in K.classification_metrics(K.by_bins(df, "x", 2), "y", "p", ["bin"], least=5).collect()}
    assert got == {"Q1": (5, 0.4), "Q2": (5, 0.6)}


def test_text_vectors_of_a_catalogue(spark):
    from tidepool.functions.prompts import batch_encoder
    from tidepool.operators import catalog as C

    encode = batch_encoder(lambda: lambda texts: [[len(t), 3.0] if t else [0.0, 0.0] for t in texts], 2)
    df = spark.createDataFrame([(1, "abcdef", None), (2, "abcd", "x" * 9)], "i int, name string, story string")
    got = {r["i"]: r for r in C.with_text_vectors(df, ["name", "story"], encode, clip=4).collect()}
    assert got[1]["name_vector"] == got[2]["name_vector"] == got[2]["story_vector"] == [0.8, 0.6] and got[1]["story_vector"] == [0.0, 0.0]
    with pytest.raises(KeyError, match="none"):
        C.with_text_vectors(df, ["none"], encode)
