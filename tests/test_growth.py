"""What keeps figures from growing faster than the input: one sort for a split, no repeated scans and joins, rows left out early."""

import pytest

import __spark_entry__ as entry
from tidepool.operators import metrics as M
from tidepool.operators import pooling as P
from tidepool.operators import splits as S
from tidepool.sources import tables as IO
from tidepool.sources.accepted import AcceptedKeys

DIR = "/root/testdata/sf0.001"


def nodes(df, name, plan="sparkPlan"):
    return sum(line.lstrip(" :+-*()0123456789").startswith(f"{name} ") for line in getattr(df._jdf.queryExecution(), plan)().toString().splitlines())


def test_a_support_aware_split_is_one_sort(spark):
    df = spark.createDataFrame([(i, i % 3, float(i)) for i in range(9)], "id long, user long, ts double")
    assert nodes(S.split_support_aware(df, "user", "ts", "id"), "Sort", "executedPlan") == 1


def test_chunks_of_a_single_file_are_made_by_many_tasks(spark, tmp_path):
    def task(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([TaskContext.get().partitionId()] * b.num_rows)], names=["id", "task"])

    chunks = [spark.range(100 * n, 100 * n + 100, 1, 4).mapInArrow(task, "id long, task long") for n in range(2)]
    assert IO.write_single(chunks, f"{tmp_path}/one") == 200
    back = spark.read.parquet(f"{tmp_path}/one")
    assert len(back.inputFiles()) == 1 and back.select("task").distinct().count() == 4
    ids = [r["id"] for r in back.collect()]
    assert sorted(ids) == list(range(200)) and max(ids[:100]) < 100


@pytest.mark.parametrize("name, most", [("cohort_files", 0), ("habit_query", 4)])
def test_few_joins(spark, name, most):
    assert nodes(entry.queries()[name](spark, DIR), "Join", "optimizedPlan") <= most


def test_history_out_of_reach_is_left_out(spark):
    h = spark.createDataFrame([(0, t) for t in (5, 15, 25, 35, 45)] + [(1, 35), (None, 35), (0, None)], "user long, ts long")
    q = spark.createDataFrame([(0, 38), (0, 31), (0, None)], "user long, ts long")
    assert sorted(tuple(r) for r in P.within_reach(h, q, "user", "ts", 10).collect()) == [(0, 25), (0, 35)]


def test_the_first_chunk_is_not_joined_to_filters(spark, tmp_path):
    keys = AcceptedKeys(spark, f"file://{tmp_path}/keys", 2)
    rows = lambda: keys._maybe(keys._hashed(spark.createDataFrame([("a",), ("b",)], "text string"), "text"))
    assert nodes(rows(), "Join", "optimizedPlan") == 0
    keys.admit(spark.createDataFrame([("a",)], "text string"), "text", ["text"])
    assert {(r["text"], r["__maybe"]) for r in rows().collect()} >= {("a", True)}


def test_lists_are_sorted_by_no_window_and_not_joined_with_themselves(spark):
    top = spark.createDataFrame([(m, q, (3 * q + j) % 7, j) for m in ("popularity", "raw") for q in range(4) for j in range(1, 4)], "method string, q long, i long, rank int")
    pos = spark.createDataFrame([(0, 2), (0, 3), (2, 99)], "q long, i long")
    items = spark.createDataFrame([(i, [1.0, float(i)], float(i)) for i in range(7)], "i long, vector array<double>, pop double")
    per = M.ranking_metrics(top, pos, "q", "i", 3, ["method"])
    assert nodes(per, "Window") == 0 and nodes(per, "Join", "optimizedPlan") == 1
    got = {(r["method"], r["q"]): r for r in per.collect()}
    assert sorted(got) == [("popularity", 0), ("popularity", 2), ("raw", 0), ("raw", 2)]
    assert got["raw", 0]["ap"] == pytest.approx((1 / 2 + 2 / 3) / 2) and got["raw", 0]["mrr"] == 0.5 and got["raw", 2]["ndcg"] == 0
    guards = M.personalization(top, items, "q", "i")
    assert nodes(guards, "Join", "optimizedPlan") <= 7
    lists = [[(3 * q + j) % 7 for j in range(1, 4)] for q in range(4)]
    far = [sum(1 - (1 + a * b) for n, a in enumerate(x) for b in x[n + 1 :]) / 3 for x in lists]
    assert all(r["ild"] == pytest.approx(sum(far) / 4) and r["gap_vs_reference"] == 0 and r["coverage"] == len({i for x in lists for i in x}) / 7 for r in guards.collect())


def test_queries_are_copied_for_what_a_task_holds_and_not_for_each_small_matrix(spark, monkeypatch):
    import numpy as np

    from tidepool.operators import pruned
    from tidepool.operators.retrieval import cosine_pool

    monkeypatch.setattr(pruned, "LEAF", 32)
    written, kept = {}, pruned._kept
    monkeypatch.setattr(pruned, "_kept", lambda df, name: written.setdefault(name, kept(df, name)) if name == "asks" else kept(df, name))
    x = np.random.default_rng(8).standard_normal((1200, 4))
    x /= np.linalg.norm(x, axis=1)[:, None]
    cat = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "i long, vector array<double>")
    q = cat.where("i < 150").selectExpr("i AS q", "i", "vector")
    got = {}
    for r in cosine_pool(q, cat, "q", "i", 5, cells=400).orderBy("rank").collect():  # matrices of a hundred items
        got.setdefault(r["q"], []).append(r["i"])
    s = np.round(x[:150] @ x.T, 12)
    s[np.arange(150), np.arange(150)] = -np.inf
    assert got == {k: np.lexsort((np.arange(1200), -s[k]))[:5].tolist() for k in range(150)}
    assert written["asks"].where("__s > 0").isEmpty()
