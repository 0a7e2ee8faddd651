"""Stores that outlive a run (index, accepted keys, kept scores), each with the same in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidepool.operators import cells
from tidepool.operators import classification as K
from tidepool.plans import explain
from tidepool.plans import shop as S
from tidepool.plans.shop import SHOP
from tidepool.plans.tables import events, table
from tidepool.sources.accepted import AcceptedKeys
from tidepool.sources.memo import ScoreMemo
from tidepool.sources.tables import column_names, read_parquet, scratch, write_single

Q, SQL = {}, {}
FEW = 16  # buckets: these tables are small


def query(sql: str | None = None):
    def put(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def _search(spark, d, probes):
    e = table(spark, d, "embeddings")
    path = scratch(spark, "index")
    n = cells.build_index(e, path, "vec_id", "embedding")
    q = e.select(F.col("vec_id").alias("query"), "vec_id", F.col("embedding").alias("vector"))
    found = cells.search_index(spark, path, q, "query", "vec_id", "embedding", 5, probes=probes or n)
    return found.select("query", "vec_id", F.round("score", 6).alias("score"), "rank")


@query("""WITH s AS (SELECT a.vec_id AS query, b.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 12) AS score FROM embeddings a, embeddings b WHERE a.vec_id <> b.vec_id)
SELECT query, vec_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id)::INT AS rank FROM s QUALIFY rank <= 5""")
def collection_search(spark, d):
    """The index with all cells probed: the exact search."""
    return _search(spark, d, None)


@query()
def collection_search_near(spark, d):
    """The index with eight cells probed for each query."""
    return _search(spark, d, 8)


@query("SELECT text, doc_id, (lang <> 'en')::INT + 1 AS chunk FROM documents QUALIFY row_number() OVER (PARTITION BY text ORDER BY lang <> 'en', doc_id) = 1")
def incremental_keep_first(spark, d):
    """Documents in two chunks, one after the other: the first row of each text, in the chunk that brought it."""
    docs, folder = table(spark, d, "documents"), scratch(spark, "accepted")
    first = AcceptedKeys(spark, folder, FEW).admit(docs.where("lang = 'en'"), "text", ["doc_id"])
    second = AcceptedKeys(spark, folder, FEW).admit(docs.where("lang <> 'en'"), "text", ["doc_id"])
    return first.select("text", "doc_id", F.lit(1).alias("chunk")).union(second.select("text", "doc_id", F.lit(2).alias("chunk")))


@query("SELECT user_id, json_extract_string(props, '$.k')::BIGINT AS k, round(avg(value), 6) AS score, CASE WHEN bool_or(event_type = 'click') THEN 1 ELSE 2 END AS run FROM events GROUP BY ALL")
def memoised_scores(spark, d):
    """Scores of user and item by all their events: those of clicks first, then all, of which only the rest is scored."""
    e, memo = events(spark, d), ScoreMemo(spark, scratch(spark, "memo"), ["user_id", "k"], FEW)

    def score(run):
        return lambda keys: e.join(keys, ["user_id", "k"]).groupBy("user_id", "k").agg(F.round(F.avg("value"), 6).alias("score")).withColumn("run", F.lit(run))

    memo.scores(e.where("event_type = 'click'"), score(1))
    return memo.scores(e, score(2)).select("user_id", "k", "score", "run")


@query(f"""WITH {SHOP}, c AS (SELECT pools.user, pools.item, 'It has ' || p_name || ', ' || p_type AS explanation FROM pools JOIN part ON p_partkey = pools.item WHERE method = 'raw' AND rank = 1)
SELECT c.user, item, explanation, CASE WHEN length(explanation) % 6 < 5 THEN 1 + length(explanation) % 5 END::INT AS judge_relevance, CASE WHEN length(explanation) % 6 < 5 THEN 1 + length(explanation) % 6 END::INT AS judge_faithfulness, 0::BIGINT AS asked_again FROM c""")
def explanation_job(spark, d):
    """Every customer's best item explained and judged by stand-ins; a second run asks for nothing."""
    part = table(spark, d, "part").select(F.col("p_partkey").alias("item"), F.concat_ws(", ", "p_name", "p_type").alias("candidate_text"), F.col("p_name"))
    best = S.pools(spark, d, methods=("raw",))["raw"].where("rank = 1").select("user", "item")
    own = S.queries(spark, d).select("user", "item").join(part, "item").select("user", F.concat(F.lit("likes "), "p_name").alias("query_text"))
    pairs = best.join(own, "user").join(part.drop("p_name"), "item")
    path = scratch(spark, "pairs")
    pairs.write.parquet(path)
    pairs = spark.read.parquet(path)
    folder, asked = scratch(spark, "explanations"), 0
    for _ in range(2):
        said, rated = (ScoreMemo(spark, f"{folder}/{n}", ["user", "item"], FEW) for n in ("said", "rated"))
        out = explain.judge(explain.explain(pairs, explain.echo_model, said), explain.length_judge, rated)
        asked = said.n_scored + rated.n_scored
    return out.select("user", "item", "explanation", "judge_relevance", "judge_faithfulness", F.lit(asked).cast("long").alias("asked_again"))


@query("SELECT o_orderkey, o_custkey::INT AS o_custkey, o_totalprice FROM orders")
def single_file(spark, d):
    """Chunks in one file with the first chunk's schema."""
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").cast("int").alias("o_custkey"), "o_totalprice")
    path = scratch(spark, "single")
    n = write_single([o.where("o_orderpriority < '3'"), o.where("o_orderpriority >= '3'").select("o_totalprice", F.col("o_custkey").cast("long").alias("o_custkey"), "o_orderkey")], path)
    back = spark.read.parquet(path)
    if len(back.inputFiles()) != 1 or n != back.count():
        raise ValueError("not one file")
    return back


@query("SELECT o_orderkey, o_custkey FROM orders")
def schema_probe(spark, d):
    """Only columns that a file has are asked for."""
    have = column_names(spark, f"{d}/orders.parquet")
    return read_parquet(spark, f"{d}/orders.parquet", [c for c in ("o_orderkey", "o_custkey", "o_nothing") if c in have])


_CM = "tp, fp, fn, tn, round((tp + tn) / n, 6) AS accuracy, round(CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END, 6) AS precision, round(CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END, 6) AS recall"
_CF = "count(*) AS n, count(*) FILTER (y = 1 AND p = 1) AS tp, count(*) FILTER (y = 0 AND p = 1) AS fp, count(*) FILTER (y = 1 AND p = 0) AS fn, count(*) FILTER (y = 0 AND p = 0) AS tn"
_CE = "e AS (SELECT o_custkey % 40 AS game, o_totalprice AS x, (o_orderstatus = 'F')::INT AS y, (o_orderkey % 3 = 0)::INT AS p FROM orders)"


def _classified(spark, d):
    o = table(spark, d, "orders")
    return o.select((F.col("o_custkey") % 40).alias("game"), F.col("o_totalprice").alias("x"), (F.col("o_orderstatus") == "F").cast("int").alias("y"), (F.col("o_orderkey") % 3 == 0).cast("int").alias("p"))


def _counts(df, by):
    return df.select(by, "n", "tp", "fp", "fn", "tn", *(F.round(c, 6).alias(c) for c in ("accuracy", "precision", "recall")))


@query(f"WITH {_CE}, c AS (SELECT game, {_CF} FROM e GROUP BY game HAVING count(*) >= 37) SELECT game, n, {_CM} FROM c")
def classifier_by_group(spark, d):
    return _counts(K.classification_metrics(_classified(spark, d), "y", "p", ["game"], least=37), "game")


@query(f"WITH {_CE}, q AS (SELECT quantile_cont(x, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]) AS k FROM e), b AS (SELECT 'Q' || (1 + len(list_filter(k[2:5], lambda z: x > z))) AS bin, y, p FROM e, q), c AS (SELECT bin, {_CF} FROM b GROUP BY bin HAVING count(*) >= 100) SELECT bin, n, {_CM} FROM c")
def classifier_by_bin(spark, d):
    df = K.by_bins(_classified(spark, d), "x", 5)
    return _counts(K.classification_metrics(df, "y", "p", ["bin"], least=100), "bin")
