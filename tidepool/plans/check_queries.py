"""Queries of explanations, sources, cohorts, losses and reports, each with the same in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidepool.functions import vectors as V
from tidepool.functions.text import description
from tidepool.operators import catalog as C
from tidepool.operators import classification as K
from tidepool.operators import cohorts as H
from tidepool.operators import explanations as X
from tidepool.operators import metrics as M
from tidepool.operators import models
from tidepool.operators import pooling as P
from tidepool.operators import reviews as Rev
from tidepool.operators import splits as S
from tidepool.operators.reports import running_share
from tidepool.operators.windows import binned, quantile_edges
from tidepool.plans import evaluation as E
from tidepool.plans import shop
from tidepool.plans.shop import SHOP
from tidepool.plans.tables import EV, UNIFORM, events, table
from tidepool.sources import tables as IO

Q, SQL = {}, {}


def query(sql: str | None = None):
    def put(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def rounded(df, *cols, n=6):
    return df.select(*(F.round(F.col(c).cast("double"), n).alias(c) if c in cols else F.col(c) for c in df.columns))


def doubles(df, n=6):
    return rounded(df, *(f.name for f in df.schema if f.dataType.simpleString() == "double"), n=n)


# -- explanations ------------------------------------------------------------------------

_SC = """sc AS (SELECT vec_id AS example_id, vec_id % 10 = 0 AS is_degenerate, (vec_id % 8) / 8.0::DOUBLE AS content_overlap_ratio, CASE WHEN vec_id % 3 = 0 THEN ['cozy'] ELSE []::VARCHAR[] END AS ungrounded_tags,
  list_cosine_similarity(embedding[1:32]::DOUBLE[], embedding[33:64]::DOUBLE[]) AS relevance_cosine, list_cosine_similarity(embedding[1:16]::DOUBLE[], embedding[17:32]::DOUBLE[]) AS relevance_cosine_query_game,
  (1 + vec_id % 5)::INT AS human_faithfulness, (1 + vec_id % 4)::INT AS human_relevance, (1 + (vec_id // 2) % 5)::INT AS judge_faithfulness, (1 + (vec_id * 3) % 4)::INT AS judge_relevance FROM embeddings)"""


def _scored(spark, d):
    e, i = table(spark, d, "embeddings"), F.col("vec_id")
    part = lambda a, n: F.slice("embedding", a, n)
    tags = F.when(i % 3 == 0, F.array(F.lit("cozy"))).otherwise(F.array().cast("array<string>"))
    return e.select(
        i.alias("example_id"), (i % 10 == 0).alias("is_degenerate"), ((i % 8) / 8.0).alias("content_overlap_ratio"), tags.alias("ungrounded_tags"),
        V.cosine(part(1, 32), part(33, 32)).alias("relevance_cosine"), V.cosine(part(1, 16), part(17, 16)).alias("relevance_cosine_query_game"),
        (1 + i % 5).cast("int").alias("human_faithfulness"), (1 + i % 4).cast("int").alias("human_relevance"),
        (1 + F.floor(i / 2) % 5).cast("int").alias("judge_faithfulness"), (1 + (i * 3) % 4).cast("int").alias("judge_relevance"),
    )


_MM = lambda cols: ", ".join(f"round(avg({c}), 6)::DOUBLE AS {c}_mean, round(median({c}), 6)::DOUBLE AS {c}_median" for c in cols)


@query(f"WITH {_SC} SELECT count(*) AS n_examples, round(avg(is_degenerate::INT), 6) AS degenerate_rate, round(avg((len(ungrounded_tags) > 0)::INT), 6) AS any_ungrounded_tag_rate, {_MM(X.PROXIES)} FROM sc")
def explanation_summary(spark, d):
    return doubles(X.summarize_explanations(_scored(spark, d)))


@query(f"WITH {_SC} SELECT count(*) AS n_examples, {_MM(X.JUDGED)} FROM sc")
def judge_summary(spark, d):
    return doubles(X.summarize_judge(_scored(spark, d)))


_RK = lambda c: f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0::DOUBLE"
_RANKED = ("human_faithfulness", "human_relevance", *X.JUDGED, *X.PROXIES)


@query(f"""WITH {_SC}, r AS (SELECT *, {', '.join(f'{_RK(c)} AS r_{c}' for c in _RANKED)} FROM sc WHERE example_id % 4 = 0)
SELECT count(*) AS n_examples, round(avg((human_faithfulness = judge_faithfulness)::INT), 6) AS judge_faithfulness_exact_agreement_rate, round(avg((abs(human_faithfulness - judge_faithfulness) <= 1)::INT), 6) AS judge_faithfulness_within_1_rate,
round(avg((human_relevance = judge_relevance)::INT), 6) AS judge_relevance_exact_agreement_rate, round(avg((abs(human_relevance - judge_relevance) <= 1)::INT), 6) AS judge_relevance_within_1_rate,
round(corr(r_human_faithfulness, r_judge_faithfulness), 6) AS judge_faithfulness_spearman, CASE WHEN count(DISTINCT human_relevance) > 1 THEN round(corr(r_human_relevance, r_judge_relevance), 6) END AS judge_relevance_spearman, round(corr(r_human_faithfulness, r_content_overlap_ratio), 6) AS heuristic_groundedness_spearman,
CASE WHEN count(DISTINCT human_relevance) > 1 THEN round(corr(r_human_relevance, r_relevance_cosine), 6) END AS heuristic_relevance_vs_review_spearman, CASE WHEN count(DISTINCT human_relevance) > 1 THEN round(corr(r_human_relevance, r_relevance_cosine_query_game), 6) END AS heuristic_relevance_vs_query_game_spearman FROM r""")
def calibration_summary(spark, d):
    """Every fourth example is labelled by hand; one of its labels is then constant."""
    s = _scored(spark, d)
    labels = s.where("example_id % 4 = 0").select("example_id", "human_faithfulness", "human_relevance")
    return doubles(X.summarize_calibration(X.calibration(labels, s, s)))


# -- sources: written to a scratch folder and read back ----------------------------------------


@query("SELECT o_orderkey, o_custkey, o_orderpriority, o_totalprice FROM orders")
def csv_round_trip(spark, d):
    path = IO.scratch(spark, "csv")
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_totalprice")
    o.write.csv(path, header=True)
    return IO.read_csv(spark, path, o.schema, ["o_orderkey", "o_custkey", "o_orderpriority", "o_totalprice"], multiline=False)


@query("SELECT doc_id, text FROM documents")
def csv_texts(spark, d):
    """Texts with line ends and quotes through a CSV file."""
    path = IO.scratch(spark, "texts")
    docs = table(spark, d, "documents").select("doc_id", "text")
    docs.write.csv(path, header=True, escape='"', quoteAll=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, lineSep="\n")
    return IO.read_csv(spark, path, docs.schema, multiline=True)


@query("SELECT p_partkey, p_brand || '|' || p_type AS parts, p_size FROM part")
def csv_sink(spark, d):
    """A result with an array column, written as JSON in one CSV part."""
    path = IO.scratch(spark, "sink")
    IO.write_csv(table(spark, d, "part").select("p_partkey", F.array("p_brand", "p_type").alias("parts"), "p_size"), path)
    back = spark.read.csv(path, header=True, escape='"', schema="p_partkey long, parts string, p_size int")
    return back.withColumn("parts", F.array_join(F.from_json("parts", "array<string>"), "|"))


@query("SELECT 'flat' AS method, vec_id, label::BIGINT AS label FROM embeddings WHERE vec_id % 2 = 0")
def jsonl_round_trip(spark, d):
    path = IO.scratch(spark, "jsonl")
    e = table(spark, d, "embeddings").select(F.when(F.col("vec_id") % 2 == 0, "flat").otherwise("other").alias("method"), "vec_id", F.col("label").cast("long").alias("label"))
    IO.write_jsonl(e, path)
    return IO.read_jsonl(spark, path, e.schema, "flat")


@query("SELECT CASE WHEN event_id % 10 < 7 THEN 'train' WHEN event_id % 10 < 9 THEN 'val' ELSE 'test' END AS split, count(*) AS n, sum(event_id)::BIGINT AS ids FROM events GROUP BY 1")
def split_files(spark, d):
    """One folder per split; the split is read back from the folders' names."""
    path, i = IO.scratch(spark, "splits"), F.col("event_id") % 10
    IO.write_splits(table(spark, d, "events").select("event_id", F.when(i < 7, "train").when(i < 9, "val").otherwise("test").alias("split")), path)
    return IO.read_parquet(spark, path, ["split", "event_id"]).groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids"))


@query("SELECT vec_id || '::flat' AS id, label::BIGINT AS label, round(embedding[1]::DOUBLE, 6) AS first FROM embeddings WHERE label = 3")
def vector_collection(spark, d):
    path = IO.scratch(spark, "vectors")
    e = table(spark, d, "embeddings").select(IO.pooled_id(F.col("vec_id"), "flat").alias("id"), F.col("label").cast("long").alias("label"), F.col("embedding").alias("vector"))
    IO.write_vectors(e, path, "id")
    return IO.read_vectors(spark, path, {"label": 3}).select("id", "label", F.round(F.element_at("vector", 1).cast("double"), 6).alias("first"))


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey")
def cached_table(spark, d):
    """A table that is made once and read from then on."""
    path = IO.scratch(spark, "cached")
    made = lambda: table(spark, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    IO.cached(spark, path, made, exists=lambda p: False)
    return IO.cached(spark, path, lambda: 1 / 0, exists=lambda p: True)


@query("SELECT e.event_id, e.user_id::VARCHAR AS user_id, floor(epoch(ts))::DOUBLE AS ts, event_type FROM events e WHERE length(event_type) >= 5 AND json_extract_string(props, '$.k')::BIGINT IN (SELECT label FROM embeddings)")
def split_load(spark, d):
    """Rows for evaluation: known items, texts of some length, user ids as strings."""
    items = table(spark, d, "embeddings").select(F.col("label").cast("long").alias("k")).distinct()
    e = events(spark, d).select("event_id", "user_id", "ts", "event_type", "k")
    got = IO.load_split(e, items, user="user_id", item="k", text="event_type", ts="ts", least=5)
    return got.select("event_id", "user_id", "ts", "event_type")


@query("SELECT p_partkey, p_name FROM part WHERE length(trim(p_name)) >= 12")
def long_names(spark, d):
    return IO.text_ok(table(spark, d, "part"), "p_name", 12).select("p_partkey", "p_name")


@query("""WITH m AS (SELECT source AS method, count(*) AS n, round(avg(n_chars), 4) AS chars FROM documents GROUP BY source), e AS (SELECT DISTINCT source AS method, 'run of ' || source AS name FROM documents UNION ALL SELECT 'lost', 'run of lost')
SELECT e.method, name, n, chars, CASE WHEN n IS NULL THEN 'no metrics for method ' || e.method END AS join_note FROM e LEFT JOIN m USING (method)""")
def experiment_registry(spark, d):
    """A manifest of runs, one for each source and one without metrics, with the metrics of their method."""
    docs = table(spark, d, "documents")
    metrics = docs.groupBy(F.col("source").alias("method")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("n_chars"), 4).alias("chars"))
    names = [r["source"] for r in docs.select("source").distinct().collect()]  # a few sources
    runs = [{"method": m, "name": f"run of {m}"} for m in [*names, "lost"]]
    return IO.registry(spark, runs, metrics).select("method", "name", "n", "chars", "join_note")


# -- catalogue and pooling -----------------------------------------------------------------------


@query("""WITH l AS (SELECT label::BIGINT AS item, unnest(range(1, len(embedding) + 1)) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings), m AS (SELECT item, i, avg(x) AS x FROM l GROUP BY item, i), n AS (SELECT item, sqrt(sum(x * x)) AS n FROM m GROUP BY item),
p AS (SELECT item, i, x / n AS x FROM m JOIN n USING (item)), b AS (SELECT p.item, p.i, 0.75 * p.x + 0.25 * q.x AS x FROM p JOIN p q ON q.item = (p.item + 1) % 10 AND q.i = p.i WHERE p.item % 2 = 0), bn AS (SELECT item, sqrt(sum(x * x)) AS n FROM b GROUP BY item)
SELECT item, i::INT AS i, round(x / n, 6) AS x, 0.25::DOUBLE AS blend_weight FROM b JOIN bn USING (item)""")
def description_blend(spark, d):
    """Pooled vectors of even items with the next item's as description; items without one are left out."""
    e = table(spark, d, "embeddings").withColumn("item", F.col("label").cast("long"))
    pooled = P.pool_vectors(e, ["item"], "embedding")
    next_ = pooled.select(((F.col("item") + 9) % 10).alias("item"), F.col("vector").alias("description")).where("item % 2 = 0")
    b = P.blend_descriptions(pooled, next_, "item", 0.25)
    return b.select("item", F.posexplode("vector").alias("i", "x"), "blend_weight").select("item", (F.col("i") + 1).alias("i"), F.round("x", 6).alias("x"), "blend_weight")


@query("SELECT vec_id, round(list_avg([embedding[1], embedding[3], embedding[5]]::DOUBLE[]), 6) AS x, round(list_avg([embedding[2], embedding[4], embedding[6]]::DOUBLE[]), 6) AS y FROM embeddings WHERE vec_id % 3 <> 0 UNION ALL SELECT vec_id, NULL, NULL FROM embeddings WHERE vec_id % 3 = 0")
def entity_mean(spark, d):
    """The mean of a list of vectors; an empty list has none."""
    e = table(spark, d, "embeddings")
    lists = F.when(F.col("vec_id") % 3 != 0, F.array(*(F.slice("embedding", k, 2) for k in (1, 3, 5)))).otherwise(F.array().cast("array<array<float>>"))
    m = e.select("vec_id", lists.alias("v")).withColumn("m", V.mean_vector(F.col("v")))
    return m.select("vec_id", F.round(F.get("m", F.lit(0)), 6).alias("x"), F.round(F.get("m", F.lit(1)), 6).alias("y"))


@query("SELECT p_partkey, p_brand FROM part WHERE p_partkey % 5 = 0")
def required_ids(spark, d):
    part = table(spark, d, "part")
    return C.require_ids(part, part.where("p_partkey % 5 = 0").select("p_partkey"), "p_partkey").select("p_partkey", "p_brand")


@query("SELECT p_partkey, trim(p_name) || chr(10) || chr(10) || trim(p_type) AS text FROM part WHERE p_size % 2 = 0 UNION ALL SELECT p_partkey, trim(p_name) FROM part WHERE p_size % 2 = 1")
def query_with_description(spark, d):
    """A query's text with its item's description behind it, where there is one."""
    part = table(spark, d, "part")
    return part.select("p_partkey", description(F.col("p_name"), F.when(F.col("p_size") % 2 == 0, F.col("p_type"))).alias("text"))


# -- cohorts -------------------------------------------------------------------------------------


@query(f"WITH {SHOP}, s AS (SELECT ex.user, CASE WHEN n_eval_targets >= 2 THEN 'slice_a_multi_target' WHEN n_eval_targets = 1 THEN 'slice_b_single_target' ELSE 'slice_c_zero_target' END AS slice, CASE WHEN n_support <= 0 THEN '0' WHEN n_support = 1 THEN '1' WHEN n_support <= 3 THEN '2-3' WHEN n_support <= 7 THEN '4-7' ELSE '8+' END AS bucket FROM ex JOIN pos ON pos.user = ex.user) SELECT slice, bucket, count(*) AS n_examples, count(DISTINCT s.user) AS n_users FROM s GROUP BY slice, bucket")
def cohort_summary(spark, d):
    ex = shop.examples(spark, d).join(shop.positives(spark, d).select("user"), "user")
    return H.cohort_summary(ex.withColumns({"slice": M.slice_name(F.col("n_eval_targets")), "bucket": M.support_bucket(F.col("n_support"))}), "user")


@query("SELECT e.event_id, 'said ' || (user_id * 1000 + json_extract_string(props, '$.k')::BIGINT)::VARCHAR AS query_text FROM events e")
def query_texts(spark, d):
    e = events(spark, d)
    texts = e.select("user_id", "k", F.concat(F.lit("said "), (F.col("user_id") * 1000 + F.col("k")).cast("string")).alias("query_text")).distinct()
    return H.with_lookup(e, texts, ["user_id", "k"]).select("event_id", "query_text")


@query(f"WITH {SHOP}, w AS (SELECT pos.user, '[' || string_agg(item, ',' ORDER BY item) || ']' AS ids, count(*) AS n FROM pos GROUP BY ALL) SELECT w.user, ids AS validation_positive_app_ids_json, n FROM w")
def cohort_files(spark, d):
    """Positives as JSON for files, and read back."""
    bought = shop.split(spark, d).where("is_positive")
    js = H.cohort_json(bought.groupBy("user").agg(F.array_sort(F.collect_set("item")).alias("positives")), "user")
    back = H.cohort_from_json(js.withColumn("text", F.col("validation_positive_app_ids_json")))
    return back.select("user", F.col("text").alias("validation_positive_app_ids_json"), F.size("positives").cast("long").alias("n"))


@query(f"SELECT event_id, row_number() OVER (ORDER BY {UNIFORM}, event_id) - 1 AS ex_idx FROM (SELECT event_id, md5('2026|subsample|' || event_id) AS m FROM events) ORDER BY 2 LIMIT 50")
def frozen_subsample(spark, d):
    """A cohort cut to 50 rows with new indices."""
    return H.reindexed(events(spark, d).select("event_id"), 50, "event_id").select("event_id", F.col("ex_idx").cast("long").alias("ex_idx"))


@query("""SELECT event_type AS what, CASE WHEN bool_or(event_id < 3) THEN 'overlap' ELSE 'disjoint' END AS outcome FROM events GROUP BY event_type
UNION ALL SELECT n_name, CASE WHEN n_nationkey / 20.0 + n_regionkey / 5.0 >= 1 THEN 'sizes' ELSE 'kept' END FROM nation
UNION ALL SELECT 'mode ' || r_name, CASE WHEN r_regionkey < 3 THEN 'unknown mode' ELSE 'known mode' END FROM region""")
def guards(spark, d):
    """Checks that raise, each over a table's rows: cohorts that share a key, sizes of splits, names of support modes."""
    e, out = events(spark, d).select("event_id", "event_type", "user_id", "k", "flag"), []

    def tried(what, right, wrong, run):
        try:
            run()
            out.append((what, right))
        except ValueError:
            out.append((what, wrong))

    for r in e.select("event_type").distinct().collect():  # a few types
        mine = e.where(F.col("event_type") == r["event_type"])
        tried(r["event_type"], "disjoint", "overlap", lambda mine=mine: H.require_disjoint(mine, e.where("event_id < 3"), ["event_id"]))
    for r in table(spark, d, "nation").collect():  # 25 nations
        tried(r["n_name"], "kept", "sizes", lambda r=r: S.check_sizes(r["n_nationkey"] / 20, r["n_regionkey"] / 5))
    ex = e.withColumn("positives", F.array("k"))
    for r in table(spark, d, "region").collect():  # 5 regions
        mode = ("query_only", "strict")[r["r_regionkey"] % 2] if r["r_regionkey"] >= 3 else r["r_name"]
        tried(f"mode {r['r_name']}", "known mode", "unknown mode", lambda mode=mode: H.support_rows(ex, e, "event_id", "user_id", "k", "flag", mode))
    return spark.createDataFrame(out, "what string, outcome string")


@query(f"WITH {EV} SELECT max(ts) FILTER (event_id % 10 < 7) AS latest FROM ev")
def train_reference(spark, d):
    e = events(spark, d).withColumn("split", F.when(F.col("event_id") % 10 < 7, "train").otherwise("val"))
    return spark.createDataFrame([(Rev.max_train_timestamp(e, "ts"),)], "latest long")


# -- losses and models ---------------------------------------------------------------------------

_Z = "z AS (SELECT user_id AS g, event_id AS i, value / 50.0::DOUBLE AS s, (value >= 30)::INT AS p FROM events WHERE value IS NOT NULL)"


@query(f"WITH {_Z}, l AS (SELECT g, s - max(s) OVER w - ln(sum(exp(s - m)) OVER w) AS lp, p, sum(p) OVER w AS n FROM (SELECT *, max(s) OVER (PARTITION BY g) AS m FROM z) WINDOW w AS (PARTITION BY g)) SELECT g, round(-sum(p / n::DOUBLE * lp), 6) AS loss FROM l WHERE n > 0 GROUP BY g")
def listwise_loss(spark, d):
    """Softmax cross-entropy of each group against the uniform distribution over its positives."""
    e = table(spark, d, "events").where("value IS NOT NULL").select(F.col("user_id").alias("g"), (F.col("value") / 50.0).alias("s"), (F.col("value") >= 30).cast("int").alias("p"))
    return rounded(models.group_cross_entropy(e, "g", "s", "p").where("loss IS NOT NULL"), "loss")


@query(f"""WITH {_Z}, c AS (SELECT g % 50 AS q, i % 40 AS k, avg(s) AS s, ((g % 50 + i % 40) % 7 = 0)::INT AS p FROM z GROUP BY ALL),
a AS (SELECT q, ln(sum(exp(s / 0.1))) - ln(sum(exp(s / 0.1)) FILTER (p = 1)) AS l FROM c GROUP BY q HAVING sum(p) > 0), b AS (SELECT k, ln(sum(exp(s / 0.1))) - ln(sum(exp(s / 0.1)) FILTER (p = 1)) AS l FROM c GROUP BY k HAVING sum(p) > 0)
SELECT round(((SELECT avg(l) FROM a) + (SELECT avg(l) FROM b)) / 2, 6) AS loss""")
def contrastive_loss(spark, d):
    e = table(spark, d, "events").where("value IS NOT NULL").select((F.col("user_id") % 50).alias("q"), (F.col("event_id") % 40).alias("k"), (F.col("value") / 50.0).alias("s"))
    c = e.groupBy("q", "k").agg(F.avg("s").alias("s")).withColumn("p", ((F.col("q") + F.col("k")) % 7 == 0).cast("int"))
    return rounded(models.contrastive_loss(c, "q", "k", "s", "p", 0.1), "loss")


@query("SELECT 'l_extendedprice' AS feature, round(regr_slope(l_tax, l_extendedprice) * 1e6, 3) AS slope, round(regr_intercept(l_tax, l_extendedprice), 6) AS intercept FROM lineitem")
def linear_model(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_extendedprice").alias("x"), F.col("l_tax").alias("y"))
    two = spark.createDataFrame([(0.0,), (1e6,)], "x double")
    p = [r["prediction"] for r in models.predicted(models.fit_linear(li, ["x"], "y"), two, ["x"]).orderBy("x").collect()]
    return spark.createDataFrame([("l_extendedprice", round(p[1] - p[0], 3), round(p[0], 6))], "feature string, slope double, intercept double")


# -- metrics by group and bin, choice of a method, histories ---------------------------------------

_E = "e AS (SELECT o_custkey % 40 AS game, o_totalprice AS y, (200000.0::DOUBLE + o_custkey % 100) AS p FROM orders)"
_MET = "count(*) AS n, round(avg(abs(p - y)), 4) AS mae, round(sqrt(avg((p - y) * (p - y))), 4) AS rmse"


@query(f"WITH {_E} SELECT game, {_MET} FROM e GROUP BY game HAVING count(*) >= 380")
def metrics_by_group(spark, d):
    o = table(spark, d, "orders").select((F.col("o_custkey") % 40).alias("game"), F.col("o_totalprice").alias("y"), (F.lit(200000.0) + F.col("o_custkey") % 100).alias("p"))
    return K.regression_metrics(o, "y", "p", ["game"], least=380).select("game", "n", F.round("mae", 4).alias("mae"), F.round("rmse", 4).alias("rmse"))


@query(f"WITH {_E}, q AS (SELECT quantile_cont(y, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]) AS k FROM e) SELECT 'Q' || (1 + len(list_filter(k[2:5], lambda z: y > z))) AS bin, {_MET} FROM e, q GROUP BY 1 HAVING count(*) >= 100")
def metrics_by_bin(spark, d):
    o = table(spark, d, "orders").select(F.col("o_totalprice").alias("y"), (F.lit(200000.0) + F.col("o_custkey") % 100).alias("p"))
    o = o.withColumn("bin", binned(F.col("y"), quantile_edges(o, "y", 5), [f"Q{i}" for i in range(1, 6)]))
    return K.regression_metrics(o, "y", "p", ["bin"]).where("n >= 100").select("bin", "n", F.round("mae", 4).alias("mae"), F.round("rmse", 4).alias("rmse"))


@query("SELECT l_returnflag AS method, round(avg(l_quantity), 6) AS ndcg, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY avg(l_quantity) DESC, 1 LIMIT 1")
def chosen_method(spark, d):
    m = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("method")).agg(F.avg("l_quantity").alias("ndcg"), F.count(F.lit(1)).alias("n"))
    return rounded(M.best_method(m, [F.col("ndcg").desc(), F.col("method")]), "ndcg")


@query("SELECT 'first' AS run, '2024-01-01' AS run_ts, o_orderpriority AS method, count(*) AS n, NULL::DOUBLE AS ndcg FROM orders GROUP BY 3 UNION ALL SELECT 'second', '2024-02-01', l_returnflag, count(*), round(avg(l_quantity), 6) FROM lineitem GROUP BY 3")
def run_history(spark, d):
    a = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("method")).agg(F.count(F.lit(1)).alias("n"))
    b = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("method")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("l_quantity"), 6).alias("ndcg"))
    return E.run_history({"second": b, "first": a}, {"first": "2024-01-01", "second": "2024-02-01"}).select("run", F.date_format("run_ts", "yyyy-MM-dd").alias("run_ts"), "method", "n", "ndcg")


@query("SELECT a, b, round(avg((o_custkey % a) * b), 6) AS m FROM orders, (VALUES (2), (3)) x(a), (VALUES (10), (20)) y(b) GROUP BY a, b")
def parameter_grid(spark, d):
    o = table(spark, d, "orders")
    return rounded(models.grid_search({"a": [2, 3], "b": [10, 20]}, lambda a, b: o.agg(F.avg((F.col("o_custkey") % a) * b).alias("m"))), "m").select("a", "b", "m")


@query("WITH c AS (SELECT c_mktsegment AS segment, count(*) AS n FROM customer GROUP BY 1) SELECT segment, n, round(n / sum(n) OVER (), 6) AS share, round(sum(n) OVER (ORDER BY segment) / sum(n) OVER (), 6) AS running FROM c")
def segment_shares(spark, d):
    c = table(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("segment")).agg(F.count(F.lit(1)).alias("n"))
    return rounded(running_share(c, F.col("segment")), "share", "running")
