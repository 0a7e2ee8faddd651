"""Queries over vectors, retrieval, ranking and evaluation, each with the same in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidepool.functions import vectors as V
from tidepool.operators import classification as K
from tidepool.operators import metrics as M
from tidepool.operators import pooling as P
from tidepool.operators import ranking as R
from tidepool.operators import retrieval as T
from tidepool.operators.windows import deciles, ranked
from tidepool.plans.tables import CATALOG, EV, catalog, events, table

Q, SQL = {}, {}


def query(sql: str | None = None):
    def put(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def rounded(df, *cols, n=6):
    return df.select(*(F.round(c, n).alias(c) if c in cols else F.col(c) for c in df.columns))


def queries_of(spark, d):
    e = table(spark, d, "embeddings")
    return e.select("vec_id", F.col("label").cast("long").alias("item"), F.col("embedding").alias("vector"))


def items_of(spark, d):
    cat = catalog(spark, d)
    lab = table(spark, d, "labels").select(F.pmod("doc_id", F.lit(10)).alias("item"))
    return T.popularity(lab, cat, "item")


def pool_of(spark, d, k=8):
    pool = T.cosine_pool(queries_of(spark, d), catalog(spark, d), "vec_id", "item", k)
    return pool.join(items_of(spark, d).select("item", "pop"), "item")


def positives_of(spark, d):
    pairs = queries_of(spark, d).select("vec_id", F.col("item").alias("own"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(9).cast("long"))).alias("item"))
    return pairs.where("item <> own AND (vec_id * 7 + item * 13) % 5 = 0").select("vec_id", "item")


POS = "pos AS (SELECT vec_id, i::BIGINT AS item FROM embeddings, range(10) r(i) WHERE i <> label AND (vec_id * 7 + i * 13) % 5 = 0)"
_MM = lambda x, k="vec_id": f"CASE WHEN max({x}) OVER (PARTITION BY {k}) - min({x}) OVER (PARTITION BY {k}) <= 1e-12 THEN 0.0 ELSE ({x} - min({x}) OVER (PARTITION BY {k})) / (max({x}) OVER (PARTITION BY {k}) - min({x}) OVER (PARTITION BY {k})) END"
_D1 = f"(0.2 * {_MM('score')} + 0.8 * {_MM('ln(1 + pop)')})"


# -- vectors -----------------------------------------------------------------------


@query("SELECT vec_id, round(sqrt(sum(x * x)), 6) AS norm FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY vec_id")
def vector_norm(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.round(V.norm(F.col("embedding")), 6).alias("norm"))


@query(f"WITH {CATALOG} SELECT item, i::INT AS i, round(x, 6) AS x FROM cat")
def mean_pool(spark, d):
    return catalog(spark, d).select("item", F.posexplode("vector").alias("i", "x")).select("item", (F.col("i") + 1).alias("i"), F.round("x", 6).alias("x"))


_W = """WITH r AS (SELECT label::BIGINT AS item, vec_id, (vec_id % 3 <> 0)::INT AS flag, ln(1 + (vec_id % 7)::DOUBLE) AS w, embedding FROM embeddings {0}),
l AS (SELECT item, w, unnest(range(1, len(embedding) + 1)) AS i, unnest(embedding)::DOUBLE AS x FROM r),
m AS (SELECT item, i, {1} AS x FROM l GROUP BY item, i), n AS (SELECT item, sqrt(sum(x * x)) AS n FROM m GROUP BY item),
s AS (SELECT item, count(*) AS n_reviews_pooled, avg(flag) AS recommended_rate FROM r GROUP BY item)
SELECT item, i::INT AS i, round(x / n, 6) AS x, n_reviews_pooled, round(recommended_rate, 6) AS recommended_rate FROM m JOIN n USING (item) JOIN s USING (item)"""


def _pooled(spark, d, variant):
    e = table(spark, d, "embeddings").select(F.col("label").cast("long").alias("item"), "embedding", (F.col("vec_id") % 7).alias("votes"), (F.col("vec_id") % 3 != 0).cast("int").alias("flag"))
    p = P.pool_reviews(e, "item", "embedding", "votes", "flag", variant)
    return p.select("item", F.posexplode("vector").alias("i", "x"), "n_reviews_pooled", F.round("recommended_rate", 6).alias("recommended_rate")).select("item", (F.col("i") + 1).alias("i"), F.round("x", 6).alias("x"), "n_reviews_pooled", "recommended_rate")


@query(_W.format("", "sum(w * x) / sum(w)"))
def pool_log_weighted(spark, d):
    return _pooled(spark, d, "log_weighted")


@query(_W.format("WHERE vec_id % 3 <> 0", "avg(x)"))
def pool_recommended(spark, d):
    return _pooled(spark, d, "recommended_only")


@query(_W.format("WHERE vec_id % 3 <> 0", "sum(w * x) / sum(w)"))
def pool_recommended_log_weighted(spark, d):
    return _pooled(spark, d, "recommended_log_weighted")


@query("""WITH r AS (SELECT label::BIGINT AS item, exp(-vec_id::DOUBLE / 100.0) AS w, unnest(range(1, len(embedding) + 1)) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings),
m AS (SELECT item, i, sum(w * x) / sum(w) AS x FROM r GROUP BY item, i), n AS (SELECT item, sqrt(sum(x * x)) AS n FROM m GROUP BY item) SELECT item, i::INT AS i, round(x / n, 6) AS x FROM m JOIN n USING (item)""")
def pool_time_decayed(spark, d):
    e = table(spark, d, "embeddings").withColumn("item", F.col("label").cast("long"))
    p = P.time_decayed(e, ["item"], "embedding", F.col("vec_id"), 100.0)
    return p.select("item", F.posexplode("vector").alias("i", "x")).select("item", (F.col("i") + 1).alias("i"), F.round("x", 6).alias("x"))


@query(f"""WITH {CATALOG}, b AS (SELECT d.vec_id, d.i, 0.7 * d.x + 0.3 * c.x AS x FROM dims d JOIN cat c ON c.item = d.item AND c.i = d.i), n AS (SELECT vec_id, sqrt(sum(x * x)) AS n FROM b GROUP BY vec_id)
SELECT vec_id, i::INT AS i, round(x / n, 6) AS x FROM b JOIN n USING (vec_id)""")
def vector_blend(spark, d):
    q = queries_of(spark, d).join(catalog(spark, d).withColumnRenamed("vector", "description"), "item")
    b = q.select("vec_id", F.posexplode(V.blend(F.col("vector"), F.col("description"), 0.3)).alias("i", "x"))
    return b.select("vec_id", (F.col("i") + 1).alias("i"), F.round("x", 6).alias("x"))


@query(f"""WITH {CATALOG}, h AS (SELECT vec_id, item, score FROM scores WHERE score >= 0.0 QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, item) <= 3),
p AS (SELECT vec_id, c.i, sum(greatest(score, 0) * c.x) / sum(greatest(score, 0)) AS x FROM h JOIN cat c USING (item) GROUP BY vec_id, c.i), pn AS (SELECT vec_id, sqrt(sum(x * x)) AS n FROM p GROUP BY vec_id),
b AS (SELECT d.vec_id, d.i, CASE WHEN pn.n IS NULL THEN d.x ELSE 0.6 * d.x + 0.4 * p.x / pn.n END AS x FROM dims d LEFT JOIN p USING (vec_id, i) LEFT JOIN pn ON pn.vec_id = d.vec_id),
n AS (SELECT vec_id, sqrt(sum(x * x)) AS n FROM b GROUP BY vec_id) SELECT vec_id, round(max(x / n), 5) AS top FROM b JOIN n USING (vec_id) GROUP BY vec_id""")
def history_blend(spark, d):
    q = queries_of(spark, d).select("vec_id", "vector", F.col("item").alias("own"))
    cat = catalog(spark, d).select("item", F.col("vector").alias("item_vector"))
    hist = T.cosine_pairs(q.withColumnRenamed("own", "item"), catalog(spark, d), "vec_id", "item").select("vec_id", "item").join(cat, "item")
    b = P.history_blend(q.select("vec_id", "vector"), hist, "vec_id", 0.4, 0.0, 3)
    return b.select("vec_id", F.round(F.array_max(V.unit(F.col("vector"))), 5).alias("top"))


@query(f"""WITH {CATALOG}, h AS (SELECT vec_id, item FROM pool WHERE rank <= 2), p AS (SELECT vec_id, i, avg(x) AS x FROM h JOIN cat USING (item) GROUP BY vec_id, i),
b AS (SELECT vec_id, i, d.x + p.x AS x FROM dims d JOIN p USING (vec_id, i)), n AS (SELECT vec_id, sqrt(sum(x * x)) AS n FROM b GROUP BY vec_id) SELECT vec_id, round(max(x / n), 5) AS top FROM b JOIN n USING (vec_id) GROUP BY vec_id""")
def fused_query(spark, d):
    q = queries_of(spark, d).select("vec_id", "vector")
    support = pool_of(spark, d, 2).select("vec_id", "item")
    b = P.fused_query(q, support, catalog(spark, d), "vec_id", "item")
    return b.select("vec_id", F.round(F.array_max("vector"), 5).alias("top"))


@query("SELECT lang, source, round(list_sum(list_transform(range(1, 4), lambda i: i)) * 0.0 + len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b)))::DOUBLE, 6) AS jaccard FROM (SELECT x.lang, y.source, x.s AS a, y.s AS b FROM (SELECT lang, list(DISTINCT n_chars % 50) AS s FROM documents GROUP BY lang) x, (SELECT source, list(DISTINCT n_chars % 50) AS s FROM documents GROUP BY source) y)")
def set_jaccard(spark, d):
    doc = table(spark, d, "documents").withColumn("v", F.col("n_chars") % 50)
    a = doc.groupBy("lang").agg(F.collect_set("v").alias("a"))
    b = doc.groupBy("source").agg(F.collect_set("v").alias("b"))
    return a.join(F.broadcast(b), F.lit(True)).select("lang", "source", F.round(V.jaccard(F.col("a"), F.col("b")), 6).alias("jaccard"))


# -- retrieval -----------------------------------------------------------------------


@query(f"WITH {CATALOG} SELECT item, pop FROM pop")
def popularity(spark, d):
    return items_of(spark, d).select("item", "pop")


@query(f"WITH {CATALOG} SELECT vec_id, item, round(score, 6) AS score FROM scores")
def cosine_scores(spark, d):
    return rounded(T.cosine_pairs(queries_of(spark, d), catalog(spark, d), "vec_id", "item"), "score")


@query(f"WITH {CATALOG} SELECT vec_id, item, round(score, 6) AS score, rank::INT AS rank FROM pool")
def retrieval_pool(spark, d):
    return rounded(pool_of(spark, d).select("vec_id", "item", "score", "rank"), "score")


@query(f"WITH {CATALOG} SELECT vec_id, pop.item, pop AS score FROM embeddings, pop WHERE pop.item <> label")
def popularity_scores(spark, d):
    return T.constant_scores(queries_of(spark, d), items_of(spark, d).select("item", "pop"), "vec_id", "item", F.col("pop"))


@query("SELECT vec_id, i::BIGINT AS item, (('0x' || substr(m, 7, 2) || substr(m, 5, 2) || substr(m, 3, 2) || substr(m, 1, 2))::UBIGINT / 4294967296.0) AS score FROM (SELECT vec_id, i, md5('7|' || vec_id || '|' || i) AS m FROM embeddings, range(10) r(i) WHERE i <> label)")
def random_scores(spark, d):
    return T.constant_scores(queries_of(spark, d), catalog(spark, d).select("item"), "vec_id", "item", T.random_score(7, "vec_id", "item"))


@query(f"WITH {CATALOG}, {POS} SELECT vec_id, item, round(score, 6) AS score, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, item)::INT AS rank FROM scores ANTI JOIN pos USING (vec_id, item) QUALIFY rank <= 5")
def pool_excluding(spark, d):
    scores = T.cosine_pairs(queries_of(spark, d), catalog(spark, d), "vec_id", "item")
    return rounded(T.pool(scores, "vec_id", "item", 5, positives_of(spark, d)), "score").select("vec_id", "item", "score", "rank")


@query(f"WITH {CATALOG} SELECT vec_id, 'cosine' AS pool_method, '[' || string_agg(item, ',' ORDER BY rank) || ']' AS retrieved_app_ids_json, round(sum(score * rank), 6) AS scores_by_rank, count(*) AS n FROM pool GROUP BY vec_id")
def pool_json(spark, d):
    """Pools as JSON; the array of scores is read back, since two engines print doubles differently."""
    p = T.pool_rows(pool_of(spark, d).select("vec_id", "item", "score", "rank"), "vec_id", "item", "cosine")
    s = F.from_json("retrieved_scores_json", "array<double>")
    weighted = F.aggregate(F.transform(s, lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return p.select("vec_id", "pool_method", "retrieved_app_ids_json", F.round(weighted, 6).alias("scores_by_rank"), F.size(s).cast("long").alias("n"))


# -- re-ranking ------------------------------------------------------------------------


def _rank_by(final: str) -> str:
    return f"WITH {CATALOG}, f AS (SELECT vec_id, item, {final} AS final FROM pool) SELECT vec_id, item, round(final, 6) AS final FROM f"


@query(_rank_by(_D1))
def rerank_logpop(spark, d):
    return rounded(pool_of(spark, d).withColumn("final", R.logpop_blend("vec_id")).select("vec_id", "item", "final"), "final")


@query(_rank_by(f"(0.5 * {_MM('score')} + 0.5 * {_MM('pop')})"))
def rerank_linear(spark, d):
    return rounded(pool_of(spark, d).withColumn("final", R.linear("vec_id", 0.5)).select("vec_id", "item", "final"), "final")


@query(_rank_by("0.5 / (60 + row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, item)) + 0.5 / (60 + row_number() OVER (PARTITION BY vec_id ORDER BY pop DESC, item))"))
def rerank_rrf(spark, d):
    return rounded(pool_of(spark, d).withColumn("final", R.rank_fusion("vec_id", "item")).select("vec_id", "item", "final"), "final")


@query(_rank_by(f"pow(greatest({_MM('score')}, 1e-9), 0.3) * pow(greatest({_MM('ln(1 + pop)')}, 1e-9), 0.7)"))
def rerank_geometric(spark, d):
    return rounded(pool_of(spark, d).withColumn("final", R.geometric("vec_id", 0.3)).select("vec_id", "item", "final"), "final")


@query(_rank_by(f"CASE WHEN max(score) OVER (PARTITION BY vec_id) - min(score) OVER (PARTITION BY vec_id) < 0.5 THEN {_D1} ELSE {_MM('score')} END"))
def rerank_gated(spark, d):
    return rounded(pool_of(spark, d).withColumn("final", R.gated("vec_id", 0.2, 0.5)).select("vec_id", "item", "final"), "final")


@query(f"WITH {CATALOG}, h AS (SELECT *, rank <= 4 AS head FROM pool) SELECT vec_id, item, round(CASE WHEN head THEN 1 + 0.2 * {_MM('score', 'vec_id, head')} + 0.8 * {_MM('ln(1 + pop)', 'vec_id, head')} ELSE -rank::DOUBLE END, 6) AS final FROM h")
def rerank_head(spark, d):
    return rounded(R.head_only(pool_of(spark, d), "vec_id", "item", 4).select("vec_id", "item", "final"), "final")


@query(_rank_by("ln(1 + pop)"))
def rerank_popularity(spark, d):
    return rounded(pool_of(spark, d).withColumn("final", R.popularity_only()).select("vec_id", "item", "final"), "final")


_META = f"""WITH {CATALOG}, m AS (SELECT p.*, e.label AS anchor FROM pool p JOIN embeddings e USING (vec_id)),
c AS (SELECT m.vec_id, m.item, sum(a.x * b.x) AS meta FROM m JOIN cat a ON a.item = m.anchor JOIN cat b ON b.item = m.item AND b.i = a.i GROUP BY m.vec_id, m.item),
f AS (SELECT vec_id, item, {_D1} AS d1, meta FROM pool JOIN c USING (vec_id, item)), """


def _with_meta(spark, d):
    anchors = queries_of(spark, d).select("vec_id", F.col("item").alias("anchor"))
    return R.metadata_cosine(pool_of(spark, d).join(anchors, "vec_id"), catalog(spark, d), "anchor", "item", ["vector"])


@query(f"{_META} g AS (SELECT vec_id, item, 0.9 * {_MM('d1')} + 0.1 * {_MM('meta')} AS final FROM f) SELECT vec_id, item, round(final, 6) AS final FROM g")
def rerank_v2a(spark, d):
    return rounded(R.v2a(_with_meta(spark, d), "vec_id").select("vec_id", "item", "final"), "final")


@query(f"{_META} g AS (SELECT vec_id, item, 0.3 * {_MM('meta')} + 0.7 * d1 AS final FROM f) SELECT vec_id, item, round(final, 6) AS final FROM g")
def rerank_cross_encoder(spark, d):
    p = _with_meta(spark, d).withColumnRenamed("meta", "ce")
    return rounded(p.withColumn("final", R.cross_encoder_blend("vec_id", 0.3, 0.2)).select("vec_id", "item", "final"), "final")


@query(f"""WITH {CATALOG}, s AS (SELECT label::BIGINT AS item, list(DISTINCT vec_id % 11) AS tags FROM embeddings GROUP BY label), m AS (SELECT p.*, e.label AS anchor FROM pool p JOIN embeddings e USING (vec_id))
SELECT vec_id, m.item, round(len(list_intersect(a.tags, b.tags)) / len(list_distinct(list_concat(a.tags, b.tags)))::DOUBLE, 6) AS meta FROM m JOIN s a ON a.item = anchor JOIN s b ON b.item = m.item""")
def metadata_jaccard(spark, d):
    sets = table(spark, d, "embeddings").groupBy(F.col("label").cast("long").alias("item")).agg(F.collect_set(F.col("vec_id") % 11).alias("tags"))
    anchors = queries_of(spark, d).select("vec_id", F.col("item").alias("anchor"))
    p = R.metadata_jaccard(pool_of(spark, d).join(anchors, "vec_id"), sets, "anchor", "item", {"tags": 1.0})
    return rounded(p.select("vec_id", "item", "meta"), "meta")


@query(f"WITH {CATALOG}, {POS}, l AS (SELECT p.*, (pos.item IS NOT NULL)::INT AS label FROM pool p LEFT JOIN pos USING (vec_id, item)) SELECT vec_id, item, label, round(CASE WHEN sum(label) OVER w > 0 THEN label / sum(label) OVER w ELSE 0.0 END, 6) AS target, round(exp(score - max(score) OVER w) / sum(exp(score)) OVER w * exp(max(score) OVER w), 6) AS softmax FROM l WINDOW w AS (PARTITION BY vec_id)")
def listwise_rows(spark, d):
    l = pool_of(spark, d).join(positives_of(spark, d).withColumn("label", F.lit(1)), ["vec_id", "item"], "left").withColumn("label", F.coalesce("label", F.lit(0)))
    return rounded(l.select("vec_id", "item", "label", R.listnet_target("vec_id", "label").alias("target"), R.softmax("score", "vec_id").alias("softmax")), "target", "softmax")


# -- metrics ---------------------------------------------------------------------------


def _ranked(spark, d, final, tie="item"):
    return ranked(pool_of(spark, d).withColumn("final", final), "vec_id", F.col("final"), [F.col(tie)], "r").select("vec_id", "item", F.col("r").alias("rank"))


def _per_query(ranked_sql: str, k: int = 5) -> str:
    return f"""{POS}, np AS (SELECT vec_id, count(*) AS n_pos FROM pos GROUP BY vec_id),
t AS (SELECT r.vec_id, r.rank, (pos.item IS NOT NULL)::INT AS rel, sum((pos.item IS NOT NULL)::INT) OVER (PARTITION BY r.vec_id ORDER BY r.rank) AS c FROM ({ranked_sql}) r LEFT JOIN pos USING (vec_id, item) WHERE r.rank <= {k}),
a AS (SELECT vec_id, sum(rel) AS h, sum(rel * c / rank) AS ap, sum(rel / log2(rank + 1)) AS dcg, min(rank) FILTER (rel = 1) AS first FROM t GROUP BY vec_id),
pq AS (SELECT vec_id, n_pos, (h > 0)::INT::DOUBLE AS hit, h / {k}.0 AS precision, h / n_pos AS recall, ap / n_pos AS ap,
  dcg / list_sum(list_transform(range(1, least(n_pos, {k}) + 1), lambda r: 1 / log2(r + 1))) AS ndcg, coalesce(1.0 / first, 0.0) AS mrr FROM a JOIN np USING (vec_id))"""


_COLS = ("hit", "precision", "recall", "ap", "ndcg", "mrr")
_R6 = ", ".join(f"round({c}, 6)::DOUBLE AS {c}" for c in _COLS)


@query(f"WITH {CATALOG}, f AS (SELECT vec_id, item, {_D1} AS final FROM pool), r AS (SELECT vec_id, item, row_number() OVER (PARTITION BY vec_id ORDER BY final DESC, item) AS rank FROM f), {_per_query('SELECT * FROM r')} SELECT vec_id, n_pos, {_R6} FROM pq")
def ranking_metrics(spark, d):
    return rounded(M.ranking_metrics(_ranked(spark, d, R.logpop_blend("vec_id")), positives_of(spark, d), "vec_id", "item", 5), *_COLS)


@query(f"WITH {CATALOG}, {POS}, np AS (SELECT vec_id, count(*) AS n_pos FROM pos GROUP BY vec_id), h AS (SELECT vec_id, count(*) AS held FROM pool JOIN pos USING (vec_id, item) GROUP BY vec_id) SELECT vec_id, n_pos, coalesce(held, 0) AS held, (coalesce(held, 0) > 0)::INT::DOUBLE AS oracle_hit, round(coalesce(list_sum(list_transform(range(1, least(coalesce(held, 0), 5) + 1), lambda r: 1 / log2(r + 1))), 0) / list_sum(list_transform(range(1, least(n_pos, 5) + 1), lambda r: 1 / log2(r + 1))), 6) AS oracle_ndcg FROM np LEFT JOIN h USING (vec_id)")
def oracle_ceiling(spark, d):
    return rounded(M.oracle_metrics(pool_of(spark, d), positives_of(spark, d), "vec_id", "item", 5), "oracle_ndcg")


def _methods(spark, d):
    p = pool_of(spark, d)
    made = {"bare": F.col("score"), "logpop": R.logpop_blend("vec_id"), "popularity": F.col("pop")}
    out = None
    for name, final in made.items():
        r = ranked(p.withColumn("final", final), "vec_id", F.col("final"), [F.col("item")], "r").select(F.lit(name).alias("method"), "vec_id", "item", F.col("r").alias("rank"))
        out = r if out is None else out.unionByName(r)
    return out


_ALL = f"""WITH {CATALOG}, f AS (SELECT 'bare' AS method, vec_id, item, score AS final FROM pool UNION ALL SELECT 'logpop', vec_id, item, {_D1} FROM pool UNION ALL SELECT 'popularity', vec_id, item, pop FROM pool),
r AS (SELECT method, vec_id, item, row_number() OVER (PARTITION BY method, vec_id ORDER BY final DESC, item) AS rank FROM f), {POS}, np AS (SELECT vec_id, count(*) AS n_pos FROM pos GROUP BY vec_id),
t AS (SELECT r.method, r.vec_id, r.rank, (pos.item IS NOT NULL)::INT AS rel, sum((pos.item IS NOT NULL)::INT) OVER (PARTITION BY r.method, r.vec_id ORDER BY r.rank) AS c FROM r LEFT JOIN pos USING (vec_id, item) WHERE r.rank <= 5),
a AS (SELECT method, vec_id, sum(rel) AS h, sum(rel * c / rank) AS ap, sum(rel / log2(rank + 1)) AS dcg, min(rank) FILTER (rel = 1) AS first FROM t GROUP BY method, vec_id),
pq AS (SELECT method, vec_id, n_pos, (h > 0)::INT::DOUBLE AS hit, h / 5.0 AS precision, h / n_pos AS recall, ap / n_pos AS ap,
  dcg / list_sum(list_transform(range(1, least(n_pos, 5) + 1), lambda r: 1 / log2(r + 1))) AS ndcg, coalesce(1.0 / first, 0.0) AS mrr FROM a JOIN np USING (vec_id)),
x AS (SELECT *, CASE WHEN n_pos >= 2 THEN 'slice_a_multi_target' WHEN n_pos = 1 THEN 'slice_b_single_target' ELSE 'slice_c_zero_target' END AS slice,
  CASE WHEN vec_id % 9 = 0 THEN '0' WHEN vec_id % 9 = 1 THEN '1' WHEN vec_id % 9 <= 3 THEN '2-3' WHEN vec_id % 9 <= 7 THEN '4-7' ELSE '8+' END AS bucket FROM pq)"""


def _metrics(spark, d):
    m = M.ranking_metrics(_methods(spark, d), positives_of(spark, d), "vec_id", "item", 5, ["method"])
    return m.withColumns({"slice": M.slice_name(F.col("n_pos")), "bucket": M.support_bucket(F.pmod("vec_id", F.lit(9)))})


_AVG = ", ".join(f"round(avg({c}), 6) AS {c}" for c in _COLS)


@query(f"{_ALL} SELECT 'overall' AS segment, 'all' AS value, method, {_AVG}, count(*) AS n FROM x GROUP BY method UNION ALL SELECT 'slice', slice, method, {_AVG}, count(*) FROM x GROUP BY slice, method UNION ALL SELECT 'bucket', bucket, method, {_AVG}, count(*) FROM x GROUP BY bucket, method")
def metric_tables(spark, d):
    return rounded(M.segment_tables(_metrics(spark, d), "method", ["slice", "bucket"], _COLS), *_COLS)


@query(f"{_ALL}, t2 AS (SELECT bucket, method, avg(ndcg) AS ndcg, count(*) AS n FROM x GROUP BY bucket, method) SELECT bucket, method, round(ndcg, 6) AS ndcg, n, round(ndcg - max(CASE WHEN method = 'popularity' THEN ndcg END) OVER (PARTITION BY bucket), 6) AS ndcg_delta FROM t2")
def metric_deltas(spark, d):
    t = M.mean_table(_metrics(spark, d), ["bucket", "method"], ["ndcg"])
    return rounded(M.deltas(t, ["bucket"], "popularity", ["ndcg"]), "ndcg", "ndcg_delta")


@query(f"{_ALL}, w AS (SELECT vec_id, max(ndcg) FILTER (method = 'logpop') AS a, max(ndcg) FILTER (method = 'bare') AS b FROM x GROUP BY vec_id) SELECT count(*) FILTER (round(a, 9) > round(b, 9)) AS wins, count(*) FILTER (round(a, 9) < round(b, 9)) AS losses, count(*) FILTER (round(a, 9) = round(b, 9)) AS ties, round(avg(a - b), 6) AS mean_delta FROM w")
def head_to_head(spark, d):
    m = _metrics(spark, d).withColumn("ndcg", F.round("ndcg", 9))
    return rounded(M.head_to_head(m, "vec_id", "logpop", "bare", "ndcg"), "mean_delta")


@query(f"{_ALL} SELECT method, round(avg(ndcg), 6) AS mean, round(stddev_pop(ndcg), 6) AS std FROM x WHERE slice = 'slice_b_single_target' OR n_pos > 0 GROUP BY method")
def metric_stability(spark, d):
    return rounded(M.stability(_metrics(spark, d), "method", "ndcg"), "mean", "std")


@query(f"WITH {POS}, n AS (SELECT vec_id, count(pos.item) AS n FROM embeddings LEFT JOIN pos USING (vec_id) GROUP BY vec_id) SELECT count(*) AS n_total, count(*) FILTER (n >= 2) AS n_multi, count(*) FILTER (n = 1) AS n_single, count(*) FILTER (n = 0) AS n_zero, avg((n >= 1)::INT) AS evaluable_ratio FROM n")
def cohort_coverage(spark, d):
    n = queries_of(spark, d).select("vec_id").join(positives_of(spark, d), "vec_id", "left").groupBy("vec_id").agg(F.count("item").alias("n"))
    return M.coverage(n, "n")


@query("SELECT b AS bucket, count(e.vec_id) AS n FROM (VALUES ('0'), ('1'), ('2-3'), ('4-7'), ('8+')) v(b) LEFT JOIN (SELECT vec_id, CASE WHEN vec_id % 6 = 0 THEN '0' WHEN vec_id % 6 = 1 THEN '1' WHEN vec_id % 6 <= 3 THEN '2-3' ELSE '4-7' END AS k FROM embeddings) e ON e.k = b GROUP BY b")
def bucket_counts(spark, d):
    e = table(spark, d, "embeddings").select(M.support_bucket(F.pmod("vec_id", F.lit(6))).alias("bucket"))
    return M.counts_over(e, "bucket", M.BUCKETS)


@query(f"WITH {CATALOG}, {POS}, h AS (SELECT e.vec_id, count(pos.item) AS found FROM embeddings e JOIN pool p ON p.vec_id = e.vec_id AND p.rank <= 3 LEFT JOIN pos ON pos.vec_id = p.vec_id AND pos.item = p.item GROUP BY e.vec_id) SELECT count(*) AS n, round(avg((found = 0)::INT), 6) AS zero_rate, round(avg(found), 6) AS mean_found FROM h")
def retrieval_bottleneck(spark, d):
    p = pool_of(spark, d, 3).join(positives_of(spark, d).withColumn("rel", F.lit(1)), ["vec_id", "item"], "left").groupBy("vec_id").agg(F.count("rel").alias("found"))
    return rounded(M.bottleneck(p, [], "found"), "zero_rate", "mean_found")


@query(f"""WITH {CATALOG}, f AS (SELECT 'bare' AS method, vec_id, item, score AS final FROM pool UNION ALL SELECT 'logpop', vec_id, item, {_D1} FROM pool UNION ALL SELECT 'popularity', vec_id, item, pop FROM pool),
r AS (SELECT method, vec_id, item, row_number() OVER (PARTITION BY method, vec_id ORDER BY final DESC, item) AS rank FROM f QUALIFY rank <= 4),
pr AS (SELECT a.method, a.vec_id, a.item AS x, b.item AS y FROM r a JOIN r b ON a.method = b.method AND a.vec_id = b.vec_id AND a.rank < b.rank),
sim AS (SELECT a.item AS x, b.item AS y, sum(a.x * b.x) AS s FROM cat a JOIN cat b ON a.i = b.i GROUP BY 1, 2),
ild AS (SELECT method, avg(v) AS ild FROM (SELECT method, vec_id, avg(1 - s) AS v FROM pr JOIN sim USING (x, y) GROUP BY 1, 2) GROUP BY 1),
nov AS (SELECT item, -log2((pop + 1) / (sum(pop) OVER () + count(*) OVER ())) AS v FROM pop),
nv AS (SELECT method, avg(v) AS novelty FROM (SELECT method, vec_id, avg(v) AS v FROM r JOIN nov USING (item) GROUP BY 1, 2) GROUP BY 1),
cv AS (SELECT method, count(DISTINCT item) / (SELECT count(*) FROM pop)::DOUBLE AS coverage FROM r GROUP BY 1),
gp AS (SELECT method, avg(1 - c / (n + 4 - c)) AS gap FROM (SELECT a.method, a.vec_id, count(*) AS n, count(b.item) AS c FROM r a LEFT JOIN (SELECT * FROM r WHERE method = 'popularity') b ON b.vec_id = a.vec_id AND b.item = a.item GROUP BY 1, 2) GROUP BY 1)
SELECT method, round(ild, 6) AS ild, round(coverage, 6) AS coverage, round(novelty, 6) AS novelty, round(gap, 6) AS gap_vs_reference FROM ild JOIN nv USING (method) JOIN cv USING (method) JOIN gp USING (method)""")
def personalization(spark, d):
    top = _methods(spark, d).where("rank <= 4")
    return rounded(M.personalization(top, items_of(spark, d).select("item", "vector", "pop"), "vec_id", "item"), "ild", "coverage", "novelty", "gap_vs_reference")


@query(f"""WITH {CATALOG}, {POS}, m AS (SELECT vec_id, avg(pop) AS v FROM pos JOIN pop USING (item) GROUP BY vec_id), q AS (SELECT list_distinct(quantile_cont(v, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0])) AS e FROM m)
SELECT vec_id, 'D' || (1 + len(list_filter(list_sort(e)[2:len(e) - 1], lambda x: v > x))) AS decile FROM m, q""")
def popularity_deciles(spark, d):
    m = positives_of(spark, d).join(items_of(spark, d).select("item", "pop"), "item").groupBy("vec_id").agg(F.avg("pop").alias("v"))
    return deciles(m, "v").select("vec_id", "decile")


# -- classifiers and regression ----------------------------------------------------------


_LD = "ld AS (SELECT l.doc_id, quality, toxic, n_chars, least(n_chars / 4000.0, 1.0)::DOUBLE AS score FROM labels l JOIN documents d USING (doc_id))"


def _labelled(spark, d):
    j = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "n_chars", "lang"), "doc_id")
    return j.withColumn("score", F.least(F.col("n_chars") / 4000.0, F.lit(1.0)))


@query(f"""WITH {_LD}, c AS (SELECT count(*) AS n, count(*) FILTER (quality = 1 AND score >= 0.2) AS tp, count(*) FILTER (quality = 0 AND score >= 0.2) AS fp, count(*) FILTER (quality = 1 AND score < 0.2) AS fn, count(*) FILTER (quality = 0 AND score < 0.2) AS tn FROM ld)
SELECT n, tp, fp, fn, tn, round((tp + tn) / n, 6) AS accuracy, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(tn / (tn + fp), 6) AS specificity, round(2 * tp / (2 * tp + fn + fp), 6) AS f1, round(5 * tp / (5 * tp + 4 * fn + fp), 6) AS f2,
round((tp::DOUBLE * tn - fp * fn) / sqrt((tp + fp)::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn)), 6) AS mcc FROM c""")
def classifier_metrics(spark, d):
    x = _labelled(spark, d).withColumn("p", (F.col("score") >= 0.2).cast("int"))
    return rounded(K.classification_metrics(x, "quality", "p"), "accuracy", "precision", "recall", "specificity", "f1", "f2", "mcc")


@query(f"WITH {_LD}, r AS (SELECT quality, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0::DOUBLE AS r FROM ld) SELECT round((sum(r) FILTER (quality = 1) - count(*) FILTER (quality = 1) * (count(*) FILTER (quality = 1) + 1) / 2.0::DOUBLE) / (count(*) FILTER (quality = 1) * count(*) FILTER (quality = 0)), 6) AS roc_auc FROM r")
def roc_auc(spark, d):
    return rounded(K.roc_auc(_labelled(spark, d), "quality", "score"), "roc_auc")


_PR = f"WITH {_LD}, g AS (SELECT score AS threshold, count(*) FILTER (quality = 1) AS p, count(*) FILTER (quality = 0) AS n FROM ld GROUP BY score), c AS (SELECT threshold, p, sum(p) OVER w AS tp, sum(n) OVER w AS fp, sum(p) OVER () AS pp, sum(n) OVER () AS nn FROM g WINDOW w AS (ORDER BY threshold DESC))"


@query(f"{_PR} SELECT threshold, tp::BIGINT AS tp, fp::BIGINT AS fp, round(tp / (tp + fp), 6)::DOUBLE AS precision, round(tp / pp, 6)::DOUBLE AS recall, round(fp / nn, 6)::DOUBLE AS fpr FROM c")
def pr_curve(spark, d):
    return rounded(K.pr_curve(_labelled(spark, d), "quality", "score"), "precision", "recall", "fpr")


@query(f"{_PR} SELECT round(sum(p / pp * tp / (tp + fp)), 6)::DOUBLE AS average_precision FROM c")
def average_precision(spark, d):
    return rounded(K.average_precision(_labelled(spark, d), "quality", "score"), "average_precision")


@query(f"WITH {_LD} SELECT t::DOUBLE AS threshold, count(*) FILTER (quality = 1 AND score >= t) AS tp, count(*) FILTER (quality = 0 AND score >= t) AS fp FROM ld, (VALUES (0.1), (0.3), (0.5)) v(t) GROUP BY t")
def threshold_sweep(spark, d):
    return K.threshold_sweep(_labelled(spark, d), "quality", "score", [0.1, 0.3, 0.5]).select("threshold", "tp", "fp")


@query("SELECT o_orderpriority, count(*) AS n, round(avg(abs(e)), 4) AS mae, round(avg(e * e), 2) AS mse, round(sqrt(avg(e * e)), 4) AS rmse, round(1 - sum(e * e) / (sum(y * y) - sum(y) * sum(y) / count(*)), 6) AS r2, round(avg(abs(e) / greatest(abs(y), 1e-8)), 6) AS mape FROM (SELECT o_orderpriority, o_totalprice AS y, (200000.0::DOUBLE + o_custkey % 100) - o_totalprice AS e FROM orders) GROUP BY o_orderpriority")
def regression_metrics(spark, d):
    o = table(spark, d, "orders").select("o_orderpriority", F.col("o_totalprice").alias("y"), (F.lit(200000.0) + F.col("o_custkey") % 100).alias("p"))
    m = K.regression_metrics(o, "y", "p", ["o_orderpriority"])
    return m.select("o_orderpriority", "n", F.round("mae", 4).alias("mae"), F.round("mse", 2).alias("mse"), F.round("rmse", 4).alias("rmse"), F.round("r2", 6).alias("r2"), F.round("mape", 6).alias("mape"))


@query(f"WITH {_LD}, r AS (SELECT rank() OVER (ORDER BY n_chars) + (count(*) OVER (PARTITION BY n_chars) - 1) / 2.0::DOUBLE AS a, rank() OVER (ORDER BY quality) + (count(*) OVER (PARTITION BY quality) - 1) / 2.0::DOUBLE AS b FROM ld) SELECT round(corr(a, b), 6) AS spearman FROM r")
def spearman(spark, d):
    return rounded(K.spearman(_labelled(spark, d), "n_chars", "quality"), "spearman")


@query("SELECT 'l_quantity' AS a, 'l_extendedprice' AS b, round(corr(l_quantity, l_extendedprice), 6) AS correlation FROM lineitem UNION ALL SELECT 'l_quantity', 'l_discount', round(corr(l_quantity, l_discount), 6) FROM lineitem UNION ALL SELECT 'l_extendedprice', 'l_discount', round(corr(l_extendedprice, l_discount), 6) FROM lineitem")
def correlations(spark, d):
    return rounded(K.pairwise_correlation(table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"]), "correlation")


@query("SELECT 1.0::DOUBLE AS w0, count(*) FILTER (quality = 0) / count(*) FILTER (quality = 1)::DOUBLE AS w1 FROM labels")
def class_weights(spark, d):
    return K.class_weights(table(spark, d, "labels"), "quality")


@query(f"WITH {_LD}, s AS (SELECT 1 + quality * 2 AS a, 1 + n_chars % 5 AS b FROM ld), r AS (SELECT a, b, rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0::DOUBLE AS x, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2.0::DOUBLE AS y FROM s) SELECT count(*) AS n, round(avg((a = b)::INT), 6) AS exact, round(avg((abs(a - b) <= 1)::INT), 6) AS within_one, round(corr(x, y), 6) AS spearman FROM r")
def rater_agreement(spark, d):
    s = _labelled(spark, d).select((1 + F.col("quality") * 2).alias("a"), (1 + F.col("n_chars") % 5).alias("b"))
    return rounded(K.agreement(s, "a", "b"), "exact", "within_one", "spearman")


@query(f"WITH {EV} SELECT round(avg(flag), 6) AS positive_rate, (avg(flag) >= 0.5)::INT AS majority, round(avg(flag), 6) AS mean FROM ev")
def dumb_baselines(spark, d):
    return rounded(K.baselines(events(spark, d), "flag"), "positive_rate", "mean")
