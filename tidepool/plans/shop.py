"""Parts as a catalogue and customers as queries: the evaluation's input on the driver's tables, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidepool.functions import vectors as V
from tidepool.operators import pooling as P
from tidepool.operators import ranking as R
from tidepool.operators import retrieval as T
from tidepool.operators.splits import split_support_aware
from tidepool.plans.tables import PU, SUPPORT_SPLIT, purchases, table
from tidepool.sources.tables import listing, scratch

K_FINAL, K_POOL = 10, 30


#: Metadata vectors of an item: pieces of its vector.
FIELDS = {"genres": (1, 3), "themes": (4, 3), "keywords": (7, 2)}
#: Two fixed towers (rows: outputs), for plans that need some; ``towers.train_towers`` learns others.
QUERY_TOWER = [[1, 0, 0.5, 0, 0, 0, 0, 0.25], [0, 1, 0, 0.5, 0, 0, 0.25, 0], [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8]]
ITEM_TOWER = [[1, 0, 0, 0, 0.5, 0, 0, 0.25], [0, 1, 0, 0, 0, 0.5, 0.25, 0], [0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2, 0.1]]
BLEND_WEIGHT = 0.3


_WRITTEN: dict[tuple, str] = {}


def once(spark: SparkSession, d: str, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The rows of ``make``, written once a session for one state of the input files and read from there."""
    key = (name, *listing(spark, *(f"{d}/{t}.parquet" for t in ("part", "orders", "lineitem"))))
    if key not in _WRITTEN:
        path = scratch(spark, name)
        make().write.parquet(path)
        _WRITTEN[key] = path
    return spark.read.parquet(_WRITTEN[key])


def split(spark: SparkSession, d: str) -> DataFrame:
    """Purchases with their split: everything below is made of one split, so that nothing that is to be predicted is known before."""
    return once(spark, d, "split", lambda: _split(spark, d))


def _split(spark: SparkSession, d: str) -> DataFrame:
    """Purchases with their split, and by windows over the same shuffle: own, is_positive, is_support, and nth of a customer's support by (ts, id, item)."""
    rows = purchases(spark, d).withColumn("row", F.struct("id", "item", "flag"))  # ids repeat in the driver's tables
    rows = split_support_aware(rows, "user", "ts", "row").select("id", "user", "item", "ts", "flag", "split")
    by, kept = Window.partitionBy("user"), F.col("flag") == 1
    asked = F.min(F.when((F.col("split") == "val") & kept, F.col("item")))
    rows = rows.withColumn("own", F.coalesce(asked.over(by), F.min("item").over(by)))
    positive = (F.col("split") == "val") & kept & (F.col("item") != F.col("own")) & F.col("user").isNotNull()
    rows = rows.withColumn("is_positive", F.coalesce(positive, F.lit(False)))
    wanted = F.max("is_positive").over(Window.partitionBy("user", "item"))
    rows = rows.withColumn("is_support", F.coalesce((F.col("split") == "train") & kept & ~wanted, F.lit(False)))
    return rows.withColumn("nth", F.when(F.col("is_support"), F.row_number().over(Window.partitionBy("user", "is_support").orderBy("ts", "id", "item"))))


def items(spark: SparkSession, d: str) -> DataFrame:
    """Parts: item, vector (to length one), pop (how often it was bought and kept in train), metadata vectors."""
    return once(spark, d, "items", lambda: _items(spark, d))


def _items(spark: SparkSession, d: str) -> DataFrame:
    part, k = table(spark, d, "part"), F.col("p_partkey")
    parts = [F.col("p_size"), F.col("p_retailprice") / 100, F.length("p_name"), k % 7, k % 11, k % 13, 1 + k % 3, F.lit(5)]
    catalog = part.select(k.alias("item"), V.unit(F.array(*(x.cast("double") for x in parts))).alias("vector"))
    catalog = catalog.withColumns({f: F.slice("vector", *at) for f, at in FIELDS.items()})
    return T.popularity(split(spark, d).where("split = 'train'"), catalog, "item", flag="flag")


def _own(spark: SparkSession, d: str) -> DataFrame:
    """Each customer's own item: the first of those to be predicted, which is then none of them; without any, the first of all."""
    return split(spark, d).groupBy("user").agg(F.max("own").alias("own"))


def examples(spark: SparkSession, d: str) -> DataFrame:
    """Customers: user, item (their own), n_support, n_eval_targets."""
    held = support(spark, d).groupBy("user").agg(F.count_distinct("item").alias("n_support"))
    n = positives(spark, d).groupBy("user").agg(F.count(F.lit(1)).alias("n_eval_targets"))
    out = _own(spark, d).withColumnRenamed("own", "item").join(held, "user", "left").join(n, "user", "left")
    return out.fillna(0, ["n_support", "n_eval_targets"])


def positives(spark: SparkSession, d: str) -> DataFrame:
    """user, item: what was bought and kept in val, without the own item."""
    return split(spark, d).where("is_positive").select("user", "item").distinct()


def support(spark: SparkSession, d: str) -> DataFrame:
    """user, item, ts, id: what was bought and kept in train and is not to be predicted."""
    return split(spark, d).where("is_support").select("user", "item", "ts", "id")


def queries(spark: SparkSession, d: str) -> DataFrame:
    """user, item (their own), vector: the own part's, moved a little."""
    moved = F.transform("vector", lambda x, i: x + (F.col("user") * (i + 1)) % 9 / 20.0)
    own = _own(spark, d).withColumnRenamed("own", "item")
    return own.join(items(spark, d).select("item", "vector"), "item").select("user", "item", V.unit(moved).alias("vector"))


def support_vectors(spark: SparkSession, d: str) -> DataFrame:
    """user, ts, id, item, vector: the bought parts that count as training rows."""
    return support(spark, d).join(items(spark, d).select("item", "vector"), "item").select("user", "ts", "id", "item", "vector")


FIRST = 3


def _first_support(spark: SparkSession, d: str) -> DataFrame:
    """The support vectors that ``train_mean_queries`` takes: those of the first rows, unless one of these is of no known part."""
    first = split(spark, d).where(F.col("is_support") & (F.col("nth") < FIRST)).select("user", "ts", "id", "item")
    known = items(spark, d).select("item", "vector")
    lost = first.join(known.where("vector IS NOT NULL"), "item", "left_anti")
    return first.join(known, "item") if lost.isEmpty() else support_vectors(spark, d)


def train_mean_queries(spark: SparkSession, d: str) -> DataFrame:
    """user, item, own_vector (that of ``queries``), vector."""
    return P.train_mean_query(queries(spark, d).withColumn("own_vector", F.col("vector")), _first_support(spark, d), "user", ["ts", "id", "item"], FIRST)


def descriptions(spark: SparkSession, d: str) -> DataFrame:
    """item, description: the item's vector backwards; every fifth item has none."""
    return items(spark, d).where("item % 5 <> 0").select("item", F.reverse("vector").alias("description"))


def full_queries(spark: SparkSession, d: str) -> DataFrame:
    """Queries with a vector for each registered method."""
    q = train_mean_queries(spark, d).select("user", "item", F.col("own_vector").alias("vector"), F.col("vector").alias("train_mean_vector"))
    q = P.blended_with_own(q, descriptions(spark, d), "item", BLEND_WEIGHT)
    return q.withColumn("tower_vector", V.project(F.col("vector"), QUERY_TOWER))


def full_items(spark: SparkSession, d: str) -> DataFrame:
    """Items with a vector for each registered method."""
    it = items(spark, d)
    return it.withColumns({"tower_vector": V.project(F.col("vector"), ITEM_TOWER), "profile_vector": F.col("vector")})


METHODS = ["raw", "popularity_train", "multi_mean_train", "two_tower_v1", "rag_chunk_v1_vector_blend_query"]


def pools(spark: SparkSession, d: str, k: int = K_POOL, methods: Sequence[str] = METHODS) -> dict[str, DataFrame]:
    """The pools of five registered methods, or of some of them."""
    several = set(methods) - {"raw", "popularity_train"}  # each method reads the queries anew
    q = once(spark, d, "queries", lambda: full_queries(spark, d)) if several else queries(spark, d)
    return T.registered_pools(q, full_items(spark, d), "user", "item", list(methods), k)


RERANKERS = (
    R.PoolReranker("logpop_blend", "raw", lambda p, q: p.withColumn("final", R.logpop_blend(q))),
    R.PoolReranker("fused_ranks", "multi_mean_train", lambda p, q: p.withColumn("final", R.rank_fusion(q, "item"))),
    *(r for r in R.RERANKERS.values() if r.base_method not in ("raw",)),
)

_UNIT = "list_transform({0}, lambda z: z / sqrt(list_inner_product({0}, {0})))"
_MM = lambda x: f"CASE WHEN max({x}) OVER w - min({x}) OVER w <= 1e-12 THEN 0.0 ELSE ({x} - min({x}) OVER w) / (max({x}) OVER w - min({x}) OVER w) END"

_TOWER = lambda v, m: "[" + ", ".join(f"list_inner_product({v}, {[float(x) for x in row]}::DOUBLE[])" for row in m) + "]"
_COS = lambda a, b: f"CASE WHEN sqrt(list_inner_product({a}, {a})) * sqrt(list_inner_product({b}, {b})) <= 1e-12 THEN 0.0 ELSE list_inner_product({a}, {b}) / sqrt(list_inner_product({a}, {a})) / sqrt(list_inner_product({b}, {b})) END"

_ROWS = SUPPORT_SPLIT.replace("ORDER BY ts DESC, id DESC", "ORDER BY ts DESC, id DESC, item DESC, flag DESC").replace("SELECT id, user, CASE", "SELECT id, user, item, ts, flag, CASE")

#: it, ex, pos, su (support), qv (user, own, v), mv (user, v) and pools (method, user, item, score, rank).
SHOP = f"""{PU},
sp AS MATERIALIZED ({_ROWS}),
it0 AS (SELECT p_partkey AS item, [p_size, p_retailprice / 100, length(p_name), p_partkey % 7, p_partkey % 11, p_partkey % 13, 1 + p_partkey % 3, 5]::DOUBLE[] AS raw FROM part),
it AS MATERIALIZED (SELECT it0.item, raw, {_UNIT.format('raw')} AS v, greatest(coalesce(n, 0), 1e-6)::DOUBLE AS pop FROM it0 LEFT JOIN (SELECT item, count(*) AS n FROM sp WHERE split = 'train' AND flag = 1 GROUP BY item) USING (item)),
own AS MATERIALIZED (SELECT user, coalesce(min(item) FILTER (split = 'val' AND flag = 1), min(item)) AS own FROM sp GROUP BY user),
pos AS MATERIALIZED (SELECT DISTINCT sp.user, sp.item FROM sp JOIN own ON own.user = sp.user WHERE split = 'val' AND flag = 1 AND item <> own.own),
su AS MATERIALIZED (SELECT sp.* FROM sp ANTI JOIN pos ON pos.user = sp.user AND pos.item = sp.item WHERE split = 'train' AND flag = 1),
ex AS MATERIALIZED (SELECT own.user, own.own, coalesce(m, 0) AS n_support, coalesce(n, 0) AS n_eval_targets FROM own LEFT JOIN (SELECT user, count(*) AS n FROM pos GROUP BY user) p ON p.user = own.user
  LEFT JOIN (SELECT user, count(DISTINCT item) AS m FROM su GROUP BY user) c ON c.user = own.user),
q0 AS (SELECT ex.user, ex.own, list_transform(v, lambda z, i: z + (ex.user * i) % 9 / 20.0::DOUBLE) AS raw, list_reverse(v) AS own_description FROM ex JOIN it ON it.item = ex.own),
qv AS MATERIALIZED (SELECT q0.user, own, {_UNIT.format('raw')} AS v, own_description FROM q0),
sv AS (SELECT su.user, it.v FROM su JOIN it USING (item) QUALIFY row_number() OVER (PARTITION BY su.user ORDER BY ts, id, item) <= 2),
m0 AS (SELECT a.user, i, avg(x) AS x FROM (SELECT b.user, unnest(range(1, 9)) AS i, unnest(v) AS x FROM (SELECT qv.user, v FROM qv UNION ALL SELECT sv.user, v FROM sv) b) a GROUP BY a.user, i),
m1 AS (SELECT m0.user, list(x ORDER BY i) AS raw FROM m0 GROUP BY m0.user),
mv AS MATERIALIZED (SELECT qv.user, own, {_UNIT.format('raw')} AS v FROM qv JOIN m1 ON m1.user = qv.user),
qt AS (SELECT qv.user, own, {_TOWER('v', QUERY_TOWER)} AS t FROM qv), itt AS (SELECT item, {_TOWER('v', ITEM_TOWER)} AS t FROM it),
qb0 AS (SELECT qv.user, own, list_transform(v, lambda z, i: {1 - BLEND_WEIGHT} * z + {BLEND_WEIGHT} * own_description[i]) AS raw, v FROM qv),
qb AS (SELECT qb0.user, own, CASE WHEN own % 5 = 0 THEN v ELSE {_UNIT.format('raw')} END AS v FROM qb0),
sc AS (SELECT 'raw' AS method, qv.user, item, round(list_inner_product(qv.v, it.v), 12) AS score FROM qv, it WHERE item <> own
  UNION ALL SELECT 'multi_mean_train', mv.user, item, round(list_inner_product(mv.v, it.v), 12) FROM mv, it WHERE item <> own
  UNION ALL SELECT 'popularity_train', qv.user, item, pop FROM qv, (SELECT * FROM it ORDER BY pop DESC, item LIMIT {K_POOL + 1}) it WHERE item <> own
  UNION ALL SELECT 'two_tower_v1', qt.user, item, round({_COS('qt.t', 'itt.t')}, 12) FROM qt, itt WHERE item <> own
  UNION ALL SELECT 'rag_chunk_v1_vector_blend_query', qb.user, item, round(list_inner_product(qb.v, it.v), 12) - 1 FROM qb, it WHERE item <> own),
pools AS MATERIALIZED (SELECT method, sc.user, item, score, row_number() OVER (PARTITION BY method, sc.user ORDER BY score DESC, item) AS rank FROM sc QUALIFY rank <= {K_POOL})"""


def _v2a(base: str) -> str:
    """user, item, final of v2a on a method's pools."""
    meta = " + ".join(_COS(f"x.v[{a}:{a + n - 1}]", f"it.v[{a}:{a + n - 1}]") for a, n in FIELDS.values())
    return f"""SELECT b.user, b.item, {1 - R.W_META} * {_MM('d1')} + {R.W_META} * {_MM('meta')} AS final FROM (
  SELECT p.user, p.item, 0.2 * {_MM('score')} + 0.8 * {_MM('ln(1 + it.pop)')} AS d1, ({meta}) / {len(FIELDS)} AS meta
  FROM pools p JOIN it USING (item) JOIN own ON own.user = p.user JOIN it x ON x.item = own.own WHERE method = '{base}' WINDOW w AS (PARTITION BY p.user)) b WINDOW w AS (PARTITION BY b.user)"""


#: lists (method, origin, user, item, final, rank) and per (method, origin, user, metrics, slice, bucket).
EVALUATED = f"""WITH {SHOP},
lp AS (SELECT p.user, p.item, 0.2 * {_MM('score')} + 0.8 * {_MM('ln(1 + pop)')} AS final FROM pools p JOIN it USING (item) WHERE method = 'raw' WINDOW w AS (PARTITION BY p.user)),
rf AS (SELECT p.user, p.item, 0.5 / (60 + row_number() OVER (PARTITION BY p.user ORDER BY score DESC, p.item)) + 0.5 / (60 + row_number() OVER (PARTITION BY p.user ORDER BY pop DESC, p.item)) AS final FROM pools p JOIN it USING (item) WHERE method = 'multi_mean_train'),
ta AS (SELECT p.user, p.item, 0.2 * {_MM('score')} + 0.8 * {_MM('ln(1 + pop)')} AS final FROM pools p JOIN it USING (item) WHERE method = 'two_tower_v1' WINDOW w AS (PARTITION BY p.user)),
tv AS ({_v2a('two_tower_v1')}), rv AS ({_v2a('rag_chunk_v1_vector_blend_query')}),
lists AS MATERIALIZED (SELECT method, method AS origin, pools.user, item, score AS final, rank FROM pools
  UNION ALL SELECT 'two_tower_v1_heuristic_logpop_blend', 'two_tower_v1', ta.user, item, final, row_number() OVER (PARTITION BY ta.user ORDER BY final DESC, item) FROM ta
  UNION ALL SELECT 'two_tower_v1_v2a_embed_query_logpop_blend', 'two_tower_v1', tv.user, item, final, row_number() OVER (PARTITION BY tv.user ORDER BY final DESC, item) FROM tv
  UNION ALL SELECT 'rag_chunk_v1_vector_blend_query_v2a_embed_query_logpop_blend', 'rag_chunk_v1_vector_blend_query', rv.user, item, final, row_number() OVER (PARTITION BY rv.user ORDER BY final DESC, item) FROM rv
  UNION ALL SELECT 'logpop_blend', 'raw', lp.user, item, final, row_number() OVER (PARTITION BY lp.user ORDER BY final DESC, item) FROM lp
  UNION ALL SELECT 'fused_ranks', 'multi_mean_train', rf.user, item, final, row_number() OVER (PARTITION BY rf.user ORDER BY final DESC, item) FROM rf),
seg AS (SELECT ex.user, n_eval_targets, n_support, CASE WHEN n_eval_targets >= 2 THEN 'slice_a_multi_target' WHEN n_eval_targets = 1 THEN 'slice_b_single_target' ELSE 'slice_c_zero_target' END AS slice,
  CASE WHEN n_support <= 0 THEN '0' WHEN n_support = 1 THEN '1' WHEN n_support <= 3 THEN '2-3' WHEN n_support <= 7 THEN '4-7' ELSE '8+' END AS bucket FROM ex),
hits AS (SELECT l.method, l.origin, l.user, l.rank, (pos.item IS NOT NULL)::INT AS rel FROM lists l LEFT JOIN pos ON pos.user = l.user AND pos.item = l.item),
best AS (SELECT p.method AS origin, p.user, count(pos.item) AS held FROM pools p LEFT JOIN pos ON pos.user = p.user AND pos.item = p.item GROUP BY ALL),
run AS (SELECT *, sum(rel) OVER (PARTITION BY method, hits.user ORDER BY rank) AS c FROM hits WHERE rank <= {K_FINAL}),
agg AS (SELECT method, origin, run.user, sum(rel) AS h, sum(rel * c / rank) AS ap, sum(rel / log2(rank + 1)) AS dcg, min(rank) FILTER (rel = 1) AS first FROM run GROUP BY ALL),
per AS (SELECT agg.method, agg.origin, agg.user, n_eval_targets, n_support, slice, bucket, (h > 0)::INT::DOUBLE AS hit, h / {K_FINAL}.0 AS precision, h / n_eval_targets AS recall, ap / n_eval_targets AS ap,
  dcg / list_sum(list_transform(range(1, least(n_eval_targets, {K_FINAL}) + 1), lambda r: 1 / log2(r + 1))) AS ndcg, coalesce(1.0 / first, 0.0) AS mrr, (held > 0)::INT::DOUBLE AS oracle_hit,
  coalesce(list_sum(list_transform(range(1, least(held, {K_FINAL}) + 1), lambda r: 1 / log2(r + 1))), 0) / list_sum(list_transform(range(1, least(n_eval_targets, {K_FINAL}) + 1), lambda r: 1 / log2(r + 1))) AS oracle_ndcg
  FROM agg JOIN seg ON seg.user = agg.user JOIN best ON best.origin = agg.origin AND best.user = agg.user WHERE n_eval_targets > 0),
ret AS (SELECT method, seg.user, n_eval_targets, slice, bucket, (held > 0)::INT::DOUBLE AS hit, held / {K_POOL}.0 AS precision, held / n_eval_targets AS recall, held AS n_positive_in_retrieved
  FROM (SELECT origin AS method, best.user, held FROM best) b JOIN seg ON seg.user = b.user WHERE n_eval_targets > 0),
mp AS (SELECT pos.user, avg(pop) AS v FROM pos JOIN it USING (item) GROUP BY pos.user),
edges AS (SELECT list_distinct(quantile_cont(v, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0])) AS e FROM mp),
dec AS (SELECT mp.user, 'D' || (1 + len(list_filter(list_sort(e)[2:len(e) - 1], lambda x: v > x))) AS decile FROM mp, edges),
top AS (SELECT l.method, l.user, l.item, l.rank FROM lists l WHERE rank <= {K_FINAL}),
nov AS (SELECT item, -log2((pop + 1) / (sum(pop) OVER () + count(*) OVER ())) AS v FROM it),
ild AS (SELECT a.method, a.user, avg(1 - list_inner_product(x.v, y.v)) AS v FROM top a JOIN top b ON a.method = b.method AND a.user = b.user AND a.rank < b.rank JOIN it x ON x.item = a.item JOIN it y ON y.item = b.item GROUP BY ALL),
nv AS (SELECT method, top.user, avg(v) AS v FROM top JOIN nov USING (item) GROUP BY ALL),
gap AS (SELECT a.method, a.user, 1 - count(b.item) / (count(*) + {K_FINAL} - count(b.item)) AS v FROM top a LEFT JOIN (SELECT * FROM top WHERE method = 'popularity_train') b ON b.user = a.user AND b.item = a.item GROUP BY ALL),
who AS (SELECT seg.user, CASE WHEN n_eval_targets > 0 THEN slice END AS slice, CASE WHEN n_eval_targets > 0 THEN bucket END AS bucket, decile, 'all' AS whole FROM seg LEFT JOIN dec ON dec.user = seg.user)"""


def guards(by: str) -> str:
    """CTEs g (method, by, ild, coverage, novelty, gap_vs_reference) of a column of ``who``."""
    per = lambda t: f"SELECT {t}.method, who.{by}, avg({t}.v) AS v FROM {t} JOIN who ON who.user = {t}.user GROUP BY ALL"
    return f"""g AS (SELECT i.method, i.{by}, i.v AS ild, c.v AS coverage, n.v AS novelty, p.v AS gap_vs_reference FROM ({per('ild')}) i JOIN ({per('nv')}) n USING (method, {by}) JOIN ({per('gap')}) p USING (method, {by})
  JOIN (SELECT top.method, who.{by}, count(DISTINCT item) / (SELECT count(*) FROM it)::DOUBLE AS v FROM top JOIN who ON who.user = top.user GROUP BY ALL) c USING (method, {by}))"""
