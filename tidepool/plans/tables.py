"""The driver's tables in the roles of the engine's: interactions, texts, vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def events(spark: SparkSession, d: str) -> DataFrame:
    """Interactions: event_id, user_id, ts (epoch seconds), event_type, value, k (item), flag (value >= 30)."""
    e = table(spark, d, "events")
    return e.select("event_id", "user_id", F.unix_timestamp("ts").alias("ts"), "event_type", "value", F.get_json_object("props", "$.k").cast("long").alias("k"), (F.col("value") >= 30).cast("int").alias("flag"))


EV = "ev AS (SELECT event_id, user_id, floor(epoch(ts))::BIGINT AS ts, event_type, value, json_extract_string(props, '$.k')::BIGINT AS k, (value >= 30)::INT AS flag FROM events)"


def purchases(spark: SparkSession, d: str) -> DataFrame:
    """Line items with their customer and date: user, item, ts, votes (quantity), flag (returned or not), id."""
    li, o = table(spark, d, "lineitem"), table(spark, d, "orders")
    j = li.join(o, li.l_orderkey == o.o_orderkey)
    return j.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("o_custkey").alias("user"), F.col("l_partkey").alias("item"), F.unix_timestamp("o_orderdate").alias("ts"), F.col("l_quantity").alias("votes"), (F.col("l_returnflag") != "R").cast("int").alias("flag"))


PU = "pu AS (SELECT l_orderkey * 10 + l_linenumber AS id, o_custkey AS user, l_partkey AS item, floor(epoch(o_orderdate))::BIGINT AS ts, l_quantity AS votes, (l_returnflag <> 'R')::INT AS flag FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"


#: A uniform number from the md5 in m.
UNIFORM = "(('0x' || substr(m, 7, 2) || substr(m, 5, 2) || substr(m, 3, 2) || substr(m, 1, 2))::UBIGINT / 4294967296.0)"

#: id, user, split of purchases by support_aware_user_temporal.
SUPPORT_SPLIT = f"""WITH {PU}, r AS (SELECT *, count(*) OVER (PARTITION BY user) AS n, row_number() OVER (PARTITION BY user ORDER BY ts DESC, id DESC) AS nth,
  md5('2026|support-aware-main|' || user) AS m, md5('2026|support-aware-eval|' || user) AS e FROM pu),
u AS (SELECT *, {UNIFORM} AS um, {UNIFORM.replace('(m,', '(e,')} < 0.15 / (0.15 + (1.0 - 0.7 - 0.15)) AS to_val FROM r),
k AS (SELECT *, CASE WHEN n = 2 THEN 1 ELSE least(n - 1, greatest(2, round_even(n * CASE WHEN to_val THEN 0.15::DOUBLE ELSE (1.0::DOUBLE - 0.7::DOUBLE - 0.15::DOUBLE) END, 0)::BIGINT)) END AS n_eval FROM u)
SELECT id, user, CASE WHEN n = 1 THEN CASE WHEN um < 0.7 THEN 'train' WHEN um < 0.7 + 0.15 THEN 'val' ELSE 'test' END WHEN nth <= n_eval THEN CASE WHEN to_val THEN 'val' ELSE 'test' END ELSE 'train' END AS split FROM k"""

def catalog(spark: SparkSession, d: str) -> DataFrame:
    """Items (labels of embeddings) with their mean vector at length one: item, vector."""
    from tidepool.operators.pooling import pool_vectors

    return pool_vectors(table(spark, d, "embeddings").withColumn("item", F.col("label").cast("long")), ["item"], "embedding")


#: SQL for the same: long form of pooled vectors (item, i, x).
CATALOG = """
dims AS (SELECT label::BIGINT AS item, vec_id, unnest(range(1, len(embedding) + 1)) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings),
means AS (SELECT item, i, avg(x) AS x FROM dims GROUP BY item, i),
norms AS (SELECT item, sqrt(sum(x * x)) AS n FROM means GROUP BY item),
cat AS (SELECT item, i, x / n AS x FROM means JOIN norms USING (item)),
qn AS (SELECT vec_id, sqrt(sum(x * x)) AS n FROM dims GROUP BY vec_id),
scores AS (
  SELECT d.vec_id, c.item, sum(d.x / qn.n * c.x) AS score
  FROM dims d JOIN qn USING (vec_id) JOIN cat c ON c.i = d.i WHERE c.item <> d.item GROUP BY d.vec_id, c.item),
pop AS (SELECT cat.item, greatest(count(*) FILTER (l.doc_id IS NOT NULL), 1e-6)::DOUBLE AS pop
  FROM (SELECT DISTINCT item FROM cat) cat LEFT JOIN labels l ON l.doc_id % 10 = cat.item GROUP BY cat.item),
pool AS (
  SELECT vec_id, s.item, score, pop, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, s.item) AS rank
  FROM scores s JOIN pop USING (item) QUALIFY rank <= 8)"""
