"""Queries over catalogues, taxonomies, cohorts, chunks and generated texts, each with the same in SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidepool.functions import text as T
from tidepool.functions.prompts import batch_encoder, explanation_prompt
from tidepool.operators import catalog as C
from tidepool.operators import cohorts as H
from tidepool.plans.tables import EV, events, table

Q, SQL = {}, {}


def query(sql: str | None = None):
    def put(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def _orders_parts(spark, d):
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list("l_partkey")).alias("ids"))


@query("WITH x AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_linenumber) AS i, p_brand FROM lineitem JOIN part ON l_partkey = p_partkey AND p_size > 10) SELECT l_orderkey, count(p_brand)::INT AS n, string_agg(p_brand, ',' ORDER BY i) AS names FROM (SELECT DISTINCT l_orderkey FROM lineitem) LEFT JOIN x USING (l_orderkey) GROUP BY l_orderkey")
def resolve_ids(spark, d):
    lookup = table(spark, d, "part").where("p_size > 10").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("name"))
    got = C.resolve(_orders_parts(spark, d), "l_orderkey", "ids", lookup, "name", "names")
    return got.select("l_orderkey", F.size("names").alias("n"), F.nullif(F.concat_ws(",", "names"), F.lit("")).alias("names"))


@query("SELECT DISTINCT l_partkey AS id FROM lineitem")
def unique_fk_ids(spark, d):
    return C.unique_ids(_orders_parts(spark, d), "ids")


@query("SELECT n_nationkey::BIGINT AS id, coalesce(n_name, '') AS name FROM nation")
def lookup_table(spark, d):
    n = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"))
    return C.lookup_table(n.union(n))


_CATALOG = "cat AS (SELECT p_partkey AS app_id, p_name AS app_name, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')) AS title_norm FROM part)"
_MATCH = f"""WITH {_CATALOG}, ext AS (SELECT p_partkey AS app_id, p_partkey + 100000 AS match_id FROM part WHERE p_partkey % 5 = 0),
titles AS (SELECT trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')) AS title_norm, p_partkey + 500000 AS match_id, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS hit FROM part WHERE p_size < 20 QUALIFY hit <= 8),
two AS (SELECT app_id, min_by(match_id, hit) AS match_id FROM cat JOIN titles USING (title_norm) WHERE app_id NOT IN (SELECT app_id FROM ext) GROUP BY app_id),
m AS (SELECT app_id, match_id, 'external_id' AS join_method FROM ext UNION ALL SELECT app_id, match_id, 'title_exact' FROM two)"""


def _matches(spark, d):
    p = table(spark, d, "part")
    cat = C.load_catalog(p, "p_partkey", "p_name")
    ext = p.where("p_partkey % 5 = 0").select(F.col("p_partkey").alias("app_id"), (F.col("p_partkey") + 100000).alias("match_id"))
    from pyspark.sql import Window

    hit = F.row_number().over(Window.partitionBy("p_name").orderBy("p_partkey"))
    titles = p.where("p_size < 20").select(T.normalized_title(F.col("p_name")).alias("title_norm"), (F.col("p_partkey") + 500000).alias("match_id"), hit.alias("hit"))
    return cat, C.match_waterfall(cat, ext, titles)


@query(f"{_MATCH} SELECT * FROM m")
def match_waterfall(spark, d):
    return _matches(spark, d)[1]


@query(f"{_MATCH} SELECT m.app_id, m.match_id, join_method, app_name, p.p_brand AS match_name FROM m JOIN cat USING (app_id) LEFT JOIN part p ON p.p_partkey = m.match_id - 100000")
def joined_details(spark, d):
    cat, m = _matches(spark, d)
    details = table(spark, d, "part").select((F.col("p_partkey") + 100000).alias("id"), F.col("p_brand").alias("name"))
    return C.joined_details(m, cat, details).select("app_id", "match_id", "join_method", "app_name", "match_name")


@query(f"{_MATCH} SELECT app_id, match_id, join_method FROM m WHERE app_id <> 10 UNION ALL SELECT 10, -10, 'manual_mock' UNION ALL SELECT app_id, -app_id, 'manual_mock' FROM cat WHERE app_id IN (1, 2, 3, 4) AND app_id NOT IN (SELECT app_id FROM m)")
def mock_upsert(spark, d):
    cat, m = _matches(spark, d)
    mocks = spark.createDataFrame([(10, True), (1, False), (2, False), (3, False), (4, False)], "app_id long, override boolean")
    return C.upsert_mocks(m, mocks, cat).select("app_id", "match_id", "join_method")


@query(f"{_MATCH} SELECT (SELECT count(*) FROM cat) AS n_items, count(*) AS n_matched, avg((length(trim(p_type)) > 0)::INT)::DOUBLE AS coverage_p_type, count(*) / (SELECT count(*) FROM cat)::DOUBLE AS match_rate FROM m JOIN part ON p_partkey = app_id")
def join_report(spark, d):
    cat, m = _matches(spark, d)
    j = m.join(table(spark, d, "part").withColumnRenamed("p_partkey", "app_id"), "app_id")
    return C.join_report(cat, j, ["p_type"])


@query("SELECT p_partkey, concat_ws(chr(10) || chr(10), p_name, p_type, p_brand) AS candidate_text FROM part")
def candidate_text(spark, d):
    return C.candidate_text(table(spark, d, "part"), "p_name", "p_type", "p_brand").select("p_partkey", "candidate_text")


@query("SELECT doc_id, substr(regexp_replace(regexp_replace(text, '^\\s+', ''), '\\s+$', ''), 1, 100) AS clip FROM documents")
def text_clip(spark, d):
    return table(spark, d, "documents").select("doc_id", T.clipped(F.col("text"), 100).alias("clip"))


@query("""WITH r AS (SELECT source AS app_id, doc_id AS review_id, text, n_chars AS votes FROM documents WHERE length(regexp_replace(regexp_replace(text, '^\\s+', ''), '\\s+$', '')) >= 30 QUALIFY row_number() OVER (PARTITION BY source ORDER BY n_chars DESC NULLS LAST, doc_id) <= 3),
s AS (SELECT source AS app_id, min(lang) || chr(10) || chr(10) || source AS text FROM documents GROUP BY source)
SELECT app_id, 'review' AS chunk_type, review_id, length(text)::INT AS text_len FROM r UNION ALL SELECT app_id, 'description', NULL, length(text)::INT FROM s""")
def chunk_table(spark, d):
    doc = table(spark, d, "documents")
    r = C.review_chunks(doc.withColumn("app_id", F.col("source")), "app_id", "text", "n_chars", "doc_id", 3)
    r = r.select("app_id", F.col("source").alias("app_name"), F.col("doc_id").alias("review_id"), "text", F.col("n_chars").alias("votes_helpful"), F.lit(1).alias("recommended"))
    s = doc.groupBy(F.col("source").alias("app_id")).agg(F.min("lang").alias("summary")).withColumn("storyline", F.col("app_id"))
    names = doc.select(F.col("source").alias("app_id"), F.col("source").alias("app_name")).distinct()
    return C.chunk_table(r, s, names).select("app_id", "chunk_type", "review_id", "text_len")


@query("SELECT DISTINCT unnest([p_brand, p_type]) AS tag FROM part")
def tag_vocabulary(spark, d):
    return C.tag_vocabulary(table(spark, d, "part").withColumn("tags", F.array("p_brand", "p_type")), ["tags"])


# -- cohorts and examples --------------------------------------------------------------

_COHORT = f"""WITH {EV}, q AS (SELECT * FROM ev WHERE event_id % 10 = 0), t AS (SELECT * FROM ev WHERE event_id % 10 <> 0),
ta AS (SELECT user_id, count(*) AS n_train_support, count(*) FILTER (flag = 1) AS n_train_pos_support FROM t GROUP BY user_id),
vp AS (SELECT user_id, count(*) AS n_val_pos_rows, count(DISTINCT k) AS n_val_pos_apps FROM q WHERE flag = 1 GROUP BY user_id),
r AS (SELECT q.event_id, q.user_id, q.k, q.ts, coalesce(n_train_support, 0) AS n_train_support, coalesce(n_train_pos_support, 0) AS n_train_pos_support, n_val_pos_rows, n_val_pos_apps,
  CASE WHEN n_val_pos_apps >= 2 THEN 'val_multi_pos_eval' ELSE 'val_single_pos_eval' END AS eval_pos_cohort,
  CASE WHEN coalesce(n_train_pos_support, 0) >= 2 THEN 'val_multi_pos_train' WHEN n_train_pos_support = 1 THEN 'val_pos_train' WHEN n_train_support >= 1 THEN 'val_train' ELSE 'val_no_train' END AS cohort
  FROM q LEFT JOIN ta USING (user_id) JOIN vp USING (user_id) WHERE q.flag = 1)"""


def _halves(spark, d):
    e = events(spark, d)
    return e.where("event_id % 10 = 0"), e.where("event_id % 10 <> 0")


@query(f"{_COHORT} SELECT event_id, user_id, k, cohort, eval_pos_cohort, n_train_support, n_train_pos_support, n_val_pos_rows, n_val_pos_apps FROM r")
def eval_records(spark, d):
    q, t = _halves(spark, d)
    return H.eval_records(q, t, "user_id", "k", "flag").select("event_id", "user_id", "k", "cohort", "eval_pos_cohort", "n_train_support", "n_train_pos_support", "n_val_pos_rows", "n_val_pos_apps")


@query(f"""{_COHORT}, ex AS (SELECT r.event_id, r.user_id, r.k, list_sort(list(DISTINCT v.k)) AS pos FROM r JOIN q v ON v.user_id = r.user_id AND v.flag = 1 AND v.k <> r.k GROUP BY ALL),
s AS (SELECT ex.event_id, count(t.event_id) AS n_support FROM ex LEFT JOIN t ON t.user_id = ex.user_id AND t.flag = 1 AND t.k <> ex.k AND NOT list_contains(ex.pos, t.k) GROUP BY ex.event_id)
SELECT event_id, len(pos)::INT AS n_eval_targets, CASE WHEN len(pos) >= 2 THEN 'slice_a_multi_target' ELSE 'slice_b_single_target' END AS slice, '[' || array_to_string(pos, ',') || ']' AS positives, n_support FROM ex JOIN s USING (event_id)""")
def build_examples(spark, d):
    q, t = _halves(spark, d)
    ex = H.examples(H.eval_records(q, t, "user_id", "k", "flag"), q, "event_id", "user_id", "k", "flag")
    sup = H.support_rows(ex, t, "event_id", "user_id", "k", "flag", mode="strict").groupBy("event_id").agg(F.count(F.lit(1)).alias("n_support"))
    from tidepool.operators.metrics import slice_name

    out = ex.join(sup, "event_id", "left")
    return out.select("event_id", "n_eval_targets", slice_name(F.col("n_eval_targets")).alias("slice"), F.to_json("positives").alias("positives"), F.coalesce("n_support", F.lit(0)).alias("n_support"))


@query(f"{_COHORT}, ex AS (SELECT DISTINCT r.event_id, v.k AS positive FROM r JOIN q v ON v.user_id = r.user_id AND v.flag = 1 AND v.k <> r.k) SELECT event_id AS group_id, positive FROM ex WHERE positive IN (SELECT k FROM t WHERE flag = 1)")
def contrastive_rows(spark, d):
    q, t = _halves(spark, d)
    ex = H.examples(H.eval_records(q, t, "user_id", "k", "flag"), q, "event_id", "user_id", "k", "flag")
    items = t.where("flag = 1").select("k").distinct()
    return H.contrastive_rows(ex, items, "event_id", "k").select("group_id", "positive")


@query(f"{_COHORT}, k AS (SELECT event_id, cohort, eval_pos_cohort, (('0x' || substr(m, 7, 2) || substr(m, 5, 2) || substr(m, 3, 2) || substr(m, 1, 2))::UBIGINT / 4294967296.0) AS u FROM (SELECT *, md5('2026|support|' || event_id) AS m FROM r)) SELECT event_id, user_id, n_kept FROM (SELECT r.event_id, r.user_id, count(*) OVER (PARTITION BY r.user_id) AS n_kept FROM r JOIN k USING (event_id) QUALIFY row_number() OVER (PARTITION BY r.user_id ORDER BY u, r.event_id) <= 2)")
def support_cap(spark, d):
    q, t = _halves(spark, d)
    r = H.eval_records(q, t, "user_id", "k", "flag")
    from pyspark.sql import Window

    r = r.withColumn("n_kept", F.count(F.lit(1)).over(Window.partitionBy("user_id")))
    return H.cap_support(r, "user_id", "event_id", 2).select("event_id", "user_id", "n_kept")


# -- generated texts -------------------------------------------------------------------

_STOP = ", ".join("'" + w.replace("'", "''") + "'" for w in T.STOPWORDS)
_CONTENT = lambda x: f"list_distinct(list_filter(regexp_extract_all(lower({x}), '[a-z0-9'']+'), lambda w: length(w) >= 4 AND w NOT IN ({_STOP})))"


@query(f"WITH p AS (SELECT a.doc_id, {_CONTENT('a.text')} AS x, regexp_extract_all(lower(b.text), '[a-z0-9'']+') AS y FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1) SELECT doc_id, round(CASE WHEN len(x) = 0 THEN 1.0 ELSE len(list_intersect(x, y)) / len(x)::DOUBLE END, 6) AS overlap FROM p")
def overlap_ratio(spark, d):
    doc = table(spark, d, "documents").select("doc_id", "text")
    b = doc.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("other"))
    return doc.join(b, "doc_id").select("doc_id", F.round(T.overlap_ratio(F.col("text"), F.col("other")), 6).alias("overlap"))


@query(r"""WITH t AS (SELECT doc_id, md5(coalesce(text, '')) AS h, lower(coalesce(text, '')) AS t FROM documents), d AS (SELECT DISTINCT h, t FROM t),
c AS (SELECT h, u, count(*) AS n FROM (SELECT h, unnest(regexp_extract_all(t, '[a-z0-9'']+')) AS u FROM d) GROUP BY ALL), m AS (SELECT h, sum(n) AS n, max(n) AS most FROM c GROUP BY h)
SELECT doc_id, (regexp_full_match(t, '\s*') OR contains(t, 'i cannot') OR contains(t, 'i can''t') OR contains(t, 'i''m unable') OR contains(t, 'as an ai') OR contains(t, 'i don''t have enough information') OR coalesce(n >= 6 AND 2 * most > n, false)) AS degenerate FROM t LEFT JOIN m USING (h)""")
def degenerate_text(spark, d):
    return table(spark, d, "documents").select("doc_id", T.degenerate(F.col("text")).alias("degenerate"))


@query("SELECT p_partkey, array_to_string(list_filter(['red', 'blue', 'ring', 'widget', 'small'], lambda t: contains(' ' || trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')) || ' ', ' ' || t || ' ') AND t <> 'red'), ',') AS tags FROM part")
def ungrounded_tags(spark, d):
    vocabulary = F.array(*(F.lit(t) for t in ("red", "blue", "ring", "widget", "small")))
    return table(spark, d, "part").select("p_partkey", F.concat_ws(",", T.ungrounded(F.col("p_name"), vocabulary, F.array(F.lit("Red")))).alias("tags"))


@query("SELECT event_id, json_extract_string(props, '$.k')::INT % 7 AS relevance, json_extract_string(props, '$.k')::INT % 5 AS faithfulness FROM events WHERE json_extract_string(props, '$.k')::INT % 7 BETWEEN 1 AND 5 AND json_extract_string(props, '$.k')::INT % 5 BETWEEN 1 AND 5")
def parse_judgement(spark, d):
    e = events(spark, d)
    answer = F.concat(F.lit('```json\n{"relevance": '), (F.col("k") % 7).cast("string"), F.lit(', "faithfulness": '), (F.col("k") % 5).cast("string"), F.lit("}\n```"))
    j = e.select("event_id", T.judged(answer, ("relevance", "faithfulness")).alias("j")).where("j IS NOT NULL")
    return j.select("event_id", "j.relevance", "j.faithfulness")


@query("SELECT vec_id, '[' || (vec_id % 3) || ',' || (3 + vec_id % 4) || ']' AS ids FROM embeddings WHERE 3 + vec_id % 4 < 6 ")
def parse_ranked_ids(spark, d):
    e = table(spark, d, "embeddings").select("vec_id")
    answer = F.concat(F.lit("["), (F.col("vec_id") % 3).cast("string"), F.lit(", "), (3 + F.col("vec_id") % 4).cast("string"), F.lit("]"))
    candidates = F.array(*(F.lit(i).cast("long") for i in range(6)))
    return e.select("vec_id", F.to_json(T.ranked_ids(answer, candidates, 2)).alias("ids")).where("ids IS NOT NULL")


@query("""WITH t AS (SELECT p_partkey, substr(p_name, 1, 12) AS a, CASE WHEN p_size % 3 > 0 THEN substr(p_type, 1, 12) ELSE '' END AS b FROM part), v AS (SELECT p_partkey, [length(a), 1 + length(a) % 3, 2]::DOUBLE[] AS x, [length(b), 1 + length(b) % 3, 2]::DOUBLE[] AS y FROM t)
SELECT p_partkey, i::INT AS i, round(x[i] / sqrt(list_inner_product(x, x)), 6) AS name_x, round(y[i] / sqrt(list_inner_product(y, y)), 6) AS type_x FROM v, range(1, 4) r(i)""")
def text_vectors(spark, d):
    """Vectors of two text fields, one of them null for some items, by an encoder that takes batches."""
    part = table(spark, d, "part").select("p_partkey", "p_name", F.when(F.col("p_size") % 3 > 0, F.col("p_type")).alias("p_type"))
    encode = batch_encoder(lambda: lambda texts: [[len(t), 1 + len(t) % 3, 2] for t in texts], 100)
    got = C.with_text_vectors(part, ["p_name", "p_type"], encode, clip=12)
    x = got.select("p_partkey", "p_type_vector", F.posexplode("p_name_vector").alias("i", "name_x"))
    return x.select("p_partkey", (F.col("i") + 1).alias("i"), F.round("name_x", 6).alias("name_x"), F.round(F.col("p_type_vector")[F.col("i")], 6).alias("type_x"))


_STRIPPED = "regexp_replace(regexp_replace({0}, '^\\s+', ''), '\\s+$', '')"


@query(f"""WITH x AS (SELECT d.doc_id, substr({_STRIPPED.format('d.text')}, 1, 200) AS q, p_name || ', ' || p_type AS c FROM documents d JOIN part ON p_partkey = d.doc_id % 100 + 1)
SELECT doc_id, md5('A player writes:' || chr(10) || q || chr(10) || chr(10) || 'Recommended:' || chr(10) || c || chr(10) || chr(10) || 'In two sentences, and from these texts alone, say why it fits.') AS prompt FROM x""")
def explanation_prompts(spark, d):
    """Prompts with whole documents as queries, clipped."""
    part = table(spark, d, "part").select(F.col("p_partkey").alias("k"), F.concat_ws(", ", "p_name", "p_type").alias("c"))
    docs = table(spark, d, "documents").select("doc_id", "text", (F.col("doc_id") % 100 + 1).alias("k")).join(part, "k")
    return docs.select("doc_id", F.md5(explanation_prompt(F.col("text"), F.col("c"), 200)).alias("prompt"))
