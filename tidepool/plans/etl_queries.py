"""Queries over cleaning, features, splits, windows and reports, each with the same in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidepool.functions import text as T
from tidepool.functions.hashing import stable_uniform
from tidepool.operators import catalog as C
from tidepool.operators import reports as R
from tidepool.operators import reviews as V
from tidepool.operators import splits as S
from tidepool.operators import windows as W
from tidepool.plans.tables import EV, PU, SUPPORT_SPLIT, UNIFORM, events, purchases, table

Q, SQL = {}, {}


def query(sql: str | None = None):
    def put(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


STRIP = r"regexp_replace(regexp_replace({0}, '^\s+', ''), '\s+$', '')"


@query(f"SELECT doc_id, lang, source FROM documents WHERE n_chars < 4000 AND lang = 'en' AND length({STRIP.format('text')}) >= 40 AND n_chars >= 0 AND source IS NOT NULL")
def filter_rows(spark, d):
    df = table(spark, d, "documents")
    df = V.drop_vote_sentinels(df, ["n_chars"], 4000)
    df = V.drop_short_text(V.where_language(df, "en", "lang"), "text", 40)
    return V.drop_null(V.drop_negative(df, ["n_chars"]), ["source"]).select("doc_id", "lang", "source")


@query("SELECT text, min(doc_id) AS doc_id FROM documents GROUP BY text")
def keep_first_text(spark, d):
    return V.keep_first(table(spark, d, "documents"), "text", ["doc_id"]).select("text", "doc_id")


@query("SELECT event_id, user_id, coalesce(value, 0.0) AS value, (value >= 30)::INT AS is_high FROM events")
def project_features(spark, d):
    df = table(spark, d, "events").withColumn("is_high", F.col("value") >= 30)
    return V.flags_to_int(df, ["is_high"]).select("event_id", "user_id", F.coalesce("value", F.lit(0.0)).alias("value"), "is_high")


@query(r"SELECT doc_id, len(list_filter(string_split_regex(text, '\s+'), lambda w: w <> ''))::INT AS review_word_count, length(text)::INT AS review_length_chars FROM documents")
def text_counts(spark, d):
    return V.with_text_counts(table(spark, d, "documents"), "text").select("doc_id", "review_word_count", "review_length_chars")


@query("SELECT p_partkey, trim(regexp_replace(lower(p_name || ' - ' || p_brand), '[^a-z0-9]+', ' ', 'g')) AS title FROM part")
def title_normalize(spark, d):
    return table(spark, d, "part").select("p_partkey", T.normalized_title(F.concat_ws(" - ", "p_name", "p_brand")).alias("title"))


@query("SELECT p_partkey AS app_id, p_name AS app_name, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')) AS title_norm FROM part")
def catalog_load(spark, d):
    return C.load_catalog(table(spark, d, "part"), "p_partkey", "p_name")


@query("SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'red') ORDER BY p_name, p_partkey LIMIT 20")
def title_search(spark, d):
    return R.search(table(spark, d, "part").select("p_partkey", "p_name"), "p_name", "p_partkey", "RED", 20)


_U = UNIFORM


@query(f"SELECT event_id, {_U} AS u FROM (SELECT event_id, md5('2026|g|' || event_id) AS m FROM events)")
def hash_uniform(spark, d):
    return table(spark, d, "events").select("event_id", stable_uniform(2026, "g", F.col("event_id")).alias("u"))


@query(f"WITH h AS (SELECT doc_id, md5('2026|' || lang || '|' || source || '|' || doc_id) AS m FROM documents) SELECT doc_id, CASE WHEN {_U} < 0.7 THEN 'train' WHEN {_U} < 0.7 + 0.15 THEN 'val' ELSE 'test' END AS split FROM h")
def split_random(spark, d):
    df = table(spark, d, "documents")
    return S.split_random(df, "doc_id", T.stratify_key(F.col("lang"), F.col("source"))).select("doc_id", "split")


@query(f"""WITH {PU}, r AS (SELECT *, count(*) OVER (PARTITION BY user) AS n, row_number() OVER (PARTITION BY user ORDER BY ts DESC, id DESC) AS nth, md5('2026|' || flag || '|' || id) AS m FROM pu)
SELECT id, user, CASE WHEN n < 3 THEN CASE WHEN {_U} < 0.7 THEN 'train' WHEN {_U} < 0.7 + 0.15 THEN 'val' ELSE 'test' END WHEN nth <= 2 THEN 'test' WHEN nth <= 5 THEN 'val' ELSE 'train' END AS split FROM r""")
def split_user_temporal(spark, d):
    df = purchases(spark, d)
    return S.split_user_temporal(df, "user", "ts", "id", F.col("flag").cast("string"), n_val=3, n_test=2).select("id", "user", "split")


@query(SUPPORT_SPLIT)
def split_support_aware(spark, d):
    return S.split_support_aware(purchases(spark, d), "user", "ts", "id").select("id", "user", "split")


@query(f"WITH s AS ({SUPPORT_SPLIT}) SELECT split, count(*) AS n, count(DISTINCT user) AS n_users FROM s GROUP BY split")
def split_counts(spark, d):
    return split_support_aware(spark, d).groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user").alias("n_users"))


@query(f"WITH s AS ({SUPPORT_SPLIT}), {PU}, t AS (SELECT s.*, pu.ts FROM s JOIN pu USING (id)), p AS (SELECT user, max(ts) FILTER (split = 'train') AS train_max, min(ts) FILTER (split <> 'train') AS eval_min FROM t GROUP BY user) SELECT * FROM p WHERE train_max > eval_min")
def temporal_violations(spark, d):
    df = S.split_support_aware(purchases(spark, d), "user", "ts", "id")
    return R.temporal_violations(df, "user", "ts")


@query(f"WITH {EV}, r AS (SELECT max(ts) AS ref FROM ev WHERE user_id % 3 = 0) SELECT event_id, greatest(0, ref - ts) AS age FROM ev, r")
def review_age(spark, d):
    e = events(spark, d)
    ref = V.max_train_timestamp(e.withColumn("split", F.when(F.col("user_id") % 3 == 0, "train").otherwise("val")), "ts")
    return e.select("event_id", V.review_age(F.col("ts"), F.lit(ref)).alias("age"))


@query("WITH c AS (SELECT quantile_cont(greatest(coalesce(value, 0), 0), 0.99) AS cap FROM events) SELECT event_id, round(ln(1 + least(greatest(coalesce(value, 0), 0), cap)), 9) AS norm_value FROM events, c")
def normalize_capped(spark, d):
    e = table(spark, d, "events")
    params = V.fit_caps(e, {"value": "cap_log1p"})
    return V.with_normalized(e, params).select("event_id", F.round("_norm_value", 9).alias("norm_value"))


@query("SELECT event_id, round(least(greatest(exp(ln(1 + value)) - 1, 0), 100.0), 6) AS value FROM events")
def normalize_inverse(spark, d):
    e = table(spark, d, "events")
    return e.select("event_id", F.round(V.denormalized(V.normalized(F.col("value")), 100.0), 6).alias("value"))


# -- windows -----------------------------------------------------------------------


@query(f"WITH {PU} SELECT id, item FROM pu QUALIFY row_number() OVER (PARTITION BY item ORDER BY votes DESC NULLS LAST, id) <= 5")
def cap_by_votes(spark, d):
    return C.review_chunks(purchases(spark, d).withColumn("text", F.lit("x" * 40)), "item", "text", "votes", "id", 5).select("id", "item")


@query("SELECT doc_id, source, length(text)::INT AS review_len FROM documents WHERE lang = 'en' AND length(" + STRIP.format("text") + ") >= 30 QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) <= 20")
def cap_profiles(spark, d):
    df = table(spark, d, "documents").withColumn("ok", (F.col("lang") == "en").cast("int"))
    return C.profile_reviews(df, "source", "text", "ok", "doc_id", 20).select("doc_id", "source", "review_len")


@query(f"WITH {EV} SELECT event_id, user_id FROM ev QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 3")
def latest_per_user(spark, d):
    return W.cap_per_group(events(spark, d), "user_id", [F.desc("ts"), F.desc("event_id")], 3).select("event_id", "user_id")


@query(f"""WITH {EV} SELECT event_id, count(*) OVER w AS prior_n, coalesce(sum(flag) OVER w, 0)::BIGINT AS prior_pos,
  round(CASE WHEN count(*) OVER w > 0 THEN sum(flag) OVER w / count(*) OVER w ELSE 0.0 END, 9) AS prior_rate, coalesce(ts - max(ts) OVER w, -1) AS prior_since
FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def prior_user(spark, d):
    p = W.prior_aggregates(events(spark, d), "user_id", "ts", "flag")
    return p.select("event_id", "prior_n", "prior_pos", F.round("prior_rate", 9).alias("prior_rate"), "prior_since")


@query(f"""WITH {EV} SELECT event_id, count(*) OVER w AS item_n, coalesce(sum(flag) OVER w, 0)::BIGINT AS item_pos
FROM ev WINDOW w AS (PARTITION BY k ORDER BY ts RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def prior_item(spark, d):
    return W.prior_aggregates(events(spark, d), "k", "ts", "flag", "item").select("event_id", "item_n", "item_pos")


@query(f"WITH {EV} SELECT event_id, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1)::INT AS position, count(*) OVER (PARTITION BY user_id) AS group_size FROM ev")
def position_in_group(spark, d):
    return W.with_position(events(spark, d), "user_id", [F.col("ts"), F.col("event_id")]).select("event_id", "position", "group_size")


@query(f"""WITH {EV} SELECT event_id, (row_number() OVER w - 1)::INT AS n_before, count(*) OVER (PARTITION BY user_id) - row_number() OVER w AS n_after,
  lag(event_id) OVER w AS previous_id, lead(event_id) OVER w AS next_id FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def causal_anchors(spark, d):
    return W.causal_anchors(events(spark, d), "user_id", "ts", "event_id").select("event_id", "n_before", "n_after", "previous_id", "next_id")


@query(f"WITH {EV}, q AS (SELECT event_id AS query_id, user_id, ts AS query_ts FROM ev WHERE event_type = 'purchase') SELECT query_id, count(*) AS n, sum(flag)::BIGINT AS n_pos FROM q JOIN ev USING (user_id) WHERE ts > query_ts - 86400 AND ts <= query_ts GROUP BY query_id")
def history_window(spark, d):
    e = events(spark, d)
    q = e.where("event_type = 'purchase'").select(F.col("event_id").alias("query_id"), "user_id", "ts")
    return W.within_history(e, q, "user_id", "ts", 86400).groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.sum("flag").alias("n_pos"))


@query("""WITH e AS (SELECT list_transform(range(0, 11), lambda i: (SELECT 0)) AS z), q AS (SELECT quantile_cont(value, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]) AS e FROM events)
SELECT event_id, 'D' || (1 + (value > e[2])::INT + (value > e[3])::INT + (value > e[4])::INT + (value > e[5])::INT + (value > e[6])::INT + (value > e[7])::INT + (value > e[8])::INT + (value > e[9])::INT + (value > e[10])::INT) AS decile FROM events, q""")
def decile_bins(spark, d):
    return W.deciles(table(spark, d, "events"), "value").select("event_id", "decile")


@query("SELECT event_id, rank() OVER (ORDER BY value) + (count(*) OVER (PARTITION BY value) - 1) / 2.0::DOUBLE AS avg_rank FROM events")
def average_ranks(spark, d):
    return W.with_average_rank(table(spark, d, "events"), "value", "avg_rank").select("event_id", "avg_rank")


# -- reports -----------------------------------------------------------------------


@query("SELECT 'user_id' AS \"column\", avg((user_id IS NULL)::INT)::DOUBLE AS missing, count(DISTINCT user_id) AS n_unique FROM events UNION ALL SELECT 'event_type', avg((event_type IS NULL)::INT)::DOUBLE, count(DISTINCT event_type) FROM events UNION ALL SELECT 'value', avg((value IS NULL)::INT)::DOUBLE, count(DISTINCT value) FROM events")
def missing_report(spark, d):
    return R.missing_report(table(spark, d, "events"), ["user_id", "event_type", "value"])


@query("SELECT event_type AS value, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 9)::DOUBLE AS share FROM events GROUP BY event_type")
def value_counts(spark, d):
    return R.value_counts(table(spark, d, "events"), "event_type").withColumn("share", F.round("share", 9))


@query("SELECT text, count(*) AS n FROM documents GROUP BY text HAVING count(*) > 1")
def duplicate_keys(spark, d):
    return R.duplicate_keys(table(spark, d, "documents"), "text")


@query("WITH g AS (SELECT text, count(DISTINCT lang) + max((lang IS NULL)::INT) AS a, count(DISTINCT source) + max((source IS NULL)::INT) AS b FROM documents GROUP BY text HAVING count(*) > 1) SELECT 'lang' AS \"column\", count(*) FILTER (a > 1) AS n_keys FROM g UNION ALL SELECT 'source', count(*) FILTER (b > 1) FROM g")
def differing_columns(spark, d):
    return R.differing_columns(table(spark, d, "documents"), "text", ["lang", "source"])


@query(f"WITH {EV} SELECT k, count(*) AS n, round(avg(flag), 9) AS rate FROM ev GROUP BY k ORDER BY n DESC, k LIMIT 20")
def group_rates(spark, d):
    return R.group_rates(events(spark, d), "k", "flag").withColumn("rate", F.round("rate", 9))


@query("SELECT event_type, min(event_id) AS first_index, max(event_id) AS last_index FROM events GROUP BY event_type")
def index_range(spark, d):
    return R.index_range(table(spark, d, "events"), "event_type", "event_id")


@query("SELECT event_type, round(quantile_cont(value, 0.25), 9) AS q0, round(quantile_cont(value, 0.5), 9) AS q1, round(quantile_cont(value, 0.75), 9) AS q2 FROM events GROUP BY event_type")
def group_quantiles(spark, d):
    q = R.group_quantiles(table(spark, d, "events"), ["event_type"], "value")
    return q.select("event_type", *(F.round(f"q{i}", 9).alias(f"q{i}") for i in range(3)))


@query("SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, min(value) AS min, round(quantile_cont(value, 0.25), 6) AS q25, round(quantile_cont(value, 0.5), 6) AS q50, round(quantile_cont(value, 0.75), 6) AS q75, max(value) AS max FROM events GROUP BY event_type")
def describe_groups(spark, d):
    x = R.describe(table(spark, d, "events"), "value", ["event_type"])
    return x.select("event_type", "n", *(F.round(c, 6).alias(c) for c in ("mean", "std")), "min", *(F.round(c, 6).alias(c) for c in ("q25", "q50", "q75")), "max")


@query("WITH s AS (SELECT avg(o_totalprice) AS m, stddev_samp(o_totalprice) AS s FROM orders) SELECT 'o_totalprice' AS \"column\", avg((abs(o_totalprice - m) > 1.5 * s)::INT) AS outlier_share FROM orders, s")
def outlier_share(spark, d):
    return R.outlier_share(table(spark, d, "orders"), ["o_totalprice"], 1.5)


@query("SELECT lang, source, count(*) AS n FROM documents GROUP BY lang, source ORDER BY n DESC, lang, source LIMIT 10")
def largest_strata(spark, d):
    return R.strata(table(spark, d, "documents"), ["lang", "source"])


_MIX = f"WITH {EV}, m AS (SELECT user_id, count(*) AS n, count(DISTINCT k) AS n_items, count(*) FILTER (flag = 1) AS n_pos, count(*) FILTER (flag = 0) AS n_neg FROM ev WHERE event_id % 20 = 0 GROUP BY user_id), x AS (SELECT *, CASE WHEN n_neg = 0 THEN 'all_pos' WHEN n_pos = 0 THEN 'all_neg' ELSE 'mixed' END AS mix FROM m)"


@query(_MIX.replace("WHERE event_id % 20 = 0 ", "") + " SELECT * FROM x")
def user_mix(spark, d):
    return R.user_mix(events(spark, d), "user_id", "k", "flag")


@query(_MIX.replace("WHERE event_id % 20 = 0 ", "") + " SELECT mix, count(*) AS n_users, median(n)::DOUBLE AS median_n, count(*) / sum(count(*)) OVER ()::DOUBLE AS share FROM x GROUP BY mix")
def mix_summary(spark, d):
    return R.mix_summary(user_mix(spark, d))


@query(f"WITH s AS ({SUPPORT_SPLIT}), a AS (SELECT DISTINCT user FROM s WHERE split = 'train'), b AS (SELECT DISTINCT user FROM s WHERE split = 'val'), c AS (SELECT a.user AS x, b.user AS y FROM a FULL JOIN b USING (user)) SELECT count(x) AS n_a, count(y) AS n_b, count(*) FILTER (x IS NOT NULL AND y IS NOT NULL) AS n_both, count(*) AS n_any, count(*) FILTER (x IS NOT NULL AND y IS NOT NULL) / count(*)::DOUBLE AS share FROM c")
def split_overlap(spark, d):
    s = split_support_aware(spark, d)
    return R.overlap(s.where("split = 'train'"), s.where("split = 'val'"), "user")


@query("SELECT source, substr(source || '. ' || text, 1, 800) AS text FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY length(text) DESC, doc_id) = 1")
def longest_text(spark, d):
    df = table(spark, d, "documents").withColumn("name", F.col("source"))
    return R.longest_text(df, "source", "name", "text", "doc_id")


@query("SELECT 'url' AS \"column\", avg((length(trim(url)) > 0)::INT) AS coverage FROM pages UNION ALL SELECT 'html', avg((length(trim(html)) > 0)::INT) FROM pages")
def field_coverage(spark, d):
    return R.populated_rates(table(spark, d, "pages"), ["url", "html"])


@query("SELECT doc_id, 'quality' AS feature, quality AS value FROM labels UNION ALL SELECT doc_id, 'toxic', toxic FROM labels")
def melt_labels(spark, d):
    return R.melt(table(spark, d, "labels"), ["doc_id"], ["quality", "toxic"])


# -- samples: sizes and determinism -------------------------------------------------


@query(f"SELECT doc_id FROM (SELECT doc_id, {_U} AS u FROM (SELECT doc_id, md5('2026|sample|' || doc_id) AS m FROM documents)) ORDER BY u, doc_id LIMIT 50")
def sample_rows(spark, d):
    return S.sample_rows(table(spark, d, "documents").select("doc_id"), "doc_id", 50)


@query(f"SELECT doc_id, source FROM (SELECT doc_id, source, {_U} AS u FROM (SELECT doc_id, source, md5('2026|sample|' || doc_id) AS m FROM documents)) QUALIFY row_number() OVER (PARTITION BY source ORDER BY u, doc_id) <= 3")
def sample_per_group(spark, d):
    return S.sample_per_group(table(spark, d, "documents").select("doc_id", "source"), ["source"], "doc_id", 3)


@query(f"""WITH h AS (SELECT doc_id, lang, {_U} AS u FROM (SELECT doc_id, lang, md5('2026|strata|' || doc_id) AS m FROM documents)),
r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY u, doc_id) > CASE lang WHEN 'en' THEN 50 WHEN 'fr' THEN 20 WHEN 'de' THEN 20 ELSE 0 END AS over FROM h)
SELECT doc_id, lang FROM r ORDER BY over, u, doc_id LIMIT 100""")
def sample_strata(spark, d):
    shares = {("en",): 0.5, ("fr",): 0.2, ("de",): 0.2}
    return S.sample_strata(table(spark, d, "documents").select("doc_id", "lang"), ["lang"], shares, "doc_id", 100)


@query(f"SELECT doc_id FROM (SELECT doc_id, {_U} AS u FROM (SELECT doc_id, md5('2026|label|' || doc_id) AS m FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels))) ORDER BY u, doc_id LIMIT 40")
def sample_without(spark, d):
    return S.sample_without(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels"), "doc_id", 40)


@query(f"""WITH h AS (SELECT doc_id, lang, {_U} AS u FROM (SELECT doc_id, lang, md5('2026|fit|' || doc_id) AS m FROM documents))
SELECT doc_id, lang, CASE WHEN row_number() OVER (PARTITION BY lang ORDER BY u, doc_id) <= greatest(1, round_even(count(*) OVER (PARTITION BY lang) * 0.3::DOUBLE, 0)::INT) THEN 'fit' ELSE 'tune' END AS part FROM h""")
def fit_tune_split(spark, d):
    return S.fit_tune_split(table(spark, d, "documents").select("doc_id", "lang"), "lang", "doc_id", 0.3)
