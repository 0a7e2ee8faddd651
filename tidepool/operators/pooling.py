"""Item vectors from rows: mean and weighted pooling, history blends, clusters."""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepool.functions import vectors as V
from tidepool.functions.columns import named
from tidepool.sources.tables import scratch

VARIANTS = ("flat", "log_weighted", "recommended_only", "recommended_log_weighted")


def summed_mean(vector: Column, weight: Column | None = None) -> Column:
    """The (weighted) mean of vectors as one aggregate: a group is one row of sums per task before the shuffle."""
    v = array_to_vector(F.transform(vector, lambda x: F.coalesce(x.cast("double"), F.lit(0.0))))
    # the least weight leaves sums as they are, and counts vectors equally where all weights are 0
    mean = Summarizer.mean(v) if weight is None else Summarizer.mean(v, F.greatest(F.coalesce(weight.cast("double"), F.lit(0.0)), F.lit(1e-300)))
    return vector_to_array(mean)


def pool_vectors(df: DataFrame, keys: list[str], vector: str, weight: Column | None = None, normalize: bool = True, out: str = "vector") -> DataFrame:
    """The weighted mean of each key's vectors, scaled to length one; weights below 0 count as 0, and if all are 0, they count as equal.

    Vectors of a key have one length; null ones are left out, null components are 0.
    """
    w = F.lit(1.0) if weight is None else weight
    rows = df.where(named(vector).isNotNull()).select(*(named(k) for k in keys), w.alias("__w"), named(vector).alias("__v"))
    got = rows.groupBy(*keys).agg(summed_mean(F.col("__v"), None if weight is None else F.col("__w")).alias(out))
    return got.withColumn(out, V.unit(F.col(out))) if normalize else got


def pool_reviews(df: DataFrame, item: str, vector: str, votes: str, flag: str, variant: str = "flat") -> DataFrame:
    """item, vector, n_reviews_pooled, recommended_rate of one pooling variant: all or recommended rows, equal or log1p(votes) weights."""
    if variant not in VARIANTS:
        raise ValueError(f"unknown variant: {variant}")
    if variant.startswith("recommended"):
        df = df.where(named(flag) == 1)
    weight = F.log1p(F.greatest(F.coalesce(named(votes).cast("double"), F.lit(0.0)), F.lit(0.0))) if variant.endswith("log_weighted") else None
    stats = df.groupBy(item).agg(F.count(F.lit(1)).alias("n_reviews_pooled"), F.avg(named(flag)).alias("recommended_rate"))
    return pool_vectors(df, [item], vector, weight).join(stats, item)


def blend_descriptions(pooled: DataFrame, descriptions: DataFrame, item: str, weight: float) -> DataFrame:
    """Pooled vectors blended with description vectors (``description``); items without one are left out."""
    return pooled.join(descriptions.select(item, "description"), item).withColumn("vector", V.blend(F.col("vector"), F.col("description"), weight)).drop("description").withColumn("blend_weight", F.lit(float(weight)))


def blended_with_own(queries: DataFrame, descriptions: DataFrame, item: str, weight: float, out: str = "blended_vector") -> DataFrame:
    """``out``: the query's vector blended with its own item's ``description``; without one, the vector as it is."""
    own = descriptions.select(item, F.col("description").alias("__d"))
    blended = F.when(F.col("__d").isNull(), V.doubles(F.col("vector"))).otherwise(V.blend(F.col("vector"), F.col("__d"), weight))
    return queries.join(own, item, "left").withColumn(out, blended).drop("__d")


def time_decayed(df: DataFrame, keys: list[str], vector: str, age: Column, tau: float) -> DataFrame:
    """Pooling with weights exp(-age / tau)."""
    return pool_vectors(df, keys, vector, F.exp(-age / F.lit(float(tau))))


def history_blend(queries: DataFrame, history: DataFrame, query: str, alpha: float, min_similarity: float, top_k: int) -> DataFrame:
    """(1 - alpha) q + alpha h, to length one: h pools the ``top_k`` history vectors with cosine >= ``min_similarity``, weighted by it.

    ``queries``: query, vector; ``history``: query, item, item_vector.  A query without such history keeps its vector.
    """
    near = queries.join(history, query).withColumn("__c", V.cosine(F.col("vector"), F.col("item_vector"))).where(F.col("__c") >= min_similarity)
    w = Window.partitionBy(query).orderBy(F.col("__c").desc(), "item")
    near = near.withColumn("__nth", F.row_number().over(w)).where(F.col("__nth") <= top_k)
    pooled = pool_vectors(near, [query], "item_vector", F.greatest(F.lit(0.0), F.col("__c")), out="history")
    return queries.join(pooled, query, "left").withColumn("vector", F.when(F.col("history").isNull(), F.col("vector")).otherwise(V.blend(F.col("vector"), F.col("history"), alpha))).drop("history")


def history_blends(queries: DataFrame, history: DataFrame, query: str, configs: list[dict]) -> DataFrame:
    """``queries`` with ``blends``: the vector of ``history_blend`` for each configuration (alpha, min_similarity, top_k), in order.

    History is scored once; a query keeps the vectors of its ``top_k`` most similar items for the largest top_k.
    """
    most = max(c["top_k"] for c in configs)
    near = queries.join(history, query).select(query, "item", "item_vector", V.cosine(F.col("vector"), F.col("item_vector")).alias("c"))
    w = Window.partitionBy(query).orderBy(F.col("c").desc(), "item")
    near = near.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= most)
    best = near.groupBy(query).agg(F.array_sort(F.collect_list(F.struct("nth", "c", V.doubles(F.col("item_vector")).alias("v")))).alias("__h"))  # ``most`` items

    def pooled(held: Column) -> Column:
        """The mean by weights max(0, c), equal if all are 0, to length one."""
        total = F.aggregate(held, F.lit(0.0), lambda s, x: s + F.greatest(F.lit(0.0), x["c"]))
        weight = lambda x: F.when(total > 0, F.greatest(F.lit(0.0), x["c"])).otherwise(F.lit(1.0))
        zero = F.transform(F.element_at(held, 1)["v"], lambda _: F.lit(0.0))
        return V.unit(F.aggregate(held, zero, lambda s, x: F.zip_with(s, x["v"], lambda a, b: a + weight(x) * b)))

    def within(p: Column) -> Column:
        held = F.filter(F.col("__h"), lambda x: (x["c"] >= p["low"]) & (x["nth"] <= p["top"]))
        return F.when(F.size(held) > 0, pooled(held))

    # the configurations are data: one expression runs over them
    cuts = sorted({(c["min_similarity"], c["top_k"]) for c in configs})
    cut_rows = F.array(*(F.struct(F.lit(float(low)).alias("low"), F.lit(top).alias("top")) for low, top in cuts))
    rows = F.array(*(F.struct(F.lit(float(min(max(c["alpha"], 0.0), 1.0))).alias("alpha"), F.lit(cuts.index((c["min_similarity"], c["top_k"]))).alias("cut")) for c in configs))

    def blend(cut: Column, c: Column) -> Column:
        mixed = lambda h: V.unit(F.zip_with("vector", h, lambda x, y: (1 - c["alpha"]) * x.cast("double") + c["alpha"] * y))
        return V.let(F.get(cut, c["cut"]), lambda h: F.when(h.isNull(), V.unit(F.col("vector"))).otherwise(mixed(h)))

    blends = V.let(F.transform(cut_rows, within), lambda cut: F.transform(rows, lambda c: blend(cut, c)))
    return queries.join(best, query, "left").select(*queries.columns, blends.alias("blends"))


def fused_query(queries: DataFrame, support: DataFrame, catalog: DataFrame, query: str, item: str, weight: str | None = None) -> DataFrame:
    """unit(q + weighted mean of the catalog vectors of supporting items).

    Weights above 0 decide; without any, the distinct items count equally; without items, the query stays.
    """
    w = F.lit(0.0) if weight is None else F.greatest(F.coalesce(named(weight).cast("double"), F.lit(0.0)), F.lit(0.0))
    per = support.groupBy(query, item).agg(F.sum(w).alias("__w")).join(catalog.select(item, F.col("vector").alias("__v")), item)
    pooled = pool_vectors(per, [query], "__v", F.col("__w"), normalize=False, out="history")
    return queries.join(pooled, query, "left").withColumn("vector", F.when(F.col("history").isNull(), F.col("vector")).otherwise(V.unit(F.zip_with("vector", "history", lambda a, b: a.cast("double") + b)))).drop("history")


def _squared(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


#: A key with more vectors than this does not go through the rounds in one bucket.
MOST_OF_A_KEY = 1_000_000


def interest_centroids(df: DataFrame, key: str, vector: str, k: int = 3, rounds: int = 10, cells: int = 4_000_000, most: int = MOST_OF_A_KEY) -> DataFrame:
    """key, cluster (from 0), vector: at most k centroids of each key's vectors by Lloyd's rounds from farthest points.

    All keys go through the rounds together.  The first centroid is the least vector; each further one is the
    vector farthest from those so far (ties: the least), as long as one differs from them.  Equal distances go to
    the lower cluster, and a cluster without vectors stays.  Vectors are shuffled once, into buckets by key;
    centroids lie in the same buckets, so that a round shuffles nothing.  Up to ``cells`` numbers, centroids are
    broadcast and vectors lie as they come; those of the keys with more than ``most`` vectors, which are few, too.
    """
    spark = df.sparkSession
    rows = df.where(named(vector).isNotNull()).select(F.struct(named(key).alias("k")).alias("__k"), V.doubles(named(vector)).alias("__v"))  # null keys are equal in a struct
    n, held = int(spark.conf.get("spark.sql.shuffle.partitions")), []

    def bucketed(x: DataFrame) -> DataFrame:
        held.append(f"interests_{uuid.uuid4().hex}")
        x.write.bucketBy(n, "__k").option("path", scratch(spark, "interests")).saveAsTable(held[-1])
        return spark.table(held[-1])

    try:
        rows = bucketed(rows.repartition(n, "__k"))  # centroids come in the buckets of the rows
        size = rows.groupBy("__k").agg(F.count(F.lit(1)).alias("n"), F.max(F.size("__v")).alias("d"))
        size = size.agg(F.count(F.lit(1)).alias("n"), F.max("d").alias("d"), F.max("n").alias("most")).first()
        if size["n"] * k * (size["d"] or 0) <= cells:
            return _centroids(rows, F.broadcast, lambda x: _written(x, "interest-centres"), k, rounds, key)
        many = F.broadcast(rows.groupBy("__k").count().where(F.col("count") > most).select("__k"))  # at most a ``most``-th of the rows
        rest = rows if size["most"] <= most else rows.join(many, "__k", "left_anti")
        out = _centroids(rest, lambda c: c.hint("shuffle_hash"), bucketed, k, rounds, key)
        if size["most"] > most:
            hot = _written(rows.join(many, "__k", "left_semi").repartition(n), "interest-rows")
            out = out.unionByName(_centroids(hot, F.broadcast, lambda x: _written(x, "interest-centres"), k, rounds, key))
        return out
    finally:
        for name in held:
            spark.sql(f"DROP TABLE IF EXISTS {name}")


def _centroids(rows: DataFrame, sent: Callable[[DataFrame], DataFrame], kept: Callable[[DataFrame], DataFrame], k: int, rounds: int, key: str) -> DataFrame:
    """The rounds of ``interest_centroids`` over rows (__k, __v); ``sent``: how centroids come to them, ``kept``: where they lie between rounds."""

    def beside(c: DataFrame) -> DataFrame:
        return rows.join(sent(c), "__k")

    centres = rows.groupBy("__k").agg(F.array(F.min("__v")).alias("c"))
    for _ in range(1, k):
        near = F.array_min(F.transform("c", lambda c: _squared(F.col("__v"), c)))
        far = beside(centres).groupBy("__k", "c").agg(F.min(F.struct((-near).alias("d"), F.col("__v").alias("v"))).alias("far"))
        centres = kept(far.select("__k", F.when(F.col("far.d") < 0, F.concat("c", F.array("far.v"))).otherwise(F.col("c")).alias("c")))
    for _ in range(rounds):
        own = F.array_min(F.transform("c", lambda c, i: F.struct(_squared(F.col("__v"), c).alias("d"), i.alias("i"))))["i"]
        moved = beside(centres).groupBy("__k", own.alias("i")).agg(summed_mean(F.col("__v")).alias("m"))
        moved = moved.groupBy("__k").agg(F.map_from_entries(F.collect_list(F.struct("i", "m"))).alias("m"))  # k entries at most
        at = lambda c, i: F.coalesce(F.col("m")[i], c)
        centres = kept(centres.join(moved, "__k").select("__k", F.transform("c", at).alias("c")))
    return _written(centres.select(F.col("__k.k").alias(key), F.posexplode("c").alias("cluster", "vector")), "interests")


def _written(df: DataFrame, name: str) -> DataFrame:
    """Written to a shared folder and read back: a round's lineage ends at files."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# -- decayed windows -------------------------------------------------------------------------


def window_rows(queries: DataFrame, history: DataFrame, key: str, ts: str, query: str, vector: str, window: int) -> DataFrame:
    """History rows and queries of each slot of a key, in both directions of time: two rows for each of them.

    A query's window reaches over its own slot, up to its time, and over the end of the slot before.
    """
    slot = lambda t: F.floor(t / F.lit(window))
    t, v = named(ts).cast("double"), V.doubles(named(vector))
    empty = F.lit(None).cast(queries.schema[query].dataType)
    past = history.where(named(ts).isNotNull() & named(vector).isNotNull())
    ask = queries.where(named(ts).isNotNull())
    columns = lambda s, way, at, last, name, x: [named(key).alias("key"), s.alias("slot"), F.lit(way).alias("way"), at.alias("at"), F.lit(last).alias("last"), name.alias("query"), x.alias("v")]
    nothing = F.lit(None).cast("array<double>")
    forward = past.select(*columns(slot(t), 0, t, 0, empty, v)).union(ask.select(*columns(slot(t), 0, t, 1, named(query), v)))
    backward = past.select(*columns(slot(t), 1, -t, 1, empty, v)).union(ask.select(*columns(slot(t) - 1, 1, -(t - window), 0, named(query), nothing)))
    return forward.union(backward)


def within_reach(history: DataFrame, queries: DataFrame, key: str, ts: str, window: int) -> DataFrame:
    """The history rows of a key's slots that a query's window touches: its time's slot and the one before.  Vectors are best joined to what is left."""
    slot = F.floor(named(ts).cast("double") / F.lit(window))
    asked = queries.where(named(ts).isNotNull()).select(named(key).alias("__k"), F.explode(F.array(slot, slot - 1)).alias("__s")).distinct()
    return history.join(asked, (named(key) == F.col("__k")) & (slot == F.col("__s")), "left_semi")


def decayed_windows(queries: DataFrame, history: DataFrame, key: str, ts: str, query: str, vector: str, window: int, tau: float) -> DataFrame:
    """query, vector, n_history, weight: each query's vector (weight 1) and its key's history rows with query_ts - window < ts <= query_ts,

    weighted by exp(-age / tau), as a mean to length one.  ``queries``: key, ts, query (distinct), vector.  History is
    not joined to the queries: a slot's rows pass once in each direction of time, and a running sum decays from
    row to row, so time is linear in both tables, and a key's history is dealt over its slots.  A query without a
    time keeps no row; with an empty window, it keeps its vector.
    """
    rows = window_rows(queries, history, key, ts, query, vector, window)
    rows = rows.repartition("key", "slot", "way").sortWithinPartitions("key", "slot", "way", "at", "last")
    kind = queries.schema[query].dataType.simpleString()

    def run(batches):
        place, total, weight, n, when = None, 0.0, 0.0, 0, 0.0
        for b in batches:
            out: list[tuple] = []
            names, way, at, last = b.column("query"), b.column("way").to_numpy(), b.column("at").to_numpy(), b.column("last").to_numpy()
            slots = b.column("slot").to_numpy()
            keys = b.column("key").to_pylist()
            for i, x in enumerate(b.column("v")):
                here = (keys[i], slots[i], way[i])
                if here != place:
                    place, total, weight, n, when = here, 0.0, 0.0, 0, at[i]
                asks = last[i] == (1 if way[i] == 0 else 0)
                if way[i] == 0:  # the sum decays as time goes on
                    fade = math.exp(-(at[i] - when) / tau)
                    total, weight, when, mine = total * fade, weight * fade, at[i], 1.0
                else:  # weights to the end of the slot, from where they decay to the query
                    end = (slots[i] + 1) * window
                    mine = math.exp(-(end + at[i]) / tau) if not asks else math.exp(-(window - at[i] - end) / tau)
                if not asks:
                    total, weight, n = total + mine * x.values.to_numpy(), weight + mine, n + 1
                elif way[i] == 0:
                    out.append((i, total + x.values.to_numpy() if x.is_valid else total, weight + 1.0, n))
                else:
                    out.append((i, total * mine, weight * mine, n))
            held = [o for o in out if not np.isscalar(o[1])]
            if held:
                at_rows, sums, weights, counts = zip(*held)
                yield pa.RecordBatch.from_arrays([names.take(pa.array(at_rows)), pa.array([s.tolist() for s in sums], pa.list_(pa.float64())), pa.array(weights), pa.array(counts, pa.int64())], names=["query", "s", "w", "n"])

    parts = rows.mapInArrow(run, f"query {kind}, s array<double>, w double, n long")
    both = parts.groupBy("query").agg(F.collect_list("s").alias("s"), F.sum("w").alias("weight"), F.sum("n").alias("n_history"))  # two parts at most
    added = F.when(F.size("s") == 2, F.zip_with(F.col("s")[0], F.col("s")[1], lambda x, y: x + y)).otherwise(F.col("s")[0])
    return both.select(F.col("query").alias(query), V.unit(added).alias("vector"), "n_history", "weight")


def train_mean_query(queries: DataFrame, support: DataFrame, query: str, order: list[str], m: int) -> DataFrame:
    """Each query's vector with the mean of itself and its first m - 1 support vectors, to length one; without support it stays.

    ``queries``: query, vector; ``support``: query, vector and the order columns.
    """
    w = Window.partitionBy(query).orderBy(*(named(c) for c in order))
    first = support.where(F.col("vector").isNotNull()).withColumn("__nth", F.row_number().over(w)).where(F.col("__nth") < m).select(query, "vector")
    rows = queries.where(F.col("vector").isNotNull()).select(query, "vector", F.lit(False).alias("__has")).unionByName(first.withColumn("__has", F.lit(True)))
    mean = rows.groupBy(query).agg(summed_mean(F.col("vector")).alias("__mean"), F.max("__has").alias("__has")).withColumn("__mean", V.unit(F.col("__mean")))
    out = queries.join(mean, query)
    return out.withColumn("vector", F.when(F.col("__has"), F.col("__mean")).otherwise(V.doubles(F.col("vector")))).drop("__mean", "__has")


def habit_query(queries: DataFrame, query: str, weights: dict[str, float]) -> DataFrame:
    """``vector``: the weighted sum of several vector columns, to length one; a null vector has no part in it."""
    scaled = lambda c, w: F.transform(F.col(c), lambda x: x.cast("double") * w)
    parts = [scaled(c, w) for c, w in weights.items()]
    total = F.aggregate(F.array_compact(F.array(*parts)), F.array().cast("array<double>"), lambda s, v: F.when(F.size(s) == 0, v).otherwise(F.zip_with(s, v, lambda a, b: a + b)))
    return queries.withColumn("vector", F.when(F.size(total) > 0, V.unit(total)))
