"""Reading and writing tables of interactions, vectors, pools and evaluation results."""

from __future__ import annotations

import json
import os
import re
import shutil
import tempfile
import uuid
from collections.abc import Mapping, Sequence
from functools import reduce
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidepool.functions import text as X
from tidepool.functions.columns import named, require

_L, _D, _S, _B = T.LongType(), T.DoubleType(), T.StringType(), T.BooleanType()
RAW_REVIEWS = T.StructType([
    T.StructField(n, t) for n, t in (
        ("app_id", _L), ("app_name", _S), ("review_id", _L), ("language", _S), ("review", _S), ("timestamp_created", _L),
        ("timestamp_updated", _L), ("recommended", _B), ("votes_helpful", _L), ("votes_funny", _L), ("weighted_vote_score", _D),
        ("comment_count", _L), ("steam_purchase", _B), ("received_for_free", _B), ("written_during_early_access", _B),
        ("author.steamid", _L), ("author.num_games_owned", _L), ("author.num_reviews", _L), ("author.playtime_forever", _D),
        ("author.playtime_last_two_weeks", _D), ("author.playtime_at_review", _D), ("author.last_played", _D),
    )
])
EVENT = T.StructType([
    T.StructField("event_type", _S), T.StructField("ts", _D), T.StructField("request_id", _S), T.StructField("query", _S),
    T.StructField("exclude_app_id", _L), T.StructField("k", _L), T.StructField("app_ids", T.ArrayType(_L)), T.StructField("scores", T.ArrayType(_D)),
    T.StructField("app_id", _L), T.StructField("text", _S), T.StructField("cached", _B), T.StructField("latency_ms", _D),
])


def read_csv(spark: SparkSession, path: str, schema: T.StructType = RAW_REVIEWS, columns: Sequence[str] | None = None, limit: int | None = None, multiline: bool = False) -> DataFrame:
    """A CSV file with header.  Columns are matched by the header's names, so their order and extras do not matter.

    A file is read in splits.  Where quoted texts span lines, ask for ``multiline``: a file is then one task, so give many files.
    """
    header = spark.read.csv(path, header=True, escape='"', enforceSchema=False).columns  # reads the first line alone
    kinds = {f.name: f.dataType for f in schema}
    own = T.StructType([T.StructField(c, kinds.get(c, _S)) for c in header])
    df = spark.read.csv(path, schema=own, header=True, multiLine=multiline, escape='"')
    if columns is not None:
        require(df, columns)
        df = df.select(*(named(c) for c in columns))
    return df.limit(limit) if limit is not None else df


def read_parquet(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    if columns is not None:
        require(df, columns)
        df = df.select(*(named(c) for c in columns))
    return df


def column_names(spark: SparkSession, path: str) -> list[str]:
    return spark.read.parquet(path).columns


def load_split(df: DataFrame, items: DataFrame | None = None, *, user: str = "author.steamid", item: str = "app_id", text: str = "review", ts: str = "timestamp_created", least: int = 0) -> DataFrame:
    """Rows for evaluation: user as string, text without nulls and of at least ``least`` characters, ``ts`` a number, item known."""
    df = df.withColumns({user: named(user).cast("string"), text: F.coalesce(named(text), F.lit("")), "ts": named(ts).cast("double")})
    df = df.where(F.col("ts").isNotNull() & ~F.isnan("ts") & (F.length(named(text)) >= least))
    return df if items is None else df.join(items.select(item).distinct(), item, "left_semi")


def split_path(root: str, split: str, exists) -> tuple[str, str]:
    """(path, split used): val falls back to train where its folder is absent; ``exists`` tells whether a path is there."""
    path = f"{root}/split={split}"
    if not exists(path) and split == "val":
        split, path = "train", f"{root}/split=train"
    if not exists(path):
        raise FileNotFoundError(path)
    return path, split


def first_existing(paths: Sequence[str], exists=os.path.exists) -> str:
    """The first path that is there, new names before old ones."""
    for p in paths:
        if exists(p):
            return p
    raise FileNotFoundError(paths[0])


def write_splits(df: DataFrame, path: str, split: str = "split") -> dict[str, int]:
    """One folder per split, and the rows of each."""
    df.write.mode("overwrite").partitionBy(split).parquet(path)
    back = df.sparkSession.read.parquet(path)
    return {r[split]: r["count"] for r in back.groupBy(split).count().collect()}


def write_single(chunks: Sequence[DataFrame], path: str) -> int:
    """Chunks as one Parquet file with the first one's schema (columns by name, later ones cast); the number of rows.

    For tools that take one file: a single task writes it.  ``write_splits`` and plain writes keep many files.
    Chunks are made by many tasks first, so that the single one reads what it writes, once, and nothing else.
    """
    spark, first, parts = chunks[0].sparkSession, chunks[0].schema, []
    for c in chunks[1:]:
        require(c, first.fieldNames())
    for c in chunks:
        part = scratch(spark, "chunk")
        c.select(*(named(f.name).cast(f.dataType).alias(f.name) for f in first)).write.parquet(part)
        parts.append(spark.read.schema(first).parquet(part))
    reduce(lambda a, b: a.union(b), parts).coalesce(1).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path).count()


def write_csv(df: DataFrame, path: str) -> None:
    """A small result table as one CSV part with header; arrays and structs as JSON."""
    cols = [F.to_json(named(f.name)).alias(f.name) if isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType)) else named(f.name) for f in df.schema]
    df.select(*cols).coalesce(1).write.mode("overwrite").csv(path, header=True, escape='"')


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str, method: str | None = None) -> DataFrame:
    """JSON lines, only one method's if given; ValueError if there are none."""
    df = spark.read.json(path, schema=schema)
    if method is not None:
        df = df.where(F.col("method") == method)
    if df.isEmpty():
        raise ValueError(f"no rows in {path}" + (f" for method {method}" if method else ""))
    return df


def write_json(value: Mapping, path: str) -> None:
    """Parameters or metadata, sorted and indented, on the driver."""
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(value, sort_keys=True, indent=2))


def read_json(path: str) -> dict:
    return json.loads(Path(path).read_text())


def merge_baseline(path: str, section: str, rows: Mapping) -> dict:
    """Replace one section of a baseline file and keep the others."""
    have = read_json(path) if os.path.exists(path) else {}
    have[section] = dict(rows)
    write_json(have, path)
    return have


def write_vectors(df: DataFrame, path: str, key: str = "app_id") -> None:
    """Vectors keyed by id, as a table; ValueError if an id repeats."""
    if not df.groupBy(key).count().where("count > 1").isEmpty():
        raise ValueError(f"{key} repeats")
    df.write.mode("overwrite").parquet(path)


def read_vectors(spark: SparkSession, path: str, where: Mapping[str, object] | None = None) -> DataFrame:
    """Vectors of a collection, filtered by metadata columns."""
    df = spark.read.parquet(path)
    for c, v in (where or {}).items():
        df = df.where(named(c) == v)
    return df


def pooled_id(item, variant: str):
    """app::variant."""
    return F.concat_ws("::", item.cast("string"), F.lit(variant))


def cached(spark: SparkSession, path: str, make, exists=os.path.exists) -> DataFrame:
    """The table at ``path``; made and written first if it is not there."""
    if not exists(path):
        make().write.parquet(path)
    return spark.read.parquet(path)


def archive_run(latest: str, archive: str, stamp: str, tag: str) -> str:
    """Copy a run's folder to <stamp>__<tag>; FileExistsError if there is one."""
    to = f"{archive}/{stamp}__{re.sub(r'[^A-Za-z0-9._-]+', '-', tag).strip('-')}"
    if os.path.exists(to):
        raise FileExistsError(to)
    shutil.copytree(latest, to)
    return to


def read_manifest(path: str) -> list[dict]:
    """Experiments of a JSON (or, where yaml can be imported, YAML) manifest: name, method and notes."""
    raw = Path(path).read_text()
    if path.endswith((".yml", ".yaml")):
        import yaml

        data = yaml.safe_load(raw)
    else:
        data = json.loads(raw)
    rows = data["experiments"] if isinstance(data, dict) else data
    for r in rows:
        if "method" not in r:
            raise ValueError(f"an experiment without method: {r}")
    return rows


def registry(spark: SparkSession, experiments: Sequence[Mapping], metrics: DataFrame) -> DataFrame:
    """Experiments with the metrics of their method, and a note where there are none."""
    cols = sorted({k for e in experiments for k in e})
    df = spark.createDataFrame([tuple(None if e.get(c) is None else str(e[c]) for c in cols) for e in experiments], ", ".join(f"`{c}` string" for c in cols))
    hit = metrics.withColumn("__hit", F.lit(True))
    return df.join(hit, "method", "left").withColumn("join_note", F.when(F.col("__hit").isNull(), F.concat(F.lit("no metrics for method "), F.col("method")))).drop("__hit")


def log_event(path: str, event: Mapping) -> None:
    """Append one event to a JSON-lines file of a serving process."""
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    with open(path, "a") as f:
        f.write(json.dumps(dict(event)) + "\n")


def text_ok(df: DataFrame, col: str, least: int) -> DataFrame:
    return df.where(F.length(X.strip(named(col))) >= least)


def write_npz(df: DataFrame, path: str, key: str = "app_id", vector: str = "vector", most: int = 50_000_000) -> None:
    """A catalogue's vectors as one .npz file (int64 ids, float32 matrix) by id; ValueError for more than ``most`` components, as they go through the driver."""
    size = df.agg(F.sum(F.size(named(vector)).cast("long"))).first()[0] or 0
    if size > most:
        raise ValueError(f"{size} components are more than {most}: write Parquet instead")
    rows = df.select(named(key).cast("long").alias("i"), named(vector).alias("v")).orderBy("i").collect()
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    np.savez(path, app_ids=np.array([r["i"] for r in rows], np.int64), embeddings=np.array([r["v"] for r in rows], np.float32).reshape(len(rows), -1))


def read_npz(spark: SparkSession, path: str, key: str = "app_id", vector: str = "vector") -> DataFrame:
    """Ids and vectors of a .npz file; ValueError if their numbers differ."""
    with np.load(path) as f:
        ids, matrix = f["app_ids"], f["embeddings"]
    if len(ids) != len(matrix):
        raise ValueError(f"{len(ids)} ids and {len(matrix)} vectors in {path}")
    return spark.createDataFrame(list(zip(ids.tolist(), matrix.tolist())), f"{key} long, {vector} array<float>")


def plan_moves(moves: Mapping[str, str], root: str, exists=os.path.exists) -> list[dict]:
    """What to do with old paths below ``root``: move, skip (absent) or conflict (the new path is there too)."""
    out = []
    for old, new in moves.items():
        a, b = exists(f"{root}/{old}"), exists(f"{root}/{new}")
        out.append({"source": old, "target": new, "action": "conflict" if a and b else "move" if a else "skip"})
    return out


def move_planned(plan: Sequence[Mapping], root: str) -> int:
    """Carry out the moves of a plan; FileExistsError, before anything is moved, if it holds a conflict."""
    if bad := [p["source"] for p in plan if p["action"] == "conflict"]:
        raise FileExistsError(f"both old and new path are there: {bad}")
    todo = [p for p in plan if p["action"] == "move"]
    for p in todo:
        Path(f"{root}/{p['target']}").parent.mkdir(parents=True, exist_ok=True)
        shutil.move(f"{root}/{p['source']}", f"{root}/{p['target']}")
    return len(todo)


def listing(spark: SparkSession, *paths: str) -> tuple:
    """Application, and path, time and size of every file of some tables: equal as long as the files are."""
    files, jvm = [], spark.sparkContext._jvm
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        todo = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(p, True)
        while todo.hasNext():
            f = todo.next()
            files.append((f.getPath().toString(), f.getModificationTime(), f.getLen()))
    return (spark.sparkContext.applicationId, *sorted(files))


def scratch(spark: SparkSession, what: str) -> str:
    """A fresh folder that the driver and all executors share, deleted with the session's JVM.

    It lies in ``spark.checkpoint.dir``; where that is unset, in a temporary folder if all runs on this machine.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.gettempdir()}"
    path = f"{base.rstrip('/')}/{what}-{uuid.uuid4().hex}"
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(p)
    return path
