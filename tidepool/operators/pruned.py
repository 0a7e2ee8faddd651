"""Exact pools of a large catalogue without scoring every pair: leaves of a k-d tree, and a bound on what each can hold.

The tree is grown on a bounded sample of the items (some ``SAMPLE``, by hash), along the sample's principal axes, and only
tells where rows go; each leaf's box is that of all its items, in those axes.  A query is scored in the leaf that it falls
in, and its k-th best score there bounds what is wanted: for vectors within a box at distance d, q.x is at most
(|q|^2 + |x|^2 - d^2) / 2.  Then it meets the leaves whose bound reaches that score, and no others, so that nothing is lost
and ties are kept.  Queries are not sent to leaves one by one: those of neighbouring leaves form a block (of a bounded
number), each leaf that one of them needs comes to the block once, and a query meets there only the leaves that it needs;
what it finds raises its bound.  A leaf is cut into units of a bounded matrix, which a task scores one at a time; a block
that needs more items than a task may hold (``AT_ONCE`` numbers, or one matrix) meets them in several slices, each with a copy of its queries.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidepool.sources.tables import scratch

LEAF, MOST_LEAVES, SAMPLE = 512, 16_384, 131_072
#: Blocks that queries are dealt into, and the least and most queries of one.
BLOCKS, LEAST_QUERIES, MOST_QUERIES = 96, 256, 32_768
#: Scores are rounded to 12 digits; bounds may be off by less than this.
SLACK = 1e-11
#: Numbers that are compared at once, and of items that a task holds in a slice however small its matrices are.
AT_ONCE = 2_000_000


@dataclass(frozen=True)
class Tree:
    """Nodes: axis, value, and below and above: a node, or ~leaf."""

    axis: np.ndarray
    value: np.ndarray
    below: np.ndarray
    above: np.ndarray
    n_leaves: int

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row."""
        at = np.full(len(x), 0 if len(self.axis) else -1)
        while len(open_ := np.flatnonzero(at >= 0)):
            node = at[open_]
            low = x[open_, self.axis[node]] < self.value[node]
            at[open_] = np.where(low, self.below[node], self.above[node])
        return ~at


def grow(sample: np.ndarray, n_leaves: int) -> Tree:
    """Halves along the axis of the largest variance, until a node has its share of the sample or one point."""
    nodes: list[list] = []
    least, n, todo = max(1, len(sample) // max(1, n_leaves)), 0, [(np.arange(len(sample)), None, 0)]
    while todo:
        rows, parent, side = todo.pop()
        x = sample[rows]
        axis = int(np.argmax(x.var(axis=0))) if len(rows) > least else 0
        value = x[:, axis]
        cut = np.median(value) if len(rows) > least else 0.0
        if len(rows) > least and not (value < cut).any():
            cut = value[value > cut].min(initial=np.inf)
        if len(rows) <= least or not np.isfinite(cut):
            name, n = ~n, n + 1
        else:
            name = len(nodes)
            nodes.append([axis, cut, 0, 0])
            todo += [(rows[value < cut], name, 2), (rows[value >= cut], name, 3)]
        if parent is not None:
            nodes[parent][side] = name
    axis, value, below, above = (np.array(c) for c in zip(*nodes)) if nodes else (np.zeros(0, int),) * 4
    return Tree(axis, value, below, above, n)


@dataclass(frozen=True)
class Boxes:
    """What the leaves that hold items hold: corners, the largest squared length, and the leaf's first unit and number of units."""

    low: np.ndarray
    high: np.ndarray
    length: np.ndarray
    first: np.ndarray
    units: np.ndarray

    def reached(self, v: np.ndarray, least: np.ndarray, but: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, unit) of the units other than ``but`` that may hold a score of the row's ``least`` or more."""
        square = (v * v).sum(axis=1)
        gap = np.maximum(np.maximum(self.low - v.max(axis=0), v.min(axis=0) - self.high), 0.0)
        some = np.flatnonzero((square.max() + self.length - (gap * gap).sum(axis=1)) / 2 >= least.min() - SLACK)
        low, high, found = self.low[some], self.high[some], []
        step = max(1, AT_ONCE // max(1, low.size))
        for a in range(0, len(v), step):
            x = v[a : a + step]
            far = np.zeros((len(x), len(some)))
            for i in range(v.shape[1]):
                gap = np.maximum(np.maximum(low[None, :, i] - x[:, i, None], x[:, i, None] - high[None, :, i]), 0.0)
                far += gap * gap
            r, c = np.nonzero((square[a : a + step, None] + self.length[some] - far) / 2 >= least[a : a + step, None] - SLACK)
            found.append((r + a, some[c]))
        row, leaf = (np.concatenate(x) for x in zip(*found))
        n = self.units[leaf]
        row, unit = np.repeat(row, n), np.repeat(self.first[leaf] - np.concatenate([[0], np.cumsum(n)[:-1]]) if len(n) else leaf, n) + np.arange(n.sum())
        keep = unit != but
        return row[keep], unit[keep]


def _lists(rows: np.ndarray, values: np.ndarray, n: int) -> pa.Array:
    """Values as a list for each of ``n`` rows; ``rows`` ascend."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=n))]).astype(np.int32)), pa.array(values))


def _kept(df: DataFrame, name: str) -> DataFrame:
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _own(b: pa.RecordBatch | pa.Table, mask: bool) -> tuple[np.ndarray, np.ndarray]:
    """Queries' own items, and whether they are to be left out."""
    own = b["__own"].combine_chunks() if isinstance(b, pa.Table) else b["__own"]
    return own.fill_null(0).to_numpy(zero_copy_only=False), own.is_valid().to_numpy(zero_copy_only=False) & mask


def _finite(c: str):
    return ~F.exists(c, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))


def principal_axes(sample: np.ndarray) -> np.ndarray:
    """An orthogonal matrix; its columns are the sample's axes, so that boxes along them are narrow."""
    x = sample - sample.mean(axis=0) if len(sample) else sample
    return np.linalg.eigh(x.T @ x)[1][:, ::-1] if x.size else np.eye(x.shape[1])


def dealt(counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The first block of each leaf's queries and their number of blocks: neighbouring leaves share one, a leaf with more than ``size`` queries has several."""
    first, parts, block, held = np.zeros(len(counts), np.int64), np.ones(len(counts), np.int64), 0, 0
    for i, n in enumerate(counts.tolist()):
        if held and held + n > size:
            block, held = block + 1, 0
        first[i] = block
        if n > size:
            parts[i] = -(-n // size)
            block += int(parts[i])
        else:
            held += n
    return first, parts


class Best:
    """The k best (score, then item) of each of ``n`` rows, of pairs that come in any order; ``least`` is what a row still wants."""

    def __init__(self, least: np.ndarray, k: int):
        self.least, self.k, self.held, self.n, self.bound = least.copy(), k, [], 0, AT_ONCE

    def add(self, rows: np.ndarray, items: np.ndarray, scores: np.ndarray) -> None:
        self.held.append((rows, items, scores))
        self.n += len(rows)
        if self.n > self.bound:
            self.cut()
            self.bound = self.n + AT_ONCE

    def cut(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows (ascending), items and scores of the best so far."""
        r, i, s = (np.concatenate(x) for x in zip(*self.held)) if self.held else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        order = np.lexsort((i, -s, r))
        r, i, s = r[order], i[order], s[order]
        nth = np.arange(len(r)) - np.searchsorted(r, r)
        last = nth == self.k - 1
        self.least[r[last]] = np.maximum(self.least[r[last]], s[last])
        r, i, s = (x[nth < self.k] for x in (r, i, s))
        self.held, self.n = [(r, i, s)], len(r)
        return r, i, s


def pruned_pairs(left: DataFrame, right: DataFrame, query: str, item: str, mask: bool, k: int, n: int, dims: int, cells: int) -> DataFrame:
    """query, item, score: among others, all pairs that are in a query's k best.

    ``left``: query, __own, __v; ``right``: __i, __m (``n`` rows of ``dims`` numbers); rows without a finite vector take no part.
    """
    from tidepool.operators.retrieval import _matrix, best_of_rows

    spark, kind = left.sparkSession, left.schema[query].dataType.simpleString()
    most = max(1, cells // max(1, dims))
    leaves = max(1, min(MOST_LEAVES, n // min(most, max(LEAF, 8 * k))))
    left, right = left.where(_finite("__v")), right.where(_finite("__m"))
    drawn = F.pmod(F.xxhash64("__i", F.lit("tree")), F.lit(1 << 20)) < F.lit(max(1, min(1 << 20, (SAMPLE << 20) // max(n, 1))))
    sample = right.where(drawn).select("__m").limit(2 * SAMPLE).toArrow()["__m"]
    sample = _matrix(sample) if len(sample) else np.zeros((0, dims))
    axes = principal_axes(sample)
    tree = spark.sparkContext.broadcast((grow(sample @ axes, leaves), axes))

    def placed(df: DataFrame, vector: str, turned: str | None = None) -> DataFrame:
        def place(batches):
            grown, axes = tree.value
            for b in batches:
                if b.num_rows:
                    x = _matrix(b.column(vector)) @ axes
                    b = b.append_column("__leaf", pa.array(grown.leaves(x).astype(np.int32)))
                    yield b if turned is None else b.append_column(turned, pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), dims).cast(pa.list_(pa.float64())))

        ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
        return _kept(df.mapInArrow(place, f"{ddl}, __leaf int" + (f", {turned} array<double>" if turned else "")), "placed")

    left, right = placed(left, "__v"), placed(right, "__m", "__t")
    at = [F.col("__t")[i] for i in range(dims)]
    square = sum((x * x for x in at), F.lit(0.0))
    stats = right.groupBy("__leaf").agg(F.count(F.lit(1)).alias("n"), F.max(square).alias("s"), *(F.min(x).alias(f"l{i}") for i, x in enumerate(at)), *(F.max(x).alias(f"h{i}") for i, x in enumerate(at)))
    stats = stats.toArrow().sort_by("__leaf")  # a row per leaf
    column = lambda c: stats[c].to_numpy()
    units = -(-column("n") // most)
    first = np.cumsum(units) - units
    corner = lambda side: np.stack([column(f"{side}{i}") for i in range(dims)], axis=1)
    boxes = spark.sparkContext.broadcast(Boxes(corner("l"), corner("h"), column("s"), first, units))
    asking = {r["__leaf"]: r["count"] for r in left.groupBy("__leaf").count().collect()}  # a row per leaf
    counts = np.array([asking.get(leaf, 0) for leaf in column("__leaf").tolist()], np.int64)
    block, parts = dealt(counts, max(LEAST_QUERIES, min(MOST_QUERIES, -(-int(counts.sum()) // BLOCKS))))
    plan = F.broadcast(spark.createDataFrame(list(zip(column("__leaf").tolist(), first.tolist(), units.tolist(), block.tolist(), np.where(counts > 0, parts, 0).tolist())), "__leaf int, __first int, __units int, __block int, __parts int"))
    sizes = F.broadcast(spark.createDataFrame([(u, -(-size // of)) for f, of, size in zip(first.tolist(), units.tolist(), column("n").tolist()) for u in range(f, f + of)], "__u int, __size long"))
    unit = lambda name: (F.col("__first") + F.pmod(F.xxhash64(name), F.col("__units"))).cast("int")
    mine = (F.col("__block") + F.pmod(F.xxhash64(query, F.lit("block")), F.col("__parts"))).cast("int")
    left = left.join(plan, "__leaf").select(F.col(query).alias("__q"), "__own", "__v", unit(query).alias("__u"), mine.alias("__b"))
    right = right.join(plan, "__leaf").select("__i", "__m", unit("__i").alias("__u"), "__block", "__parts")

    def at_home(asked: pa.Table, held: pa.Table) -> pa.Table:
        """The queries with ``__least``, their k-th best score in their own leaf, and in a batch's first row the units that one of them needs."""
        out = []
        if asked.num_rows:
            held = held.sort_by("__i").combine_chunks()
            items, matrix, axes = held["__i"].to_numpy(), _matrix(held["__m"]).reshape(len(held), dims), tree.value[1]
            for b in asked.combine_chunks().to_batches(max_chunksize=max(1, min(256, AT_ONCE // max(1, len(items))))):
                v, (own, masked) = _matrix(b["__v"]), _own(b, mask)
                s = np.round(v @ matrix.T, 12)
                s[(items[None, :] == own[:, None]) & masked[:, None]] = -np.inf
                r, c = best_of_rows(s, k)
                least = np.full(len(v), np.inf)
                np.minimum.at(least, r, s[r, c])
                least[np.bincount(r, minlength=len(v)) < k] = -np.inf
                needed = np.unique(boxes.value.reached(v @ axes, least, -1)[1]).astype(np.int32)
                out.append(pa.RecordBatch.from_arrays([b["__q"], b["__own"], b["__v"], pa.array(least), _lists(np.zeros(len(needed), int), needed, len(v)), b["__b"]], names=["__q", "__own", "__v", "__least", "__units", "__b"]))
        schema = pa.schema([("__q", asked.schema.field("__q").type), ("__own", pa.int64()), ("__v", pa.list_(pa.float64())), ("__least", pa.float64()), ("__units", pa.list_(pa.int32())), ("__b", pa.int32())])
        return pa.Table.from_batches([pa.RecordBatch.from_arrays(b.columns, schema=schema) for b in out], schema)

    def met(asked: pa.Table, held: pa.Table) -> pa.Table:
        """The k best of each query of a block among some units; a unit is scored for the queries that may find something in it."""
        schema = pa.schema([(query, asked.schema.field("__q").type), (item, pa.int64()), ("score", pa.float64())])
        if not (asked.num_rows and held.num_rows):
            return schema.empty_table()
        asked, box, axes = asked.combine_chunks(), boxes.value, tree.value[1]
        v, (own, masked) = _matrix(asked["__v"]), _own(asked, mask)
        turned, square, best = np.ascontiguousarray((v @ axes).T), (v * v).sum(axis=1), Best(asked["__least"].to_numpy(), k)
        for u, ids, vectors in zip(held["__u"].to_pylist(), held["__is"], held["__ms"]):
            leaf = int(np.searchsorted(box.first, u, "right")) - 1
            items = ids.values.to_numpy()
            matrix = vectors.values.to_numpy().reshape(len(items), dims)
            far = np.zeros(len(v))
            for x, low, high in zip(turned, box.low[leaf], box.high[leaf]):
                gap = np.maximum(np.maximum(low - x, x - high), 0.0)
                far += gap * gap
            rows = np.flatnonzero((square + box.length[leaf] - far) / 2 >= best.least - SLACK)
            step = max(1, AT_ONCE // len(items))
            for part in (rows[a : a + step] for a in range(0, len(rows), step)):
                s = v[part] @ matrix.T
                r, c = np.nonzero(s >= best.least[part, None] - SLACK)
                score, r = np.round(s[r, c], 12), part[r]
                keep = (score >= best.least[r]) & ~((items[c] == own[r]) & masked[r])
                best.add(r[keep], items[c[keep]], score[keep])
        r, found, score = best.cut()
        return pa.Table.from_arrays([asked["__q"].take(pa.array(r)), pa.array(found), pa.array(score)], schema=schema)

    beside = right.where("__parts > 0").withColumn("__b", F.explode(F.sequence(F.col("__block"), F.col("__block") + F.col("__parts") - 1)))
    home = left.groupBy("__u", "__b").cogroup(beside.groupBy("__u", "__b")).applyInArrow(at_home, f"__q {kind}, __own long, __v array<double>, __least double, __units array<int>, __b int")
    home = _kept(home, "home")
    asks = home.select("__b", F.explode("__units").alias("__u")).distinct().join(sizes, "__u")
    before = F.sum("__size").over(Window.partitionBy("__b").orderBy("__u")) - F.col("__size")
    asks = _kept(asks.select("__b", "__u", F.floor(before / F.lit(max(most, AT_ONCE // max(1, dims)))).cast("int").alias("__s")), "asks")
    slices = asks.groupBy("__b").agg(F.max("__s").alias("__last"))  # a row per block
    packed = right.groupBy("__u").agg(F.collect_list(F.struct("__i", "__m")).alias("r"))  # a unit is bounded
    packed = packed.select("__u", F.transform("r", lambda x: x["__i"]).alias("__is"), F.flatten(F.transform("r", lambda x: x["__m"])).alias("__ms"))
    held = packed.join(asks, "__u")
    asked = home.drop("__units").join(F.broadcast(slices), "__b").withColumn("__s", F.explode(F.sequence(F.lit(0), "__last"))).drop("__last")
    return asked.groupBy("__b", "__s").cogroup(held.groupBy("__b", "__s")).applyInArrow(met, f"{query} {kind}, {item} long, score double")
