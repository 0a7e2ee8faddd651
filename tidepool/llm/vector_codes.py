"""Vector codes: each part of a vector is replaced by the number of its nearest codebook entry.

Components become integers, floor(256 * x), and a vector is cut into ``parts``
equal consecutive parts.  The codebook of a part position starts as that part of
the ``entries`` rows with the smallest ids.  A round assigns every part to its
nearest entry and moves each entry to the floor of its parts' mean; an entry that
nothing chose stays.  All arithmetic is on integers, so results do not depend on
how rows are spread over tasks or on attempts that are repeated.

The codebooks have a fixed size (parts * entries entries), so each round broadcasts
them, a kd-tree for each.  A search goes down the tree by exact integer bounds: a
node is left out only if its box is farther than the best entry so far, so boxes at
an equal distance are visited too and of entries that tie the lowest index wins.
A task sends one row of sums per entry that it met, whatever the number of vectors.

Rows take part whose vector is not null, holds no null or non-finite component and
has the length of the first such row's (by id, nulls last, then by vector) whose
length is a positive multiple of ``parts``.  Others are dropped.  Equal rows are rows
of their own, in the codebooks' beginnings too.  With fewer rows than entries, the
codebooks are shorter.  Integers are held within ``limit``, some 2^27 for 64
components, so that squared distances fit 64 bits: only components beyond half a
million are touched.  A null label is a label of its own.  An empty table gives an
empty result.  Other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepool.llm.tables import join_back, per_batch, small_batches, staged

PARTS, ENTRIES, ROUNDS, SCALE, LEAF, BLOCK = 16, 64, 2, 256, 8, 8192


class KdTree:
    """Entries of one codebook, split at the median of their widest component; nearest entries by squared distance, then index."""

    def __init__(self, points: np.ndarray):
        self.points = points
        self.root = self._node(np.arange(len(points)))

    def _node(self, at: np.ndarray):
        mine = self.points[at]
        low, high = mine.min(axis=0), mine.max(axis=0)
        axis = int(np.argmax(high - low))
        if len(at) <= LEAF or low[axis] == high[axis]:
            return low, high, np.sort(at), None
        order = at[np.argsort(mine[:, axis], kind="stable")]
        half = len(order) // 2
        return low, high, self._node(order[:half]), self._node(order[half:])

    def nearest(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, squared distance) of the nearest entry of each row."""
        best = np.full(len(rows), len(self.points), np.int64)
        far = np.full(len(rows), np.iinfo(np.int64).max)
        self._visit(self.root, rows, np.arange(len(rows)), best, far)
        return best, far

    def _bound(self, node, rows: np.ndarray) -> np.ndarray:
        """The squared distance of each row to a node's box."""
        outside = np.maximum(np.maximum(node[0] - rows, rows - node[1]), 0)
        return (outside * outside).sum(axis=1)

    def _visit(self, node, rows, of, best, far) -> None:
        """Search below ``node`` for the rows numbered ``of``."""
        if node[3] is None:
            for entry in node[2].tolist():
                gap = rows[of] - self.points[entry]
                d = (gap * gap).sum(axis=1)
                better = (d < far[of]) | ((d == far[of]) & (entry < best[of]))
                far[of[better]], best[of[better]] = d[better], entry
            return
        bounds = [self._bound(child, rows[of]) for child in node[2:]]
        right_first = bounds[1] < bounds[0]
        for first, late in ((0, False), (1, False), (1, True), (0, True)):  # the nearer child, then the other where it may still hold an equal entry
            mine = np.flatnonzero(right_first == ((first == 1) != late))
            if late:
                mine = mine[bounds[first][mine] <= far[of[mine]]]
            if len(mine):
                self._visit(node[2 + first], rows, of[mine], best, far)


def limit(dim: int) -> int:
    """The largest power of two within which squared distances of ``dim`` components fit 62 bits."""
    return 1 << ((62 - (dim - 1).bit_length()) // 2 - 1)


def whole_numbers(vectors: pa.Array, dim: int) -> np.ndarray:
    """floor(256 * x) of each component, a row per vector."""
    x = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    with np.errstate(over="ignore"):
        return np.clip(np.floor(x * SCALE), -limit(dim), limit(dim)).astype(np.int64)


def usable(vector: Column) -> Column:
    return F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def _blocks(batch: pa.RecordBatch, dim: int, parts: int):
    """(first row, the rows' parts as an array of row, part, component) for blocks of a batch."""
    for a in range(0, batch.num_rows, BLOCK):
        some = whole_numbers(batch.column("v").slice(a, BLOCK), dim)
        yield a, some.reshape(len(some), parts, dim // parts)


def _moved(rows: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after one round over all rows."""
    parts, entries, width = books.shape
    trees = rows.sparkSession.sparkContext.broadcast([KdTree(b) for b in books])

    def run(batches):
        count, total = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), np.int64)
        for batch in batches:
            for _, x in _blocks(batch, parts * width, parts):
                for p in range(parts):
                    entry, _ = trees.value[p].nearest(x[:, p])
                    count[p] += np.bincount(entry, minlength=entries)
                    np.add.at(total[p], entry, x[:, p])
        part, entry = np.nonzero(count)
        sums = pa.ListArray.from_arrays(np.arange(len(part) + 1, dtype=np.int32) * width, pa.array(total[part, entry].ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(entry.astype(np.int32)), pa.array(count[part, entry]), sums], names=["part", "entry", "n", "sums"])

    sent = rows.select("v").mapInArrow(run, "part int, entry int, n long, sums array<long>")
    summed = sent.groupBy("part", "entry").agg(F.sum("n").alias("n"), *(F.sum(F.col("sums")[k]).alias(f"s{k}") for k in range(width)))
    books = books.copy()
    for r in summed.collect():  # at most parts * entries rows
        books[r["part"], r["entry"]] = [r[f"s{k}"] // r["n"] for k in range(width)]
    trees.unpersist()
    return books


def codebooks(rows: DataFrame, *, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray | None:
    """The codebooks (part, entry, component) learnt from ``rows`` (id, v) that take part; None without rows."""
    order = [F.col("id").asc_nulls_last(), F.col("v")]
    first = rows.orderBy(*order).limit(1).collect()
    if not first:
        return None
    dim = len(first[0]["v"])
    head = rows.where(F.size("v") == dim).orderBy(*order).limit(entries).select("v").toArrow().column("v").combine_chunks()
    books = whole_numbers(head, dim).reshape(len(head), parts, dim // parts).transpose(1, 0, 2)
    for _ in range(rounds):
        books = _moved(rows.where(F.size("v") == dim), books)
    return books


def digest(books: np.ndarray) -> str:
    """sha256 of all components in decimal, by part, entry and position."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def encode_vectors(df: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """Per row that takes part: its id, label, code (two hex digits a part), error, label_error and codebooks_sha256 (see the module)."""
    spark = df.sparkSession
    small_batches(spark)
    rows = df.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("v"))
    rows = rows.where(usable(F.col("v")) & (F.size("v") > 0) & (F.size("v") % parts == 0))
    books = codebooks(rows.select("id", "v"), parts=parts, entries=entries, rounds=rounds)
    if books is None:
        books = np.zeros((parts, 0, 1), np.int64)
    dim = parts * books.shape[2]
    trees = spark.sparkContext.broadcast([KdTree(b) for b in books] if books.shape[1] else [])

    def run(batch: pa.RecordBatch):
        for a, x in _blocks(batch, dim, parts):
            code, error = np.empty((len(x), parts), np.uint8), np.zeros(len(x), np.int64)
            for p in range(parts):
                code[:, p], far = trees.value[p].nearest(x[:, p])
                error += far
            digits = code.tobytes().hex()
            codes = [digits[k : k + 2 * parts] for k in range(0, len(digits), 2 * parts)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, len(x)), batch.column(1).slice(a, len(x)), pa.array(codes, pa.string()), pa.array(error)], names=["id", "label", "code", "error"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    coded = rows.where(F.size("v") == dim).mapInArrow(per_batch(run), f"id {kinds['id']}, label {kinds['label']}, code string, error long")
    coded = staged(coded, "vector-codes")
    errors = coded.groupBy("label").agg(F.sum("error").alias("label_error"), F.count("*").alias("n"))
    out = join_back(coded, errors, "label", spread="id")
    return out.select(F.col("id").alias(id_col), F.col("label").alias(label_col), "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
