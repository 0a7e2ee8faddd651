"""MinHash near-duplicates by an inverted join over signature coordinates.

A document is its set of distinct five-word shingles (``jaccard``), and its signature
the least of ``COORDINATES`` hashes over that set.  Two documents of similarity J agree in
a coordinate with a chance of J.  A pair must agree in ``MATCHES`` of the coordinates,
which a pair at the threshold of 0.85 misses with a chance below 10^-9
(``matches_for``); what passes is confirmed on the full sets, so no link is false.

* Posting: a document stands in the list of each (coordinate, value).  Two that agree in
  34 of 64 coordinates share one of any 31 of them, so only a *prefix* is posted: the 31
  values that are rarest by a count sketch over all signatures.  Lists with one document
  are dropped before anything else is done with them.
* Merging: documents of a list are paired and their agreeing coordinates counted, on four
  bits of each coordinate that a row carries (64 of them are four longs, and one
  expression counts them).  False agreements of four bits add candidates and lose none.
  A pair that shares the list before, too, is skipped: it is counted where it first meets.
* Pairs that pass, and whose set sizes and parity maps (``jaccard``) allow the
  similarity, are verified once.

Texts with equal sets are one class, joined by its smallest doc_id.  A group of near
copies has a square of links, so lists are merged in two passes, as in ``jaccard``: first
each document with a few leaders of its list, then all documents of a list that are in
different components yet.  Long lists are dealt over several tasks in both.

Null texts and texts without words have the empty set and link with nothing.  Fewer
words than a shingle: the whole sequence is the one shingle.  Repeated rows are
copies; rows that share a doc_id are one node.  Null doc_ids have no component and no
``kept``.  An empty table gives an empty result.  Very long texts are read whole, in
steps of rows.  Other columns are not read.
"""

from __future__ import annotations

from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepool.llm import bytetext as bt
from tidepool.llm import jaccard as J
from tidepool.llm.tables import per_batch, small_batches, staged

COORDINATES, PERCENT, MISSED, LEADERS = 64, 85, 1e-9, 8


def matches_for(percent: int, coordinates: int = COORDINATES, missed: float = MISSED) -> int:
    """The largest number of agreeing coordinates that a pair at the threshold falls short of with a chance of at most ``missed``."""
    p, below = percent / 100, 0.0
    for m in range(coordinates + 1):
        below += comb(coordinates, m) * p**m * (1 - p) ** (coordinates - m)
        if below > missed:
            return m
    return coordinates


MATCHES = matches_for(PERCENT)
PREFIX = COORDINATES - MATCHES + 1
_FACTORS = bt.mix(np.arange(1, COORDINATES + 1, dtype=np.uint64)) | np.uint64(1)
_SHIFTS = bt.mix(np.arange(1, COORDINATES + 1, dtype=np.uint64) << np.uint64(32))
_HIGH = np.uint64(32)


def signature_rows(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Signatures (32 bits a coordinate) of sets of shingle hashes, none of them empty."""
    out = np.empty((len(bounds) - 1, COORDINATES), "<u4")
    for k in range(COORDINATES):
        out[:, k] = np.minimum.reduceat(h * _FACTORS[k] + _SHIFTS[k], bounds[:-1]) >> _HIGH if len(out) else 0
    return out


def tokens(signatures: np.ndarray) -> np.ndarray:
    """One number for each (coordinate, value)."""
    return bt.mix(signatures.astype(np.uint64) | (np.arange(COORDINATES, dtype=np.uint64) << _HIGH))


def nibbles(signatures: np.ndarray) -> list[np.ndarray]:
    """Four bits of each coordinate, as four longs."""
    few = (signatures & 15).astype(np.uint64).reshape(len(signatures), 4, 16) << (np.arange(16, dtype=np.uint64) * np.uint64(4))
    return list(np.bitwise_or.reduce(few, axis=2).view(np.int64).T)


_BITS = ["b0", "b1", "b2", "b3"]


def agreeing(a: str, b: str) -> Column:
    """How many coordinates agree in their four bits, of rows aliased a and b."""
    total = F.lit(0)
    for c in _BITS:
        d = F.col(f"{a}.{c}").bitwiseXOR(F.col(f"{b}.{c}"))
        d = d.bitwiseOR(F.shiftrightunsigned(d, 2))
        d = d.bitwiseOR(F.shiftrightunsigned(d, 1)).bitwiseAND(F.lit(0x1111111111111111))
        total = total + 16 - F.bit_count(d)
    return total


def _candidate(a: str, b: str) -> Column:
    """Set sizes that allow the similarity, lists not skipped, enough agreeing coordinates, and parity maps that do not rule it out."""
    n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
    first = F.col(f"{a}.prev").isNull() | F.col(f"{b}.prev").isNull() | (F.col(f"{a}.prev") != F.col(f"{b}.prev"))
    return first & (100 * F.least(n, m) >= PERCENT * F.greatest(n, m)) & (agreeing(a, b) >= MATCHES) & J._alike(a, b, PERCENT)


def _read(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u4").reshape(-1, COORDINATES)


def _survey(docs: DataFrame, held: list[str]) -> DataFrame:
    """A row per document: doc, n, s1, s2, parity map, signature (null for the empty set)."""
    names = ["doc", "n", "s1", "s2", *J.PARITY]

    def run(batch: pa.RecordBatch):
        for a, h, bounds in J._sets_of(batch.column(1)):
            size = np.diff(bounds)
            some = np.flatnonzero(size)
            packed: list[bytes | None] = [None] * len(size)
            for i, x in zip(some.tolist(), signature_rows(h, np.append(bounds[some], len(h)))):
                packed[i] = x.tobytes()
            s1, s2 = J.signatures(h, bounds)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, len(size)), pa.array(size), pa.array(s1), pa.array(s2), *map(pa.array, J.parities(h, bounds)), pa.array(packed, pa.binary())], names=[*names, "signature"])

    return staged(docs.mapInArrow(per_batch(run), ", ".join(f"{c} long" for c in names) + ", signature binary"), "survey", held)


def _levels(signatures: DataFrame, bits: int) -> np.ndarray:
    """The count sketch of all (coordinate, value), as levels."""

    def run(batches):
        counts = np.zeros(1 << bits, np.uint32)
        for batch in batches:
            for a in range(0, batch.num_rows, 4096):
                np.add.at(counts, (tokens(_read(batch.column(0).slice(a, 4096))) >> np.uint64(64 - bits)).astype(np.int64).ravel(), 1)
        yield pa.RecordBatch.from_arrays([pa.array(range(J.SLICES), pa.int32()), pa.array(J._slices(counts), pa.binary())], names=["slice", "part"])

    levels = J._reduced(signatures.mapInArrow(run, "slice int, part binary"), "<u4", np.add, J._levels)
    return levels if len(levels) else np.zeros(1 << bits, np.uint8)


def _postings(level, salts: np.ndarray):
    """Classes (doc, nth, n, signature) as rows (gram, doc, nth, n, pos, salts): the rarest values of each signature."""

    def run(batch: pa.RecordBatch):
        bits = np.uint64(64 - (len(level.value) - 1).bit_length())
        for a in range(0, batch.num_rows, 2048):
            part = batch.slice(a, 2048)
            token = tokens(_read(part.column(3)))
            rare = level.value[(token >> bits).astype(np.int64)]
            order = np.lexsort((token, rare), axis=1)[:, :PREFIX]
            own = [pa.array(np.repeat(part.column(k).to_numpy(), PREFIX).astype(t)) for k, t in ((0, np.int64), (1, np.int32), (2, np.int32))]
            gram = np.take_along_axis(token, order, axis=1).ravel().view(np.int64)
            pos = np.tile(np.arange(PREFIX, dtype=np.int32), part.num_rows)
            dealt = salts[np.take_along_axis(rare, order, axis=1).ravel()]
            yield pa.RecordBatch.from_arrays([pa.array(gram), *own, pa.array(pos), pa.array(dealt)], names=["gram", "doc", "nth", "n", "pos", "salts"])

    return run


def _bits(batch: pa.RecordBatch):
    yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *map(pa.array, nibbles(_read(batch.column("signature"))))], names=["doc", "nth", *J.PARITY, *_BITS])


def near_duplicates(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``df``: its id, n_shingles, component_id, kept (see the module)."""
    spark, held = df.sparkSession, []
    small_batches(spark)
    docs = df.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    classes, members, repeated = J._classes(_survey(docs, held), held, *(F.first(c).alias(c) for c in (*J.PARITY, "signature")))
    bits = J._power(4 * classes.count(), J.SKETCH_BITS)
    level = spark.sparkContext.broadcast(_levels(classes.select("signature"), bits))  # 1 to 16 MB
    own = classes.select(F.col("rep").alias("doc"), F.col("nth").cast("int").alias("nth"), "n", "signature", *J.PARITY)
    grams = own.select("doc", "nth", "n", "signature").mapInArrow(per_batch(_postings(level, J.salts_of(level.value))), "gram long, doc long, nth int, n int, pos int, salts int")
    met = J._met(grams).withColumn("prev", F.lag("gram").over(Window.partitionBy("doc", "nth").orderBy("pos")))
    packed = own.select("doc", "nth", *J.PARITY, "signature").mapInArrow(per_batch(_bits), "doc long, nth int, " + ", ".join(f"{c} long" for c in (*J.PARITY, *_BITS)))
    met = staged(met.join(packed.hint("merge"), ["doc", "nth"]), "met", held)
    found = J._groups(docs, met, members, repeated, _candidate, PERCENT, id_col, held, leaders_of=LEADERS)
    return found.withColumn("kept", F.col(id_col) == F.col("component_id"))
