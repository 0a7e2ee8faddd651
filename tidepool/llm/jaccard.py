"""N-gram Jaccard join by rare-first prefix filtering, and the groups that its links form.

Texts with the same set of shingles are one class, and its smallest doc_id stands
for it.  Shingles are ordered rare first, by a count sketch over all documents
with the hash as tie-break: any fixed order is exact, a better sketch only gives
fewer candidates.  The sketch grows with the corpus (``SKETCH_BITS``), so that
what is frequent stands out from what shares its slot.  Two sets of n and m
shingles link when 100 * common >= 80 * union, that is common >= 4 * (n + m) / 9.
So the first common shingle in that order is among the first n - ceil(8 n / 9) + 1
of the smaller set and the first m - ceil(8 m / 10) + 1 of the larger, and rows
(shingle, document, n, position) of those prefixes meet by shingle.  A pair is a
candidate if it passes

* the length filter: 10 * smaller >= 8 * larger,
* the positional filter: what follows the two positions can still suffice,
* the suffix filter: the sets are cut at fixed pivots of the hash into 64 parts,
  and the smaller part sizes bound what is common,

and is verified once, on whole sets.

A group of k near copies has k * k / 2 links, so links are found in two passes.
The first pairs each row with the ``LEADERS`` documents of its shingle that have
the fewest rarer shingles before it: of near copies, those with the least text of
their own, which link with most others.  Verified links merge most of a group.  The second pairs rows
of one shingle whose documents are still in different components, all of them,
so no component is missed: a pair left out lies inside one component already.
In the second pass pairs must also pass the bitmap filter (``_alike``), so texts that
share phrases by a form and do not link come out of no join.  Rows of a shingle that
the sketch finds frequent are dealt over several tasks (``HOT``) in both passes, and
what they meet goes to each of them.

Shingles are compared by 64-bit hashes of words and of their sequence, and sets by
128 bits.  Two sets of n and m shingles then share a false shingle with a chance
of n * m / 2^64.

Null texts and texts without words have the empty set and link with nothing.
Fewer words than a shingle: the whole sequence is the one shingle.  Repeated rows
are copies.  Rows that share a doc_id are one node, linked if any of their texts
is, and all of them get its component.  Null doc_ids are given no component.  An
empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepool.llm import bytetext as bt
from tidepool.llm.components import components
from tidepool.llm.tables import drop, fresh_name, per_batch, release, small_batches, staged

SHINGLE, PERCENT, LEADERS, BINS, SLICES = 5, 80, 32, 64, 64
#: The sketch has a slot for each ``SLOT_BYTES`` of text, within these powers of two.
SKETCH_BITS, SLOT_BYTES = (20, 24), 1024
#: The filter of documents has 16 bits for each that is wanted, within these powers of two.
FILTER_BITS = (20, 30)
#: A shingle is hot from so many occurrences on, or four times the mean of a slot, and is dealt over as many tasks as it has multiples of that.
HOT, MOST_SALTS = 2048, 4096


# -- sets of shingles -----------------------------------------------------------


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each row, ascending, and their bounds."""
    data = bt.LOWER_ASCII[data]
    starts, lengths, rows = bt.spans_of_words(data, offsets)
    n = len(offsets) - 1
    counts = np.bincount(rows, minlength=n)
    words = bt.span_hashes(data, starts, lengths)
    h, row, _ = bt.windows(words, counts, size)
    first = np.concatenate([[0], np.cumsum(counts)])[:-1]
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        few = bt.mix(words[first[short]] + np.uint64(size))
        for k in range(1, size):
            more = counts[short] > k
            few[more] = bt.mix(few[more] ^ words[first[short[more]] + k]) + np.uint64(k)
        few = bt.mix(few + counts[short].astype(np.uint64))
        h, row = np.concatenate([h, few]), np.concatenate([row, short])
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    h, row = h[new], row[new]
    return h, np.concatenate([[0], np.cumsum(np.bincount(row, minlength=n))])


def signatures(h: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each row's set; zero for the empty set."""
    s1, s2 = np.zeros(len(bounds) - 1, np.uint64), np.zeros(len(bounds) - 1, np.uint64)
    some = np.flatnonzero(np.diff(bounds))
    if len(some):
        s1[some] = np.add.reduceat(bt.mix(h), bounds[some])
        s2[some] = np.bitwise_xor.reduceat(bt.mix(h + np.uint64(0x5851F42D4C957F2D)), bounds[some])
    return s1.view(np.int64), s2.view(np.int64)


#: Columns of a set's parity map.
PARITY = ["p0", "p1", "p2", "p3"]


def parities(h: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
    """256 bits of each row's set, as four longs: whether an odd number of its hashes falls on each.

    Two maps differ in no more bits than the sets have shingles that are not common.
    """
    at = (h >> np.uint64(20)) & np.uint64(255)
    some, out = np.flatnonzero(np.diff(bounds)), np.zeros((4, len(bounds) - 1), np.uint64)
    for k in range(4) if len(some) else ():
        mine = np.where(at >> np.uint64(6) == k, np.uint64(1) << (at & np.uint64(63)), np.uint64(0))
        out[k, some] = np.bitwise_xor.reduceat(mine, bounds[some])
    return list(out.view(np.int64))


def _alike(a: str, b: str, percent: int) -> Column:
    """The bitmap filter: sets of n and m shingles that link have (100 - percent) / (100 + percent) * (n + m) apart at most, and their parity maps differ in no more bits."""
    apart = F.lit(0)
    for c in PARITY:
        apart = apart + F.bit_count(F.col(f"{a}.{c}").bitwiseXOR(F.col(f"{b}.{c}")))
    return (100 + percent) * apart <= (100 - percent) * (F.col(f"{a}.n") + F.col(f"{b}.n"))


def _sets_of(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    data, offsets = bt.buffers(column)
    for a, b in bt.steps(offsets):
        yield (a, *shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]))


# -- arrays of fixed size, reduced over all tasks -----------------------------------


def _slices(array: np.ndarray) -> list[bytes]:
    return [zlib.compress(x.tobytes(), 1) for x in np.split(array, SLICES)]


def _reduced(rows: DataFrame, kind: str, combine, finish=lambda x: x) -> np.ndarray:
    """Combine the sliced arrays of all tasks (slice, part); ``finish`` is applied to each whole slice."""

    def run(batches):
        have: dict[int, np.ndarray] = {}
        for batch in batches:
            for s, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                x = np.frombuffer(zlib.decompress(raw.as_py()), dtype=kind)
                have[s] = combine(have[s], x, dtype=np.int64 if combine is np.add else None) if s in have else x
        if have:
            yield pa.RecordBatch.from_arrays([pa.array(list(have), pa.int32()), pa.array([finish(x).tobytes() for x in have.values()], pa.binary())], names=["slice", "part"])

    got = {r["slice"]: np.frombuffer(bytes(r["part"]), dtype=np.uint8) for r in rows.repartition(SLICES, "slice").mapInArrow(run, "slice int, part binary").collect()}
    return np.concatenate([got[s] for s in range(SLICES)]) if got else np.zeros(0, dtype=np.uint8)


def _levels(counts: np.ndarray) -> np.ndarray:
    """Counts as levels of one byte, eight to a doubling; fewer is rarer."""
    return np.minimum(8 * np.log2(counts.astype(np.float64) + 1), 255).astype(np.uint8)


def _power(n: int, within: tuple[int, int]) -> int:
    """The smallest power of two of at least n, as its exponent, within bounds."""
    return min(max(int(max(n - 1, 0)).bit_length(), within[0]), within[1])


def salts_of(levels: np.ndarray) -> np.ndarray:
    """Into how many tasks each level's rows are dealt; 0 where the rows of a shingle stay together."""
    counts = 2.0 ** (np.arange(256) / 8)
    mean = np.bincount(levels, minlength=256) @ counts / max(len(levels), 1)
    hot = max(HOT, 4 * mean)
    return np.where(counts < hot, 0, np.minimum(np.ceil(2 * counts / hot), MOST_SALTS)).astype(np.int32)


# -- the join ----------------------------------------------------------------------


def _survey(docs: DataFrame, bits: int, held: list[str]) -> DataFrame:
    """A row per document (doc, n, s1, s2, parity map), and each task's sketch by slices (slice, part)."""
    names = ["doc", "n", "s1", "s2", *PARITY, "slice", "part"]

    def run(batches):
        counts = np.zeros(1 << bits, np.uint32)
        for batch in batches:
            for a, h, bounds in _sets_of(batch.column(1)):
                n = len(bounds) - 1
                np.add.at(counts, (h >> np.uint64(64 - bits)).astype(np.int64), 1)
                s1, s2 = signatures(h, bounds)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, n), pa.array(np.diff(bounds)), pa.array(s1), pa.array(s2), *map(pa.array, parities(h, bounds)), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names=names)
        release()
        longs = pa.nulls(SLICES, pa.int64())
        yield pa.RecordBatch.from_arrays([longs] * 8 + [pa.array(range(SLICES), pa.int32()), pa.array(_slices(counts), pa.binary())], names=names)

    return staged(docs.mapInArrow(run, ", ".join(f"{c} long" for c in names[:8]) + ", slice int, part binary"), "survey", held)


def _prefixes(docs: DataFrame, level) -> DataFrame:
    """Per document with a set: doc, s1, s2, n and its prefix, rare first, packed.  ``level``: the broadcast sketch."""

    def run(batch: pa.RecordBatch):
        bits = np.uint64(64 - (len(level.value) - 1).bit_length())
        for a, h, bounds in _sets_of(batch.column(1)):
            size = np.diff(bounds)
            row = bt.row_of(bounds, len(h))
            order = np.lexsort((h, level.value[(h >> bits).astype(np.int64)], row))
            held = np.flatnonzero(size)
            keep = size + 1 + (-8 * size // 10)  # n - ceil(8 n / 10) + 1
            packed = [h[order[bounds[i] : bounds[i] + keep[i]]].tobytes() for i in held]
            s1, s2 = signatures(h, bounds)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, len(size)).take(pa.array(held)), pa.array(s1[held]), pa.array(s2[held]), pa.array(size[held]), pa.array(packed, pa.binary())], names=["doc", "s1", "s2", "n", "prefix"])

    return docs.mapInArrow(per_batch(run), "doc long, s1 long, s2 long, n long, prefix binary")


def _unpacked(level, salts: np.ndarray):
    """Packed prefixes as rows (gram, doc, nth, n, pos, salts)."""

    def run(batch: pa.RecordBatch):
        bits = np.uint64(64 - (len(level.value) - 1).bit_length())
        for a in range(0, batch.num_rows, 1024):
            part = batch.slice(a, 1024)
            raw = part.column(3).to_pylist()
            size = np.array([len(x) // 8 for x in raw])
            pos = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            h = np.frombuffer(b"".join(raw), dtype=np.uint64)
            own = [pa.array(np.repeat(part.column(k).to_numpy(), size).astype(t)) for k, t in ((0, np.int64), (1, np.int32), (2, np.int32))]
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), *own, pa.array(pos.astype(np.int32)), pa.array(salts[level.value[(h >> bits).astype(np.int64)]])], names=["gram", "doc", "nth", "n", "pos", "salts"])

    return run


def _without_singles(batches):
    """Rows, ordered by gram, whose gram another row has too (or may have, in another task): one streaming pass that holds no group."""
    last, last_gram, last_out = None, None, True  # the last row of the batch before, whether it went out
    for batch in batches:
        if not batch.num_rows:
            continue
        gram = batch.column(0).to_numpy()
        keep = batch.column(5).to_numpy() > 0
        same = gram[1:] == gram[:-1]
        keep[1:] |= same
        keep[:-1] |= same
        if last is not None and gram[0] == last_gram:
            if not last_out:
                yield last
            keep[0] = True
        out = batch.filter(pa.array(keep))
        if out.num_rows:
            yield out
        last, last_gram, last_out = batch.slice(len(gram) - 1, 1), gram[-1], bool(keep[-1])


def _needed(n, m):
    """ceil(4 (n + m) / 9)."""
    return F.floor((4 * (n + m) + 8) / 9)


def _candidate(a: str, b: str):
    """Length and positional filters, and the index prefix of the smaller set, for rows aliased a and b.

    Rows whose documents share the shingle before as well (``prev``) are passed
    over: the pair meets there already, and at its first common shingle at last.
    """
    c = lambda t, k: F.col(f"{t}.{k}")
    a_less = (c(a, "n") < c(b, "n")) | ((c(a, "n") == c(b, "n")) & (c(a, "doc") < c(b, "doc")))
    short_n, long_n = F.least(c(a, "n"), c(b, "n")), F.greatest(c(a, "n"), c(b, "n"))
    short_pos = F.when(a_less, c(a, "pos")).otherwise(c(b, "pos"))
    left = F.least(c(a, "n") - c(a, "pos"), c(b, "n") - c(b, "pos"))
    first = c(a, "prev").isNull() | c(b, "prev").isNull() | (c(a, "prev") != c(b, "prev"))
    return first & (10 * short_n >= 8 * long_n) & (left >= _needed(short_n, long_n)) & (short_pos < short_n - F.floor((8 * short_n + 8) / 9) + 1)


def _sets_table(docs: DataFrame, wanted: DataFrame, repeats: bool, held: list[str]) -> DataFrame:
    """The whole sets of the ``wanted`` documents (doc, each once), and of a few others: doc, n, bins, grams.

    A bit filter drops most others before the texts are parsed, so that no text is
    shuffled; joins pass over what it lets through wrongly.  ``repeats``: whether an
    id may have several rows, whose equal sets are then kept once.
    """
    bits = _power(16 * wanted.count(), FILTER_BITS)
    size = 1 << bits
    slot = lambda ids: (bt.mix(ids.astype(np.int64).view(np.uint64) + np.uint64(1)) >> np.uint64(64 - bits)).astype(np.int64)
    bit = lambda at: (128 >> (at & 7)).astype(np.uint8)

    def mark(batches):
        marks = np.zeros(size // 8, np.uint8)
        for batch in batches:
            at = slot(batch.column(0).to_numpy())
            np.bitwise_or.at(marks, at >> 3, bit(at))
        if marks.any():
            yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array(_slices(marks), pa.binary())], names=["slice", "part"])

    marks = _reduced(wanted.mapInArrow(mark, "slice int, part binary"), "u1", np.bitwise_or)
    marks = docs.sparkSession.sparkContext.broadcast(marks if len(marks) else np.zeros(size // 8, np.uint8))  # 128 MB at most

    def run(batch: pa.RecordBatch):
        at = slot(batch.column(0).to_numpy())
        batch = batch.filter(pa.array(marks.value[at >> 3] & bit(at) > 0))
        for a, h, bounds in _sets_of(batch.column(1)):
            n = len(bounds) - 1
            part = bt.row_of(bounds, len(h)) * BINS + (h >> np.uint64(58)).astype(np.int64)
            bins = np.bincount(part, minlength=n * BINS).reshape(n, BINS).astype("<i4")
            s1, s2 = signatures(h, bounds)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, n), pa.array(np.diff(bounds)), pa.array(s1), pa.array(s2), pa.array([x.tobytes() for x in bins], pa.binary()), pa.array([h[bounds[i] : bounds[i + 1]].tobytes() for i in range(n)], pa.binary())], names=["doc", "n", "s1", "s2", "bins", "grams"])

    sets = docs.where("doc IS NOT NULL").mapInArrow(per_batch(run), "doc long, n long, s1 long, s2 long, bins binary, grams binary")
    sets = sets.dropDuplicates(["doc", "s1", "s2"]) if repeats else sets
    return staged(sets.drop("s1", "s2"), "sets", held)


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (x, y) with 100 * common >= percent * union: suffix filter, then verification on whole sets.

    Sets grow with the corpus, so they are joined by a shuffle at every size and never broadcast.
    """
    size = lambda s: F.col(s).alias(s)
    part = lambda k: sets.select(F.col("doc").alias(k), F.col("n").alias(f"n{k}"), F.col("bins").alias(f"b{k}")).hint("merge")

    def bounded(batch: pa.RecordBatch):
        n = batch.column(2).to_numpy() + batch.column(4).to_numpy()
        b = [np.frombuffer(b"".join(batch.column(k).to_pylist()), dtype="<i4").reshape(-1, BINS) for k in (3, 5)]
        most = np.minimum(b[0], b[1]).sum(axis=1)
        yield batch.select(["x", "y"]).filter(pa.array((100 + percent) * most >= percent * n))

    pairs = pairs.join(part("x"), "x").join(part("y"), "y").select("x", "y", "nx", "bx", "ny", "by").mapInArrow(per_batch(bounded), "x long, y long")
    whole = lambda k: sets.select(F.col("doc").alias(k), F.col("grams").alias(f"g{k}")).hint("merge")

    def verify(batch: pa.RecordBatch):
        keep = []
        for a, b in zip(batch.column(2), batch.column(3)):
            g, h = (np.frombuffer(z.as_py(), dtype=np.uint64) for z in (a, b))
            s = np.sort(np.concatenate([g, h]))
            keep.append((100 + percent) * int((s[1:] == s[:-1]).sum()) >= percent * len(s))
        yield batch.select(["x", "y"]).filter(pa.array(keep, pa.bool_()))

    return pairs.join(whole("x"), "x").join(whole("y"), "y").select(size("x"), size("y"), "gx", "gy").mapInArrow(per_batch(verify), "x long, y long").distinct()


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("x", "y")).alias("doc")).distinct()


def _ordered(a: str, b: str) -> list:
    return [F.least(F.col(f"{a}.doc"), F.col(f"{b}.doc")).alias("x"), F.greatest(F.col(f"{a}.doc"), F.col(f"{b}.doc")).alias("y")]


def _classes(found: DataFrame, held: list[str], *more) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of rows (doc, n, s1, s2): the classes of equal sets (rep, nth, n, s1, s2, and ``more`` of each), each row's class (doc, n, rep), and ids with several rows.

    ``nth``: the place of a class among those that one document stands for (nearly always it stands for one).
    """
    classes = found.where("n > 0 AND doc IS NOT NULL").groupBy("s1", "s2", "n").agg(F.min("doc").alias("rep"), *more)
    classes = staged(classes.withColumn("nth", F.row_number().over(Window.partitionBy("rep").orderBy("s1", "s2", "n"))), "classes", held)
    members = staged(found.join(classes.select("s1", "s2", "n", "rep"), ["s1", "s2", "n"], "left").select("doc", "n", "rep"), "members", held)
    repeated = members.where("doc IS NOT NULL").groupBy("doc").agg(F.count("*").alias("rows"), F.min("rep").alias("low"), F.max("rep").alias("high"), F.count("rep").alias("filled")).where("rows > 1")
    return classes, members, staged(repeated, "repeated", held)


def _salt() -> Column:
    """To which of its shingle's tasks a row goes."""
    return F.when(F.col("salts") > 0, F.pmod(F.xxhash64("doc"), F.col("salts"))).otherwise(F.lit(-1)).cast("int")


def _everywhere(rows: DataFrame) -> DataFrame:
    """Rows copied to each of their shingle's tasks."""
    return rows.withColumn("salt", F.explode(F.when(F.col("salts") > 0, F.sequence(F.lit(0), F.col("salts") - 1)).otherwise(F.array(F.lit(-1)))))


def _met(grams: DataFrame) -> DataFrame:
    """Rows whose gram other rows have too."""
    return grams.repartition(F.col("gram"), _salt()).sortWithinPartitions("gram").mapInArrow(_without_singles, grams.schema)


def _groups(docs: DataFrame, met: DataFrame, members: DataFrame, repeated: DataFrame, candidate, percent: int, id_col: str, held: list[str], leaders_of: int = 0, maps: DataFrame | None = None) -> DataFrame:
    """id, n_shingles, component_id of each row, by the links among documents that meet (rows of ``met``) and are candidates.

    ``maps``: doc, nth and their parity maps, for the bitmap filter in the second pass.
    """
    repeats = not repeated.isEmpty()

    # pass 1: each row with a few leaders of its shingle
    draw = Window.partitionBy("gram").orderBy("pos", F.xxhash64("doc"), "doc", "nth")
    leaders = _everywhere(met.withColumn("place", F.row_number().over(draw)).where(F.col("place") <= (leaders_of or LEADERS)).drop("place"))
    first = met.withColumn("salt", _salt()).alias("a").join(leaders.hint("merge").alias("b"), ["gram", "salt"]).where(F.col("a.doc") != F.col("b.doc")).where(candidate("a", "b")).select(*_ordered("a", "b")).distinct()
    tried = staged(first, "pairs", held)
    links = staged(_linked(tried, _sets_table(docs, _ends(tried), repeats, held), percent), "links", held)
    # the classes of one document are one node
    apart = members.join(repeated.where("low < high").select("doc", "low"), "doc").where("rep > low").select(F.col("low").alias("x"), F.col("rep").alias("y")).distinct()
    links = links.union(apart)
    merged = staged(components(links.select(F.col("x").alias("u"), F.col("y").alias("v")), held), "merged", held)

    # pass 2: rows of one shingle in different components, all of them; hot shingles are dealt out here too
    known = met.join(merged.withColumnRenamed("node", "doc").hint("merge"), "doc", "left").withColumn("component", F.coalesce("component", "doc"))
    known = staged(known, "known", held)
    mixed = known.groupBy("gram").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a <> b").select("gram")
    rest = known.join(mixed.hint("merge"), "gram", "left_semi")
    alike = F.lit(True)
    if maps is not None:
        rest, alike = rest.join(maps.hint("merge"), ["doc", "nth"]), _alike("a", "b", percent)
    across = rest.withColumn("salt", _salt()).alias("a").join(_everywhere(rest).alias("b"), ["gram", "salt"])
    across = across.where((F.col("a.component") != F.col("b.component")) & (F.col("a.doc") < F.col("b.doc"))).where(candidate("a", "b") & alike)
    second = staged(across.select(*_ordered("a", "b")).distinct().join(tried, ["x", "y"], "left_anti"), "pairs", held)
    links2 = staged(_linked(second, _sets_table(docs, _ends(second), repeats, held), percent), "links", held)

    # rows without words follow their document's other rows
    final = components(links.union(links2).select(F.col("x").alias("u"), F.col("y").alias("v")), held).withColumnRenamed("node", "rep")
    bare = members.where("rep IS NULL").join(repeated.where("filled > 0").select("doc", F.col("low").alias("other")), "doc", "left").select("doc", "n", F.col("other").alias("rep"))
    out = members.where("rep IS NOT NULL").unionByName(bare).join(final, "rep", "left")
    component = F.when(F.col("doc").isNotNull(), F.coalesce("component", "rep", "doc"))
    out = staged(out.select(F.col("doc").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id")), "groups")
    drop(docs.sparkSession, held)
    return out


def similar_groups(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``df``: its id, n_shingles, component_id (see the module)."""
    spark, held = df.sparkSession, []
    small_batches(spark)
    docs = df.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = _power(size // SLOT_BYTES, SKETCH_BITS)
    survey = _survey(docs, bits, held)
    found = survey.where("slice IS NULL").select("doc", "n", "s1", "s2", *PARITY)
    levels = _reduced(survey.where("slice IS NOT NULL").select("slice", "part"), "<u4", np.add, _levels)
    level = spark.sparkContext.broadcast(levels if len(levels) else np.zeros(1 << bits, np.uint8))  # 1 to 16 MB
    classes, members, repeated = _classes(found, held, *(F.first(c).alias(c) for c in PARITY))

    reps = classes.select(F.col("rep").alias("doc"), "s1", "s2", "nth")
    packed = _prefixes(docs.where("doc IS NOT NULL"), level).join(reps.hint("merge"), ["doc", "s1", "s2"])
    packed = packed if repeated.isEmpty() else packed.dropDuplicates(["doc", "s1", "s2"])
    grams = packed.select("doc", "nth", "n", "prefix").mapInArrow(per_batch(_unpacked(level, salts_of(level.value))), "gram long, doc long, nth int, n int, pos int, salts int")
    met = staged(_met(grams).withColumn("prev", F.lag("gram").over(Window.partitionBy("doc", "nth").orderBy("pos"))), "met", held)
    maps = classes.select(F.col("rep").alias("doc"), "nth", *PARITY)
    return _groups(docs, met, members, repeated, _candidate, PERCENT, id_col, held, maps=maps)


def one_of_each(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` whose id is the smallest of their component, one a document, with all their columns.  Rows without an id stay."""
    groups = similar_groups(df, id_col=id_col, text_col=text_col)
    gone = groups.where(F.col(id_col) != F.col("component_id")).select(id_col).distinct()
    left = df.join(gone, id_col, "left_anti").select(df.columns)
    again = groups.where(F.col(id_col).isNotNull()).groupBy(id_col).count().where("count > 1").select(id_col)
    if again.isEmpty():
        return left
    place = fresh_name(df, "__place")
    own = Window.partitionBy(id_col).orderBy(F.xxhash64(text_col), text_col)
    one = left.join(again, id_col, "left_semi").withColumn(place, F.row_number().over(own)).where(F.col(place) == 1).drop(place)
    return left.join(again, id_col, "left_anti").select(df.columns).unionByName(one.select(df.columns))
