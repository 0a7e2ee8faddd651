"""Repair of conversation structure: cheapest edits that make the roles alternate, found once per distinct signature.

A row of a conversation is *blank* (no character but spaces), a *duplicate* (role and
text seen earlier), *truncated* (its last such character is not one of ``.!?``) or
sound; the first of these counts.  Edits: Keep (0), Rerole to user or assistant (2),
Delete (3; blank rows and duplicates must go), Insert an empty user or assistant turn
(2); a truncated row that stays adds 1.  The result's role initials are ``s?(ua)+``, or
nothing is left.  Of cheapest edits those with the ASCII-least initials are taken.

1. Rows are reduced to a letter for role and fault, with hashes of their text in its
   place; rows that are equal in all are counted before the shuffle.
2. They are sorted by range, so that one long conversation lies in many tasks, and each
   run of letters becomes a piece of its conversation's *signature*.
3. Each distinct signature is solved once, by a recursion over (row, last role) with a
   memo, and its audit is joined back to the conversations (``join_back``: a signature
   that many share is dealt over many tasks).
4. Audits meet the texts, sorted by conversation; a task streams them and replays the
   edits.  It holds one audit, a byte for each edit, and one batch of rows.  This is the
   only shuffle of texts.  A conversation is replayed in one task, as its digest is a
   hash of the turns one after another.

Order of rows: turn (nulls first), then role, then a hash of role and text; so turns
that tie have one order, and equal rows stand together.  Null roles and texts count as
one space.  Null ids are one conversation.  Distinct texts of one conversation are told
apart by 128 bits.  ``gaps`` is null only where turns are so far apart that their
distance is beyond 64 bits.  An empty table gives an empty result.  Other columns are not read.
"""

from __future__ import annotations

import hashlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepool.llm.tables import join_back, per_batch, release, small_batches, staged

#: Letters of a signature by fault; within each by role initial: s, u, a, another.
SOUND, TRUNCATED, BLANK, DUPLICATE = "suao", "SUAO", "0123", "4567"
_SPACE = " \t\n\x0b\f\r"
KEEP, REROLE, DELETE, INSERT, CUT = 0, 2, 3, 2, 1
#: Last role of what is put out so far (nothing, s, u, a), and the turn that an insertion or new role makes of it.
_NOTHING, _S, _U, _A = range(4)
_NEXT = (_U, _U, _A, _U)
_ROLE = {_U: "user", _A: "assistant"}
_FINAL = (0, None, None, 0)
_STRIDE = 128


# -- one signature ------------------------------------------------------------------


def cheapest(signature: str) -> tuple[int, str]:
    """(cost, audit) of the cheapest edits of a signature."""
    n = len(signature)
    memo = array("q", bytes(32 * (n + 1)))  # cost + 1 of what follows a row that is used up next, by last role; 0: not known yet

    def used(i: int, last: int) -> float:
        """The cost from row i on, when no turn is inserted before it."""
        if i == n:
            return 0 if last in (_NOTHING, _A) else float("inf")
        at = 4 * i + last
        if not memo[at]:
            memo[at] = min(cost + from_row(i + 1, to) for _, cost, to in uses(i, last)) + 1
        return memo[at] - 1

    def uses(i: int, last: int):
        """(edit, cost, last role after it) of each edit that uses up row i, in ASCII order."""
        yield "D", DELETE, last
        letter = signature[i]
        if letter in SOUND or letter in TRUNCATED:
            stay = CUT if letter in TRUNCATED else 0
            role = {"s": _S, "u": _U, "a": _A}.get(letter.lower())
            if role == _NEXT[last] or (role == _S and last == _NOTHING):
                yield "K", KEEP + stay, role
            yield "R", REROLE + stay, _NEXT[last]

    def from_row(i: int, last: int) -> float:
        """The cost from row i on: more than two insertions in a row come back to the same role."""
        once = _NEXT[last]
        return min(used(i, last), INSERT + used(i, once), 2 * INSERT + used(i, _NEXT[once]))

    for i in range(n - n % _STRIDE, -1, -_STRIDE):  # from the end, so that the recursion stays shallow
        for last in range(4):
            used(i, last)
    audit, i, last, total = [], 0, _NOTHING, from_row(0, _NOTHING)
    rest = total
    while i < n or last not in (_NOTHING, _A):
        ways = [(e, c, i + 1, to) for e, c, to in uses(i, last)] if i < n else []
        ways.append(("I", INSERT, i, _NEXT[last]))
        edit, cost, i, last = min(w for w in ways if w[1] + from_row(w[2], w[3]) == rest)
        rest -= cost
        audit.append(edit)
    return int(total), "".join(audit)


def faults(signature: str) -> tuple[int, int, int, int]:
    """Rows of a signature that are blank, duplicates, truncated; neighbours whose role initials are not su, ua or au."""
    kinds = (sum(signature.count(x) for x in letters) for letters in (BLANK, DUPLICATE, TRUNCATED))
    roles = signature.translate(str.maketrans(TRUNCATED + BLANK + DUPLICATE, 3 * SOUND))
    return (*kinds, max(len(roles) - 1, 0) - sum(roles.count(x) for x in ("su", "ua", "au")))


def _solved(batch: pa.RecordBatch):
    signatures = batch.column(0).to_pylist()
    counts = [pa.array(x, pa.int64()) for x in zip(*map(faults, signatures))]
    cost, audit = zip(*map(cheapest, signatures))
    yield pa.RecordBatch.from_arrays([*batch.columns, *counts, pa.array(cost, pa.int64()), pa.array(audit, pa.string())], names=["signature", "n", "blank", "duplicate", "truncated", "illegal", "cost", "audit"])


# -- signatures of conversations ---------------------------------------------------------


def _ordered_rows(df: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """conv, turn, role, text and two hashes of role and text."""
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = df.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), filled(role_col).alias("role"), filled(text_col).alias("text"))
    return rows.withColumn("k1", F.xxhash64("role", "text")).withColumn("k2", F.xxhash64("text", F.lit(0), "role"))


ORDER = ["conv", "turn", "role", "k1", "k2"]


def _letter(role: Column, text: Column) -> Column:
    """The letter of a row by itself; duplicates are found later."""
    kind = F.position(F.substring(role, 1, 1), F.lit(SOUND[:3]))
    kind = F.when((F.length(role) == 0) | (kind == 0), 4).otherwise(kind)
    said = F.rtrim(text, F.lit(_SPACE))
    letters = F.when(F.length(said) == 0, BLANK).when(F.substring(said, -1, 1).isin(".", "!", "?"), SOUND).otherwise(TRUNCATED)
    return F.substring(letters, kind, 1)


_REPEAT = np.arange(256, dtype=np.uint8)
for _of in (SOUND, TRUNCATED):
    _REPEAT[list(_of.encode())] = list(DUPLICATE.encode())


def _runs(column: pa.Array) -> np.ndarray:
    """Numbers that are equal for equal neighbours of any type, nulls included."""
    return column.dictionary_encode(null_encoding="encode").indices.to_numpy()


def _pieces(batch: pa.RecordBatch):
    """Sorted rows (conv, turn, role, k1, k2, letter, earlier, m) as pieces of signatures, one for each run of a conversation in a batch."""
    change = np.flatnonzero(np.diff(_runs(batch.column(0)))) + 1
    starts, ends = np.concatenate([[0], change]), np.concatenate([change, [batch.num_rows]])
    letter = np.frombuffer("".join(batch.column(5).to_pylist()).encode(), np.uint8)
    again = _REPEAT[letter]
    letter = np.where(batch.column(6).to_numpy(zero_copy_only=False), again, letter)
    m = batch.column(7).to_numpy()
    at = np.cumsum(m) - m
    letters = np.repeat(again, m)
    letters[at] = letter
    text, bounds = letters.tobytes().decode(), np.append(at, len(letters))
    turn = batch.column(1)
    known = turn.is_valid().to_numpy(zero_copy_only=False)
    new = np.ones(len(m), bool)
    new[1:] = np.diff(_runs(turn)) != 0
    new[starts] = True
    turns = np.add.reduceat((new & known).astype(np.int64), starts)
    first = starts + np.add.reduceat((~known).astype(np.int64), starts)  # nulls come first
    none = first >= ends
    least = turn.take(pa.array(np.where(none, starts, first)))
    most = turn.take(pa.array(ends - 1))
    begin = batch.take(pa.array(starts))
    signature = pa.array([text[bounds[a] : bounds[b]] for a, b in zip(starts, ends)], pa.string())
    yield pa.RecordBatch.from_arrays([*begin.columns[:5], pa.array(turns), least, most, signature], names=[*ORDER, "turns", "least", "most", "piece"])


def audits(df: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Per conversation of ``df``: conv, gaps, blank, duplicate, truncated, illegal, cost, audit."""
    small_batches(df.sparkSession)
    rows = _ordered_rows(df, conv_col, turn_col, role_col, text_col)
    rows = rows.select(*ORDER, _letter(F.col("role"), F.col("text")).alias("letter")).groupBy(*ORDER, "letter").agg(F.count("*").alias("m"))
    first = rows.groupBy("conv", "k1", "k2").agg(F.min(F.struct(F.col("turn").isNotNull().alias("known"), "turn")).alias("first"))
    first = first.select(F.col("conv").alias("c"), F.col("first.turn").alias("t"), F.col("k1").alias("x1"), F.col("k2").alias("x2"), F.lit(True).alias("is_first"))
    same = F.col("conv").eqNullSafe(F.col("c")) & F.col("turn").eqNullSafe(F.col("t")) & (F.col("k1") == F.col("x1")) & (F.col("k2") == F.col("x2"))
    rows = rows.join(first, same, "left").select(*ORDER, "letter", F.col("is_first").isNull().alias("earlier"), "m")
    conv = df.schema[conv_col].dataType.simpleString()
    pieces = rows.repartitionByRange(*ORDER).sortWithinPartitions(*ORDER).mapInArrow(per_batch(_pieces), f"conv {conv}, turn long, role string, k1 long, k2 long, turns long, least long, most long, piece string")
    whole = pieces.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct(*ORDER[1:], "turns", "least", "most", "piece"))).alias("p"))
    of = lambda name: F.transform("p", lambda x: x[name])
    shared = F.size(F.filter(F.zip_with(F.slice(of("least"), 2, F.size("p")), F.slice(of("most"), 1, F.size("p") - 1), lambda a, b: a == b), lambda x: x))
    distinct = F.aggregate(of("turns"), F.lit(0).cast("long"), lambda a, b: a + b) - shared
    far = F.try_subtract(F.array_max(of("most")), F.array_min(of("least")))
    gaps = F.when(F.array_max(of("most")).isNull(), 0).otherwise(F.try_subtract(far, distinct - 1))
    convs = staged(whole.select("conv", gaps.cast("long").alias("gaps"), F.array_join(of("piece"), "").alias("signature")), "signatures")
    distinct_ones = convs.groupBy("signature").agg(F.count("*").alias("n"))
    solved = staged(distinct_ones.mapInArrow(per_batch(_solved), "signature string, n long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"), "audits")
    return join_back(convs, solved, "signature", spread="conv").drop("signature")


# -- replay ----------------------------------------------------------------------------------


def _turns(batches):
    """The repaired conversations of a task, from rows sorted by (conv, kind), the audit first: ('begin', conv), then ('turn', (role, text)) and so on."""
    audit, at, last = "", 0, _NOTHING

    def inserted():
        nonlocal at, last
        while at < len(audit) and audit[at] == "I":
            at, last = at + 1, _NEXT[last]
            yield "turn", (_ROLE[last], "")

    for batch in batches:
        for conv, kind, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv", "kind", "role", "text"))):
            yield from inserted()
            if kind == 0:
                yield "begin", conv
                audit, at, last = text, 0, _NOTHING
                continue
            edit, at = audit[at], at + 1
            if edit == "K":
                last = {"s": _S, "u": _U, "a": _A}[role[0]]
                yield "turn", (role, text)
            elif edit == "R":
                last = _NEXT[last]
                yield "turn", (_ROLE[last], text)
    yield from inserted()


def _replayed(df: DataFrame, found: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Texts behind the audit of their conversation, in the order of replay."""
    rows = _ordered_rows(df, **columns).withColumn("kind", F.lit(1))
    audit = found.select("conv", F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.col("audit").alias("text"), F.lit(0).cast("long").alias("k1"), F.lit(0).cast("long").alias("k2"), F.lit(0).alias("kind"))
    return rows.unionByName(audit).repartition("conv").sortWithinPartitions("conv", "kind", *ORDER[1:]).select("conv", "kind", "role", "text")


_COLUMNS = {"conv_col": "conv_id", "turn_col": "turn", "role_col": "role", "text_col": "text"}
_OUT_BYTES, _OUT_ROWS = 1 << 20, 4096


def repaired_turns(df: DataFrame, found: DataFrame, **columns: str) -> DataFrame:
    """The repaired conversations (conv, place from 0, role, text), given ``audits(df)``; of conversations that end empty there is no row."""
    columns = _COLUMNS | columns
    conv = df.schema[columns["conv_col"]].dataType.simpleString()

    def run(batches):
        kind, rows, size, now, place = None, [], 0, None, 0

        def batch():
            c, p, r, t = zip(*rows)
            return pa.RecordBatch.from_arrays([pa.array(c, kind), pa.array(p, pa.int64()), pa.array(r, pa.string()), pa.array(t, pa.string())], names=["conv", "place", "role", "text"])

        def seen():
            nonlocal kind
            for b in batches:
                kind = b.schema.field("conv").type
                yield b

        for what, value in _turns(seen()):
            if what == "begin":
                now, place = value, 0
                continue
            rows.append((now, place, *value))
            place, size = place + 1, size + len(value[1])
            if size > _OUT_BYTES or len(rows) >= _OUT_ROWS:
                yield batch()
                rows, size = [], 0
        if rows:
            yield batch()
        release()

    return _replayed(df, found, columns).mapInArrow(run, f"conv {conv}, place long, role string, text string")


def repaired_digests(df: DataFrame, found: DataFrame, **columns: str) -> DataFrame:
    """Per conversation: conv and the sha256 of its repaired turns ``role:text``, joined by newlines and hashed as they stream by."""
    columns = _COLUMNS | columns
    conv = df.schema[columns["conv_col"]].dataType.simpleString()

    def run(batches):
        kind, done, state, now = None, [], None, None

        def batch():
            c, h = zip(*done)
            return pa.RecordBatch.from_arrays([pa.array(c, kind), pa.array(h, pa.string())], names=["conv", "repaired_sha256"])

        def seen():
            nonlocal kind
            for b in batches:
                kind = b.schema.field("conv").type
                yield b

        for what, value in _turns(seen()):
            if what == "begin":
                if state is not None:
                    done.append((now, state.hexdigest()))
                if len(done) >= _OUT_ROWS:
                    yield batch()
                    done = []
                state, now, empty = hashlib.sha256(), value, True
                continue
            state.update(("" if empty else "\n").encode() + f"{value[0]}:{value[1]}".encode())
            empty = False
        if state is not None:
            done.append((now, state.hexdigest()))
            yield batch()
        release()

    return _replayed(df, found, columns).mapInArrow(run, f"conv {conv}, repaired_sha256 string")
