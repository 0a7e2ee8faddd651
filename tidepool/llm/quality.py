"""Quality rules as a short-circuit cascade.

A document is kept if no rule rejects it.  On a bounded sample the cost (seconds a
MB) of each measure, and of the words and hashes that measures share, is taken
apart, and each document's rejecting rules are noted.  Rules are then ordered one
after the other: the next one rejects most of what the earlier ones left, for what
it costs beyond what they have paid already.  Each runs on the documents that all
earlier ones let pass.  The verdict is a conjunction, so the order changes the work
and not the result.  A measure that several rules or the caller need is taken once.

Words are ``[^\\x20\\x09-\\x0D]+``.  Words and lines are compared by 64-bit hashes of
their bytes and length, within one text: n of them hold a false repeat with a
chance of n * n / 2^65 (for a text of 1 MB below 10^-8).  Null and empty texts have
no words and are rejected.  Very long texts are judged whole, each as a step of its own.
Rows are judged one by one: ties, repeats and empty
tables need no rule.  Columns other than the id and the text are passed on
(``keep_documents``) or not read (``quality_cascade``).
"""

from __future__ import annotations

import time
from collections import Counter
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.llm import bytetext as bt
from tidepool.llm.tables import per_batch, small_batches

WINDOW, SAMPLE_DOCS = 8, 512
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_LETTER = np.zeros(256, dtype=bool)
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = _LETTER[0x80:] = True


class Texts:
    """Some rows of text and the word spans that measures share."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets, self.n = data, offsets, len(offsets) - 1
        self._words = self._hashes = None

    def words(self):
        if self._words is None:
            starts, lengths, rows = bt.spans_of_words(self.data, self.offsets)
            self._words = starts, lengths, rows, np.bincount(rows, minlength=self.n)
        return self._words

    def hashes(self) -> np.ndarray:
        if self._hashes is None:
            starts, lengths, _, _ = self.words()
            self._hashes = bt.span_hashes(self.data, starts, lengths)
        return self._hashes

    def sums(self, of_bytes: np.ndarray) -> np.ndarray:
        """How many marked bytes each row has."""
        total = np.concatenate([[0], np.cumsum(of_bytes)])
        return total[self.offsets[1:]] - total[self.offsets[:-1]]

    def take(self, rows: np.ndarray) -> Texts:
        size = np.diff(self.offsets)
        mark = np.zeros(self.n, dtype=bool)
        mark[rows] = True
        return Texts(self.data[np.repeat(mark, size)], np.concatenate([[0], np.cumsum(size[mark])]))


def n_words(t: Texts) -> np.ndarray:
    return t.words()[3]


def word_chars(t: Texts) -> np.ndarray:
    return t.sums(~bt.IS_SPACE[t.data] & ((t.data & 0xC0) != 0x80))


def n_symbols(t: Texts) -> np.ndarray:
    return t.sums(_SYMBOL[t.data])


def _lines(t: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Rows and hashes of the lines that hold a word."""
    if not len(t.data):
        z = np.zeros(0, np.int64)
        return z, z.astype(np.uint64)
    feed = np.flatnonzero(t.data == 0x0A)
    starts = np.unique(np.concatenate([t.offsets[:-1], feed + 1]))
    starts = starts[starts < len(t.data)]
    rows = np.searchsorted(t.offsets, starts, side="right") - 1
    ends = np.minimum(np.append(feed, len(t.data))[np.searchsorted(feed, starts)], t.offsets[rows + 1])
    solid = np.concatenate([[0], np.cumsum(~bt.IS_SPACE[t.data])])
    held = solid[ends] > solid[starts]
    starts, ends = starts[held], ends[held]
    return rows[held], bt.span_hashes(t.data, starts, ends - starts)


def n_lines(t: Texts) -> np.ndarray:
    return np.bincount(_lines(t)[0], minlength=t.n)


def n_dup_lines(t: Texts) -> np.ndarray:
    rows, h = _lines(t)
    order = np.lexsort((h, rows))
    rows, h = rows[order], h[order]
    again = np.zeros(len(h), dtype=bool)
    again[1:] = (h[1:] == h[:-1]) & (rows[1:] == rows[:-1])
    return np.bincount(rows[again], minlength=t.n)


def n_repeat_words(t: Texts) -> np.ndarray:
    _, _, rows, counts = t.words()
    h, row, at = bt.windows(t.hashes(), counts, WINDOW)
    if not len(h):
        return np.zeros(t.n, np.int64)
    h = bt.mix(h ^ (row.astype(np.uint64) << np.uint64(40)))
    s = np.sort(h)
    twice = np.unique(s[1:][s[1:] == s[:-1]])
    if not len(twice):
        return np.zeros(t.n, np.int64)
    k = np.minimum(np.searchsorted(twice, h), len(twice) - 1)
    at = at[twice[k] == h]
    cover = np.bincount(at, minlength=len(rows) + 1) - np.bincount(at + WINDOW, minlength=len(rows) + 1)
    return np.bincount(rows[np.cumsum(cover)[: len(rows)] > 0], minlength=t.n)


def n_letter_words(t: Texts) -> np.ndarray:
    """Words with an ASCII letter or any character beyond ASCII."""
    starts, lengths, rows, _ = t.words()
    total = np.concatenate([[0], np.cumsum(_LETTER[t.data])])
    return np.bincount(rows[total[starts + lengths] > total[starts]], minlength=t.n)


def n_stutters(t: Texts) -> np.ndarray:
    """Words equal to the word before."""
    _, _, rows, _ = t.words()
    h = t.hashes()
    return np.bincount(rows[1:][(h[1:] == h[:-1]) & (rows[1:] == rows[:-1])], minlength=t.n)


MEASURES: dict[str, Callable[[Texts], np.ndarray]] = {f.__name__: f for f in (n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_letter_words, n_stutters)}

#: What a measure uses of a text's shared parts; they are found once for all measures.
SHARED = {"n_words": ("words",), "n_repeat_words": ("words", "hashes"), "n_letter_words": ("words",), "n_stutters": ("words", "hashes")}


@dataclass(frozen=True)
class Rule:
    """Rejects where ``share``% of measure ``whole`` lies on the wrong side of measure ``part``."""

    name: str
    part: str
    whole: str | None
    bound: int  # percent of whole, or a plain count where whole is None
    above: bool  # rejects above the bound, else below it

    def rejects(self, m: dict[str, np.ndarray]) -> np.ndarray:
        a, b = (m[self.part], self.bound) if self.whole is None else (100 * m[self.part], self.bound * m[self.whole])
        return a > b if self.above else a < b

    def needs(self) -> tuple[str, ...]:
        return (self.part,) if self.whole is None else (self.part, self.whole)

    def parts(self) -> set[str]:
        """The measures and shared parts that the rule pays for, unless another has."""
        return {p for k in self.needs() for p in (k, *SHARED.get(k, ()))}


BASE_RULES = (Rule("few_words", "n_words", None, 20, False), Rule("repeated_words", "n_repeat_words", "n_words", 30, True))
RULES = (
    *BASE_RULES,
    Rule("symbols", "n_symbols", "word_chars", 5, True),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", 50, True),
    Rule("short_words", "word_chars", "n_words", 300, False),
    Rule("long_words", "word_chars", "n_words", 1000, True),
    Rule("few_letter_words", "n_letter_words", "n_words", 80, False),
    Rule("stutter", "n_stutters", "n_words", 20, True),
)


def cascade(texts: Texts, rules: Sequence[Rule], required: Sequence[str] = ()) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """(kept, the required measures of all rows); other measures are taken of surviving rows alone."""
    whole = {k: MEASURES[k](texts) for k in required}
    alive = np.arange(texts.n)
    now, have = texts, dict(whole)
    for rule in rules:
        for k in rule.needs():
            if k not in have:
                have[k] = MEASURES[k](now)
        passed = ~rule.rejects(have)
        if passed.all():
            continue
        alive = alive[passed]
        have = {k: v[passed] for k, v in have.items()}
        if 2 * len(alive) < now.n or not len(alive):  # words are found anew, so only for far fewer rows
            now = now.take(np.flatnonzero(passed))
        else:
            now = _Masked(now, passed)
        if not len(alive):
            break
    kept = np.zeros(texts.n, dtype=bool)
    kept[alive] = True
    return kept, whole


class _Masked(Texts):
    """Some rows of texts whose word spans are known: measured there, then masked."""

    def __init__(self, base: Texts, mask: np.ndarray):
        if isinstance(base, _Masked):
            full = np.flatnonzero(base.mask)[mask]
            mask = np.zeros(len(base.mask), dtype=bool)
            mask[full] = True
            base = base.base
        size = np.diff(base.offsets)
        keep = np.repeat(mask, size)
        super().__init__(base.data[keep], np.concatenate([[0], np.cumsum(size[mask])]))
        self.base, self.mask = base, mask
        if base._words is not None:
            starts, lengths, rows, counts = base._words
            held = mask[rows]
            moved = np.cumsum(np.where(mask, 0, size))  # bytes dropped up to each row's end
            self._words = starts[held] - moved[rows[held]], lengths[held], (np.cumsum(mask) - 1)[rows[held]], counts[mask]
            if base._hashes is not None:
                self._hashes = base._hashes[held]


@dataclass
class Survey:
    """What a sample showed: the seconds a MB of each measure and shared part, and how many documents each set of rules rejects."""

    cost: dict[str, float] = field(default_factory=dict)
    rejected_by: Counter = field(default_factory=Counter)


def survey_rules(df: DataFrame, rules: Sequence[Rule] = RULES, *, id_col: str = "doc_id", text_col: str = "text", sample_docs: int = SAMPLE_DOCS) -> Survey:
    """The costs and rejections on the ``sample_docs`` documents whose ids hash lowest."""
    picked = [r[0] for r in df.select(id_col).where(F.col(id_col).isNotNull()).orderBy(F.xxhash64(id_col), id_col).limit(sample_docs).collect()]
    if not picked:
        return Survey()
    names = sorted({k for r in rules for k in r.needs()})

    def run(batch: pa.RecordBatch):
        data, offsets = bt.buffers(batch.column(0))
        spent, masks = Counter(), Counter()
        for a, b in bt.steps(offsets):
            t = Texts(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            values = {}
            for name, f in [("words", Texts.words), ("hashes", Texts.hashes), *((k, MEASURES[k]) for k in names)]:
                began = time.perf_counter()
                values[name] = f(t)
                spent[name] += time.perf_counter() - began
            masks.update(sum(r.rejects(values).astype(np.int64) << k for k, r in enumerate(rules)).tolist())
        mb = len(data) / 1e6
        yield pa.RecordBatch.from_pydict({"part": [*spent, *[None] * len(masks)], "rules": pa.array([*[None] * len(spent), *masks], pa.int64()), "seconds": pa.array([*spent.values(), *[None] * len(masks)], pa.float64()), "mb": pa.array([mb] * (len(spent) + len(masks)), pa.float64()), "n": pa.array([*[None] * len(spent), *masks.values()], pa.int64())})

    rows = df.where(F.col(id_col).isin(picked)).select(text_col).limit(2 * sample_docs).mapInArrow(per_batch(run), "part string, rules long, seconds double, mb double, n long")
    got = rows.groupBy("part", "rules").agg(F.sum("seconds").alias("seconds"), F.sum("mb").alias("mb"), F.sum("n").alias("n")).collect()  # at most a row for each document sampled
    cost = {r["part"]: r["seconds"] / max(r["mb"], 1e-6) for r in got if r["part"] is not None}
    return Survey(cost, Counter({r["rules"]: r["n"] for r in got if r["part"] is None}))


def order_rules(rules: Sequence[Rule], survey: Survey, paid: Sequence[str] = ()) -> list[Rule]:
    """Rules one by one: the most rejections of what is left, per cost beyond what is ``paid``; as given where nothing was measured."""
    paid = {p for k in paid for p in (k, *SHARED.get(k, ()))}
    out, left, alive = [], list(enumerate(rules)), survey.rejected_by

    def worth(item: tuple[int, Rule]) -> float:
        k, rule = item
        rejected = sum(n for mask, n in alive.items() if mask >> k & 1)
        return rejected / max(sum(survey.cost.get(p, 0.0) for p in rule.parts() - paid), 1e-9)

    while left:
        item = max(left, key=worth)  # the first of equals
        left.remove(item)
        out.append(item[1])
        paid |= item[1].parts()
        alive = {mask: n for mask, n in alive.items() if not mask >> item[0] & 1}
    return out


def quality_cascade(df: DataFrame, rules: Sequence[Rule] = RULES, *, id_col: str = "doc_id", text_col: str = "text", measures: Sequence[str] = (), sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """Per row: id, the ``measures`` asked for (of every row), kept."""
    small_batches(df.sparkSession)
    ordered = order_rules(rules, survey_rules(df, rules, id_col=id_col, text_col=text_col, sample_docs=sample_docs), measures)

    def run(batch: pa.RecordBatch):
        data, offsets = bt.buffers(batch.column(1))
        for a, b in bt.steps(offsets):
            kept, values = cascade(Texts(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]), ordered, measures)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *(pa.array(values[k].astype(np.int64)) for k in measures), pa.array(kept)], names=["id", *measures, "kept"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("id"), F.col(text_col)).mapInArrow(per_batch(run), ", ".join([f"id {kind}", *(f"{k} long" for k in measures), "kept boolean"])).withColumnRenamed("id", id_col)


def keep_documents(df: DataFrame, rules: Sequence[Rule] = RULES, *, id_col: str = "doc_id", text_col: str = "text", sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """The rows of ``df`` that no rule rejects, with all their columns."""
    small_batches(df.sparkSession)
    ordered = order_rules(rules, survey_rules(df, rules, id_col=id_col, text_col=text_col, sample_docs=sample_docs))
    where = df.columns.index(text_col)

    def run(batch: pa.RecordBatch):
        data, offsets = bt.buffers(batch.column(where))
        for a, b in bt.steps(offsets):
            kept, _ = cascade(Texts(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]), ordered)
            yield batch.slice(a, b - a).filter(pa.array(kept))

    return df.mapInArrow(per_batch(run), df.schema)
