"""Toxicity by weak supervision.

1. A bounded sample of labelled training rows is drawn: ``sample_toxic`` and
   ``sample_clean`` rows at most, those whose ids hash lowest, as long as the
   features of each side fit ``SAMPLE_BYTES`` (a text with more than a 64th of that
   is no sample; it is scored like any other).
2. Many voters judge each sampled text: words of a lexicon, words and word
   beginnings that are frequent in texts labelled toxic, patterns (shouting, masked
   words, runs of exclamation marks), and the absence of all of these.  A voter votes
   or abstains.  The sample is cut into ``FOLDS``: the voters of a fold are mined from
   the labels of the others, and no text is judged by its own label.
3. For each fold, a generative model of a hidden class and the votes is fitted by
   ``EM_ROUNDS`` rounds of EM.  The voters' rates among the other folds' labels start
   it; the fold's own labels are not seen.  Votes depend on the class and on one
   another along a tree: the spanning tree of the largest mutual information within the
   classes.  So a voter that only repeats its parent adds nothing.
4. A logistic regression on hashed words and word beginnings learns the posteriors.
   Its weights have a fixed size, and every document is scored with them.

Labels, language, source and ids are no inputs of a score.  Null and empty texts
get the score of a text without known words.  Without labelled rows the weights
are those of the lexicon.  Of rows that share an id, the one with the fewest
features is the sample, ties by their bytes.  Texts are scored row by row, so ties,
repeats and empty tables need no rule.  Other columns are passed on
(``drop_toxic``) or not read (``score_toxicity``).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidepool.llm import bytetext as bt
from tidepool.llm.tables import per_batch, small_batches, staged

SAMPLE_TOXIC, SAMPLE_CLEAN, SAMPLE_BYTES = 2000, 4000, 24 << 20
FEATURE_BITS, BEGINNINGS = 20, (4, 5, 6)
MINED, SELECTED, RIDGE, FOLDS, EM_ROUNDS = 192, 8192, 0.3, 5, 4

#: Insults and slurs of everyday use, as single words.
LEXICON = """
idiot idiots moron morons stupid dumb dumbass fool loser losers trash scum clown pathetic worthless disgusting
garbage vermin imbecile jerk bastard bitch whore slut asshole shit fuck fucking crap retard cunt dick prick
idioten dumm dummkopf arschloch scheisse hurensohn wichser abschaum trottel
imbécile connard salaud salope merde pute crétin abruti
idiota estúpido estúpida imbécil mierda puta cabrón pendejo basura
""".split()

_LETTER = np.zeros(256, dtype=bool)
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = _LETTER[0x80:] = True
_UPPER = np.zeros(256, dtype=bool)
_UPPER[0x41:0x5B] = True


def _letter_runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, lengths and rows of runs of letters (any byte beyond ASCII counts as one)."""
    plain = np.where(_LETTER[data], data, 0x20).astype(np.uint8)
    return bt.spans_of_words(plain, offsets)


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) of all words and their beginnings, with repeats."""
    low = bt.LOWER_ASCII[data]
    starts, lengths, rows = _letter_runs(low, offsets)
    h = [bt.span_hashes(low, starts, lengths)]
    r = [rows]
    for k in BEGINNINGS:
        longer = np.flatnonzero(lengths > k)
        h.append(bt.mix(bt.span_hashes(low, starts[longer], np.full(len(longer), k)) + np.uint64(k)))
        r.append(rows[longer])
    return np.concatenate(r), (np.concatenate(h) >> np.uint64(64 - FEATURE_BITS)).astype(np.int64)


def word_feature(word: str) -> int:
    """The feature of a whole word."""
    raw = np.frombuffer(word.encode(), dtype=np.uint8)
    return int(bt.span_hashes(raw, np.array([0]), np.array([len(raw)]))[0] >> np.uint64(64 - FEATURE_BITS))


def patterns(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows by three pattern voters: shouting, masked words, runs of exclamation marks."""
    n = len(offsets) - 1
    starts, lengths, rows = _letter_runs(data, offsets)
    upper = np.concatenate([[0], np.cumsum(_UPPER[data])])
    loud = (upper[starts + lengths] - upper[starts] == lengths) & (lengths > 2)
    words = np.maximum(np.bincount(rows, minlength=n), 1)
    out = np.zeros((n, 3), dtype=bool)
    out[:, 0] = np.bincount(rows[loud], minlength=n) * 4 > words
    for k, mark in ((1, 0x2A), (2, 0x21)):
        two = np.flatnonzero((data[:-1] == mark) & (data[1:] == mark)) if len(data) > 1 else np.zeros(0, np.int64)
        if k == 1 and len(two):  # letters on both sides of the stars
            two = two[(two > 0) & _LETTER[data[np.maximum(two - 1, 0)]]]
        hit = np.searchsorted(offsets, two, side="right") - 1
        out[:, k] = np.bincount(hit, minlength=n) > 0
    return out


@dataclass(frozen=True)
class Model:
    """Weights by feature, and the score's intercept."""

    weights: np.ndarray
    bias: float

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        n = len(offsets) - 1
        rows, at = features(data, offsets)
        held = np.flatnonzero(self.weights[at] != 0)
        one = np.unique((rows[held] << FEATURE_BITS) | at[held])  # each feature of a text counts once
        total = np.bincount(one >> FEATURE_BITS, weights=self.weights[one & ((1 << FEATURE_BITS) - 1)], minlength=n)
        return 1 / (1 + np.exp(-np.clip(total + self.bias, -30, 30)))


def label_model(votes: np.ndarray, prior: float, start: np.ndarray, rounds: int = 40) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Posteriors of the hidden class from binary votes (documents by voters), and what was fitted.

    EM from the posteriors ``start``.  Fitted are ``rate`` (class, voter): how often a
    voter votes; ``parent``: the voter that each depends on, itself at the root; and
    ``table`` (class, vote of the parent, voter): how often it votes then.
    """
    v = votes.astype(np.float32)
    post, parent = start.astype(np.float64), np.arange(v.shape[1])
    for step in range(rounds):
        weights = np.stack([1 - post, post])
        rate = np.stack([(w @ v + 0.5) / (w.sum() + 1) for w in weights])
        if step == 0 or (step >= 10 and step % 5 == 0):
            # at first the classes are too rough to tell weak dependence from the class itself; later it is to be worth its two parameters
            parent = _tree(v, weights, rate, 0.15 if step == 0 else np.log(len(v)) / len(v))
        above = v[:, parent]
        table = np.empty((2, 2, v.shape[1]))
        for y, w in enumerate(weights):
            for a, held in enumerate((1 - above, above)):
                # shrunk towards the rate without regard to the parent
                table[y, a] = ((w[:, None] * held * v).sum(axis=0) + 4 * rate[y]) / (w @ held + 4)
        root = parent == np.arange(len(parent))
        table[:, :, root] = rate[:, None, root]
        odds = np.full(len(v), np.log(prior / (1 - prior)))
        for a, held in enumerate((1 - above, above)):
            odds += (held * (v * np.log(table[1, a] / table[0, a]) + (1 - v) * np.log((1 - table[1, a]) / (1 - table[0, a])))).sum(axis=1)
        post = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
    return post, {"rate": rate, "parent": parent, "table": table}


def _tree(v: np.ndarray, weights: np.ndarray, rate: np.ndarray, least: float) -> np.ndarray:
    """Each voter's parent in the spanning tree of the largest mutual information within the classes (Chow and Liu, 1968), itself where that is below ``least``."""
    m = v.shape[1]
    shared = np.zeros((m, m))
    for y, w in enumerate(weights):
        n = w.sum() + 1
        both = (v.T @ (w[:, None].astype(np.float32) * v) + 0.25) / n
        p, q = rate[y][:, None], rate[y][None, :]
        for joint, apart in ((both, p * q), (p - both, p * (1 - q)), (q - both, (1 - p) * q), (1 - p - q + both, (1 - p) * (1 - q))):
            joint = np.maximum(joint, 1e-9)
            shared += w.sum() / len(v) * joint * np.log(joint / apart)
    shared[shared < least] = 0
    parent, inside = np.zeros(m, np.int64), np.zeros(m, dtype=bool)
    inside[0], best = True, shared[0].copy()
    for _ in range(m - 1):
        k = int(np.where(inside, -np.inf, best).argmax())
        inside[k] = True
        nearer = ~inside & (shared[k] > best)
        parent[nearer], best[nearer] = k, shared[k][nearer]
    return np.where(best > 0, parent, np.arange(m))


def posteriors(docs: list[np.ndarray], pattern: np.ndarray, label: np.ndarray) -> np.ndarray:
    """The chance that each sampled text is toxic, by the label model of its fold; its own label has no part in it."""
    size = 1 << FEATURE_BITS
    lexicon = np.array(sorted({word_feature(w) for w in LEXICON}))
    fold, post = np.arange(len(docs)) % FOLDS, np.zeros(len(docs))
    for f in range(FOLDS):
        mine, others = fold == f, fold != f
        apart, every = _apart(docs, label.astype(np.float64), others)
        mined = np.argsort(-np.where(every >= 5, apart, -np.inf), kind="stable")[:MINED]
        voters = np.unique(np.concatenate([lexicon, mined[apart[mined] > 4]]))
        votes = np.zeros((len(docs), len(voters)), dtype=bool)
        votes[_having(docs, voters, size)] = True
        votes = np.hstack([votes, pattern, ~votes.any(axis=1, keepdims=True)])
        toxic = others & (label == 1)
        prior = (toxic.sum() + 0.5) / (others.sum() + 1)
        rate = [(votes[m].sum(axis=0) + 0.5) / (m.sum() + 1) for m in (others & (label == 0), toxic)]
        v = votes[mine]
        odds = np.log(prior / (1 - prior)) + (v * np.log(rate[1] / rate[0]) + (1 - v) * np.log((1 - rate[1]) / (1 - rate[0]))).sum(axis=1)
        post[mine], _ = label_model(v, prior, 1 / (1 + np.exp(-np.clip(odds, -30, 30))), EM_ROUNDS)
    return post


def _parts(docs: list[np.ndarray], keep: np.ndarray | None = None):
    """(document, feature) of some documents at a time, so that no array holds them all."""
    chosen = np.arange(len(docs)) if keep is None else np.flatnonzero(keep)
    for k in range(0, len(chosen), 128):
        some = chosen[k : k + 128]
        yield np.repeat(some, [len(docs[i]) for i in some]), np.concatenate([docs[i] for i in some]).astype(np.int64)


def _apart(docs: list[np.ndarray], weight: np.ndarray, keep: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """How far a feature's rates in the two classes lie apart among some documents, in standard errors; and its count."""
    size = 1 << FEATURE_BITS
    one, every = np.zeros(size), np.zeros(size)
    for row, at in _parts(docs, keep):
        one += np.bincount(at, weights=weight[row], minlength=size)
        every += np.bincount(at, minlength=size)
    w = weight if keep is None else weight[keep]
    n1, n0 = max(w.sum(), 1), max((1 - w).sum(), 1)
    p = every / max(len(w), 1)
    return (one / n1 - (every - one) / n0) / np.sqrt(np.maximum(p * (1 - p), 1e-9) * (1 / n1 + 1 / n0)), every


def _having(docs: list[np.ndarray], chosen: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, place among the chosen) of the chosen features alone."""
    place = np.full(size, -1)
    place[chosen] = np.arange(len(chosen))
    held = [(row[place[at] >= 0], place[at[place[at] >= 0]]) for row, at in _parts(docs)]
    return np.concatenate([r for r, _ in held]), np.concatenate([c for _, c in held])


def fit(docs: list[np.ndarray], pattern: np.ndarray, label: np.ndarray, base_rate: float) -> Model:
    """A model from the distinct features, pattern votes and labels of sampled texts; base_rate: of toxic among all labelled."""
    size = 1 << FEATURE_BITS
    if len(docs) < 20 or label.min() == label.max():
        weights = np.zeros(size)
        weights[sorted({word_feature(w) for w in LEXICON})] = 3.0
        return Model(weights, -2.0)
    n1, n0 = int(label.sum()), int((1 - label).sum())
    post = posteriors(docs, pattern, label)

    # logistic regression on the posteriors, over the features that tell the classes apart
    apart, every = _apart(docs, post)
    apart = np.where(every >= 3, np.abs(apart), 0)
    chosen = np.argsort(-apart, kind="stable")[:SELECTED]
    chosen = chosen[apart[chosen] > 3.5]
    w, bias = _regress(*_having(docs, chosen, size), post, len(chosen))
    weights = np.zeros(size)
    weights[chosen] = w
    shift = np.log(base_rate / (1 - base_rate)) - np.log(n1 / n0)  # the sample has its own share of toxic rows
    return Model(np.where(np.abs(weights) < 1e-3, 0, weights), float(bias + shift))


def _regress(row: np.ndarray, at: np.ndarray, target: np.ndarray, size: int, steps: int = 12) -> tuple[np.ndarray, float]:
    """Ridge-penalised logistic regression on binary features: Newton steps by conjugate gradients, halved while they don't help."""
    n = len(target)
    ridge = np.append(np.full(size, RIDGE), 1e-3)
    apply = lambda v: np.bincount(row, weights=v[at], minlength=n) + v[-1]
    back = lambda r: np.append(np.bincount(at, weights=r[row], minlength=size), r.sum())
    loss = lambda w, o: np.logaddexp(0, o).sum() - target @ o + 0.5 * ridge @ w**2
    w = np.zeros(size + 1)
    odds = apply(w)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        curve = np.maximum(p * (1 - p), 1e-6)
        slope = back(p - target) + ridge * w
        diagonal = back(curve) + ridge
        x, r = np.zeros_like(w), -slope
        z = r / diagonal
        d, rz, first = z, r @ z, r @ z
        for _ in range(40):
            hd = back(curve * apply(d)) + ridge * d
            step = rz / (d @ hd)
            x, r = x + step * d, r - step * hd
            z = r / diagonal
            rz, old = r @ z, rz
            if rz < 1e-4 * first:
                break
            d = z + rz / old * d
        now, size_of = loss(w, odds), 1.0
        while size_of > 1e-3 and loss(w + size_of * x, apply(w + size_of * x)) > now:
            size_of /= 2
        w = w + size_of * x
        odds = apply(w)
        if now - loss(w, odds) < 1e-4 * abs(now):
            break
    return w[:-1], float(w[-1])


def held_out(id_col: str = "doc_id"):
    """Rows that nothing is learnt from: crc32 of the id as text is 0 modulo 5."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0


def sample_features(df: DataFrame, labels: DataFrame, *, id_col: str, text_col: str, label_col: str, sample_toxic: int, sample_clean: int, sample_bytes: int) -> tuple[DataFrame, dict[int, int]]:
    """The sample (id, y, bits, f), whose rows and bytes are bounded, and how many labelled rows there are of each label."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where(~held_out("id") & F.col("y").isin(0, 1))
    known = known.groupBy("id").agg(F.max("y").alias("y"))
    n = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    part = lambda y, k: known.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(k)
    sample = part(1, sample_toxic).union(part(0, sample_clean))
    texts = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(sample), "id")  # bounded by the two limits

    def run(batch: pa.RecordBatch):
        data, offsets = bt.buffers(batch.column(1))
        for a, b in bt.steps(offsets):
            part, off = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
            rows, at = features(part, off)
            one = np.unique((rows << FEATURE_BITS) | at)
            cut = np.searchsorted(one >> FEATURE_BITS, np.arange(b - a + 1))
            f = (one & ((1 << FEATURE_BITS) - 1)).astype("<u4")
            bits = patterns(part, off) @ np.array([1, 2, 4])
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a), pa.array(bits.astype(np.int32)), pa.array([f[cut[i] : cut[i + 1]].tobytes() for i in range(b - a)], pa.binary())], names=["id", "y", "bits", "f"])

    kind = df.schema[id_col].dataType.simpleString()
    found = texts.select("id", "text", "y").mapInArrow(per_batch(run), f"id {kind}, y int, bits int, f binary").where(F.length("f") <= sample_bytes // 64)
    found = found.groupBy("id", "y").agg(F.min(F.struct(F.length("f").alias("n"), "f", "bits")).alias("one")).select("id", "y", "one.*")
    found = staged(found, "features")
    # each side's rows by the hash of their ids, until the bytes are filled; a side has no more rows than its limit
    filled = Window.partitionBy("y").orderBy(F.xxhash64("id"), "id")
    chosen = found.select("id", "y", F.sum("n").over(filled).alias("filled")).where(F.col("filled") <= sample_bytes).select("id")
    return found.join(chosen, "id").select("id", "y", "bits", "f"), n


def train(df: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_toxic: int = SAMPLE_TOXIC, sample_clean: int = SAMPLE_CLEAN, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """Fit on labelled rows that are not held out: at most ``sample_toxic`` and ``sample_clean`` of them, with ``sample_bytes`` of features each."""
    small_batches(df.sparkSession)
    sample, n = sample_features(df, labels, id_col=id_col, text_col=text_col, label_col=label_col, sample_toxic=sample_toxic, sample_clean=sample_clean, sample_bytes=sample_bytes)
    got = sorted(sample.collect(), key=lambda r: str(r["id"]))
    docs = [np.frombuffer(r["f"], dtype="<i4") for r in got]
    bits = np.array([r["bits"] for r in got], dtype=np.int64)
    label = np.array([r["y"] for r in got], dtype=np.int64)
    rate = n.get(1, 0) / max(sum(n.values()), 1)
    return fit(docs, (bits[:, None] >> np.arange(3) & 1).astype(bool), label, min(max(rate, 1e-3), 1 - 1e-3))


def score_toxicity(df: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, score (0 to 1)."""
    small_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)  # 8 MB, whatever the corpus

    def run(batch: pa.RecordBatch):
        data, offsets = bt.buffers(batch.column(1))
        for a, b in bt.steps(offsets):
            s = shared.value.scores(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(s)], names=["id", "score"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("id"), F.col(text_col)).mapInArrow(per_batch(run), f"id {kind}, score double").withColumnRenamed("id", id_col)


def drop_toxic(df: DataFrame, model: Model, *, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of ``df`` that score below the threshold, with all their columns."""
    small_batches(df.sparkSession)
    shared, where = df.sparkSession.sparkContext.broadcast(model), df.columns.index(text_col)

    def run(batch: pa.RecordBatch):
        data, offsets = bt.buffers(batch.column(where))
        for a, b in bt.steps(offsets):
            s = shared.value.scores(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            yield batch.slice(a, b - a).filter(pa.array(s < threshold))

    return df.mapInArrow(per_batch(run), df.schema)
