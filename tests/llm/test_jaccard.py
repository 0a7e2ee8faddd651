"""The similarity join against all pairs of small corpora."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidepool.llm import bytetext as bt
from tidepool.llm import jaccard as J
from tidepool.llm.components import components


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def groups(docs):
    """(n_shingles, component) of each row, by links of all pairs of rows; rows of one id are one node."""
    sets = [(i, shingles(t)) for i, t in docs]
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in sets:
        for j, b in sets:
            if i < j and a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return sorted((i, len(a), find(i)) for i, a in sets)


def found(df):
    return sorted(tuple(r) for r in J.similar_groups(df).select("doc_id", "n_shingles", "component_id").collect())


def corpus(seed):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    common = " ".join(rnd.choice(words) for _ in range(60))
    docs = ["", None, "One two", "one TWO", "a a a a a a a a", "b b b b b b b b", "é É five six seven", "w " * 3000]
    base = [rnd.choice(words) for _ in range(120)]
    for _ in range(60):  # near copies of one text, each with a few changes: many pairs lie near the threshold
        t = list(base)
        for _ in range(rnd.randint(0, 5)):
            t[rnd.randrange(len(t))] = rnd.choice(words)
        docs.append(" ".join(t))
    docs += [" ".join(base)] * 10
    for _ in range(60):
        own = " ".join(rnd.choice(words) for _ in range(rnd.randint(1, 80)))
        docs.append(own + (" " + common if rnd.random() < 0.5 else ""))
    docs += [d for d in docs[-8:]]
    # words that differ in a control character alone, at the lengths where a block of eight bytes ends
    docs += ["one two three four abcdef six seven", "one two three four abcdef\x01 six seven", "abcdefg h i j k", "abcdefg\x00 h i j k", "abcdefgh b c d e f", "abcdefgh\x00 b c d e f"]
    rnd.shuffle(docs)
    return list(enumerate(docs))


def test_components_of_all_links(spark, monkeypatch):
    docs = corpus(7)
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("n", F.lit(0)).repartition(5)
    for leaders in (1, 32):  # with one leader, much is left for the second pass
        monkeypatch.setattr(J, "LEADERS", leaders)
        assert found(df) == groups(docs)


def test_hot_shingles_are_dealt_out(spark, monkeypatch):
    docs = corpus(11)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    monkeypatch.setattr(J, "HOT", 8)
    assert found(df) == groups(docs)


def test_rows_of_one_id_are_one_node(spark):
    a, b, c = ("a b c d e f g h i j", "k l m n o p q r s t", "u v w x y z 1 2 3 4")
    docs = [(1, a), (5, a), (5, b), (2, b), (5, b), (5, None), (9, c), (8, c), (8, "a lone text of its own here"), (8, ""), (7, None), (7, ""), (3, "x y"), (3, "y z"), (4, "y z")]
    docs += [(20, f"{a} {i}") for i in range(30)] + [(21, f"{b} {c}")] * 40  # an id with many texts, and one with many equal rows
    got = found(spark.createDataFrame(docs, "doc_id long, text string").repartition(3))
    assert got == groups(docs) and (2, 6, 1) in got and (5, 0, 1) in got and (8, 0, 8) in got


def test_very_long_texts(spark):
    rnd = random.Random(5)
    base = [f"w{rnd.randrange(50_000)}" for _ in range(200_000)]
    near = list(base)
    near[1000:2000] = ["x"] * 1000
    docs = [(1, " ".join(base)), (2, " ".join(near)), (3, "y" * 1_000_000), (4, "y" * 1_000_001)]
    assert [(i, c) for i, _, c in found(spark.createDataFrame(docs, "doc_id long, text string"))] == [(1, 1), (2, 1), (3, 3), (4, 4)]


def test_tables_go_when_nothing_reads_them(spark, tmp_path, monkeypatch):
    from tidepool.llm import tables

    monkeypatch.setattr(tables, "shared_folder", lambda _: f"file://{tmp_path}")
    df = spark.createDataFrame(corpus(7), "doc_id long, text string")
    assert J.similar_groups(df).count() == df.count()
    assert [p.name.split("-")[0] for p in tmp_path.iterdir()] == ["groups"]


def test_a_shared_folder_is_needed_on_a_cluster():
    from types import SimpleNamespace

    from tidepool.llm.tables import shared_folder

    conf = SimpleNamespace(get=lambda *a: None)
    session = SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="spark://host:7077", getConf=lambda: conf))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(session)


def test_rows_without_words_and_empty_tables(spark):
    df = spark.createDataFrame([(3, None), (4, ""), (5, "  "), (None, "x y"), (6, "x y"), (6, "x y")], "doc_id long, text string")
    got = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["n_shingles"], r["component_id"]) for r in J.similar_groups(df).collect())
    assert got == [(-1, 1, None), (3, 0, 3), (4, 0, 4), (5, 0, 5), (6, 1, 6), (6, 1, 6)]
    assert J.similar_groups(df.limit(0)).count() == 0


def test_one_of_each_takes_one_row_of_an_id(spark):
    text = "a b c d e f g h"
    df = spark.createDataFrame([(1, text, 1), (1, text, 1), (1, text + " i", 2), (2, text, 3), (None, text, 4), (None, text, 4)], "doc_id long, text string, place_ int")
    got = J.one_of_each(df)
    assert got.columns == df.columns and sorted((r["doc_id"] or 0) for r in got.collect()) == [0, 0, 1]


def test_one_of_each_keeps_columns(spark):
    text = "a b c d e f g h"
    df = spark.createDataFrame([(2, text, "p"), (1, text, "q"), (3, "other words here to read", "r"), (None, text, "s")], "doc_id long, text string, component_id string")
    got = J.one_of_each(df)
    assert got.columns == df.columns and sorted(r["component_id"] for r in got.collect()) == ["q", "r", "s"]


def test_sets_match_plain_python():
    texts = [t for _, t in corpus(3)]
    data, offsets = bt.buffers(pa.array(texts, pa.string()))
    _, bounds = J.shingle_sets(data, offsets)
    assert np.diff(bounds).tolist() == [len(shingles(t)) for t in texts]
    assert len({tuple(s) for s in zip(*J.signatures(*J.shingle_sets(data, offsets)))}) == len({shingles(t) for t in texts})


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, x) for x in range(101, 130)] + [(7, 7), (205, 200), (205, 203)]
    df = spark.createDataFrame(edges, "u long, v long").repartition(6)
    got = {r["node"]: r["component"] for r in components(df).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, **{x: 100 for x in range(100, 130)}, 200: 200, 203: 200, 205: 200}


def test_parity_maps_differ_in_no_more_bits_than_sets():
    rnd = np.random.default_rng(5)
    h = np.sort(rnd.integers(0, 1 << 63, 600, dtype=np.uint64))
    for common in (0, 150, 290, 300):
        sets = np.concatenate([h[:300], h[300 - common : 600 - common]])
        maps = np.array(J.parities(sets, np.array([0, 300, 600])))
        bits = sum(bin((int(a) ^ int(b)) & (2**64 - 1)).count("1") for a, b in maps)
        assert bits <= 2 * (300 - common)


def test_pairs_of_a_form_stay_few(spark, monkeypatch):
    """Texts of eight fields with four fixed phrases each, as many as there are mixtures, no two linked: few pairs are looked at."""
    rnd = random.Random(3)
    phrases = [[" ".join(f"p{f}{v}{i}" for i in range(12)) for v in range(4)] for f in range(8)]
    docs = sorted({tuple(rnd.randrange(4) for _ in range(8)) for _ in range(3000)})
    docs = [(k, " ".join(phrases[f][v] for f, v in enumerate(d))) for k, d in enumerate(docs)]
    sizes = []
    linked = J._linked
    monkeypatch.setattr(J, "_linked", lambda pairs, *a: (sizes.append(pairs.count()), linked(pairs, *a))[1])
    got = found(spark.createDataFrame(docs, "doc_id long, text string"))
    assert all(r[2] == r[0] for r in got)
    assert sizes[1] < 10 * len(docs)  # all pairs: 1,500 a document


def test_one_of_each_with_clashing_columns(spark):
    rows = [(1, "a b c d e f", 7), (1, "other words are here now", 8), (2, "a b c d e f", 9)]
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "doc_id long, text string, place_ int, place__ int, place___ int, __place int")
    assert [r["doc_id"] for r in J.one_of_each(df).collect()] == [1]


def test_joins_of_large_tables_are_shuffled_at_every_size(spark, monkeypatch):
    from tidepool.llm import jaccard

    plans, real = {}, jaccard.staged

    def spy(df, name, *more):
        plans.setdefault(name, []).append(df._jdf.queryExecution().executedPlan().toString())
        return real(df, name, *more)

    monkeypatch.setattr(jaccard, "staged", spy)
    texts = [" ".join(f"w{(i // 3) * 50 + j}" for j in range(40 + i % 3)) for i in range(12)]
    jaccard.similar_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert not any("Broadcast" in p for p in (plans["met"][0], plans["known"][0], plans["pairs"][0]))
