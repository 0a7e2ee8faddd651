"""Nearest neighbours, toxicity, chat formatting, n-best segmentation, the pipeline."""

import itertools
import math
import random
import time
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidepool.llm import ann, chat
from tidepool.llm import bytetext as bt
from tidepool.llm.ann import Shard, nearest
from tidepool.llm.nbest import BYTE_SCORE, UNIT, Table, decode_pieces, encode_nbest, lattice, table
from tidepool.llm.queries import raw_transcripts
from tidepool.llm.toxicity import drop_toxic, features, held_out, label_model, posteriors, sample_features, score_toxicity, train
from tidepool.llm.vector_graph import Graph

# -- nearest neighbours ---------------------------------------------------------------


def brute(ids, v, queries, k):
    n = v / np.linalg.norm(v, axis=1)[:, None]
    out = {}
    for q in queries:
        s = n @ n[list(ids).index(q)]
        out[q] = [i for _, i in sorted((-round(x, 12), i) for x, i in zip(s, ids) if i != q)][:k]
    return out


def test_recall_of_a_shard():
    rng = np.random.default_rng(1)
    v = rng.standard_normal((1200, 32))
    ids = np.arange(1200)
    got = Shard(ids, v).query(ids[:100], v[:100], 5, 64).to_pandas()
    want = brute(ids, v, range(100), 5)
    assert sum(len(set(g["id"]) & set(want[q])) for q, g in got.groupby("query_id")) / 500 >= 0.9


def test_recall_over_several_shards(spark, monkeypatch):
    monkeypatch.setattr(ann, "SHARD", (256, 512))
    rng = np.random.default_rng(8)
    centres = rng.standard_normal((40, 24))
    v = centres[rng.integers(0, 40, 3000)] + 0.4 * rng.standard_normal((3000, 24))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>").repartition(4)
    got = nearest(df, df.where("vec_id % 50 = 0"), 5).toPandas()
    want = brute(np.arange(3000), v, range(0, 3000, 50), 5)
    assert (got.groupby("query_id").size() == 5).all() and got["query_id"].nunique() == 60
    assert sum(len(set(g["vec_id"]) & set(want[q])) for q, g in got.groupby("query_id")) / 300 >= 0.9
    unit = v / np.linalg.norm(v, axis=1)[:, None]
    assert np.allclose(got["score"], (unit[got["query_id"]] * unit[got["vec_id"]]).sum(axis=1))


def test_rows_that_share_an_id_are_one_item(spark):
    one, two, far = [1.0, 0.0, 0.1], [0.9, 0.1, 0.0], [-1.0, 0.2, 0.0]
    rows = [(50, one)] * 8 + [(60, one), (7, two), (7, far), (7, two), (8, far), (9, [0.5, 0.5, 0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = nearest(df, df.where("vec_id IN (50, 7)"), 5).orderBy("query_id", "rank").toPandas()
    assert got[got["query_id"] == 50]["vec_id"].tolist() == [60, 7, 9, 8] and abs(got[got["query_id"] == 50]["score"].iloc[0] - 1) < 1e-12
    assert got[got["query_id"] == 7]["vec_id"].tolist() == [8, 50, 60, 9]  # 8 equals one of the vectors of 7
    many = spark.createDataFrame([(1, [1.0, 0.001 * i]) for i in range(200)] + [(i, [1.0, 0.1 * i]) for i in range(2, 9)], "vec_id long, embedding array<double>")
    assert nearest(many, many.where("vec_id = 2"), 5).orderBy("rank").toPandas()["vec_id"].tolist() == [1, 3, 4, 5, 6]


def test_graph_degrees_and_pruning():
    rng = np.random.default_rng(2)
    x = rng.standard_normal((300, 8))
    g = Graph(x / np.linalg.norm(x, axis=1)[:, None], degree=8)
    assert ((g.edges >= 0).sum(axis=1) <= 8).all() and (g.edges != np.arange(300)[:, None]).all()
    for row in g.edges:
        held = row[row >= 0]
        assert len(set(held)) == len(held)


def test_nearest_rows(spark):
    rng = np.random.default_rng(3)
    v = rng.standard_normal((400, 16)).astype(np.float32)
    v[100:180] = v[7]  # copies: ties go to the smaller id
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    odd = [(1000, None), (1050, [0.0] * 16), (1100, [float("nan")] + [1.0] * 15), (1150, [None] + [1.0] * 15), (1200, [float("inf")] * 16), (1250, []), (1300, [1.0, 2.0])]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>").withColumn("rank", F.lit("x")).repartition(3)
    got = nearest(df, df.where("vec_id % 50 = 0"), 5).toPandas()
    want = brute(np.arange(400), v.astype(float), range(0, 400, 50), 5)
    assert set(got["query_id"]) == set(want)
    hits = 0
    for q, g in got.groupby("query_id"):
        g = g.sort_values("rank")
        assert g["rank"].tolist() == [1, 2, 3, 4, 5] and (np.diff(g["score"]) <= 0).all() and q not in set(g["vec_id"])
        hits += len(set(g["vec_id"]) & set(want[q]))
    assert hits / 40 >= 0.9
    assert got[got["query_id"] == 100].sort_values("rank")["vec_id"].tolist() == [7, 101, 102, 103, 104]
    assert nearest(df.limit(0), df.limit(0), 5).count() == 0
    few = df.where("vec_id IN (0, 1, 2)")
    assert nearest(few, few.where("vec_id = 0"), 5).count() == 2


# -- toxicity -----------------------------------------------------------------------------


def toxic_corpus(n, seed):
    rnd = random.Random(seed)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)]
    docs, labels = [], []
    for i in range(n):
        text = [rnd.choice(words) for _ in range(rnd.randint(20, 80))]
        y = int(rnd.random() < 0.2)
        for _ in range(3 * y):  # insults with an ending that may be new
            text.insert(rnd.randrange(len(text)), rnd.choice(["zorba", "quilt", "idiot"]) + rnd.choice(["", "en", "isch", "xo", "ta"]))
        docs.append((i, " ".join(text)))
        labels.append((i, y if rnd.random() > 0.03 else 1 - y, 0))
    return docs, labels


def test_held_out_accuracy(spark):
    docs, labels = toxic_corpus(1500, 1)
    df = spark.createDataFrame([*docs, (9000, None), (9001, "")], "doc_id long, text string").withColumn("score", F.lit("x"))
    lab = spark.createDataFrame(labels, "doc_id long, toxic int, quality int")
    model = train(df, lab)
    got = score_toxicity(df, model).withColumn("h", held_out()).join(lab, "doc_id", "left").toPandas()
    test = got[got["h"] & got["toxic"].notna()]
    assert len(test) > 200 and ((test["score"] >= 0.5) == (test["toxic"] == 1)).mean() > 0.93
    assert got["score"].between(0, 1).all() and len(got) == 1502
    kept = drop_toxic(df, model)
    assert kept.columns == df.columns and kept.count() == (got["score"] < 0.5).sum()


def test_without_labels_the_lexicon_decides(spark):
    df = spark.createDataFrame([(1, "you idiot"), (2, "good day"), (2, "good day"), (3, None)], "doc_id long, text string")
    empty = spark.createDataFrame([], "doc_id long, toxic int")
    got = {r["doc_id"]: r["score"] for r in score_toxicity(df, train(df, empty)).collect()}
    assert got[1] > 0.5 > got[2] and got[3] == got[2]
    assert score_toxicity(df.limit(0), train(df.limit(0), empty)).count() == 0


def test_labels_reach_the_classifier_through_the_voters_only():
    """Right labels give posteriors that follow them; shuffled ones choose no voters and do not pass through."""
    rnd = np.random.default_rng(7)
    toxic = rnd.random(600) < 0.3
    docs = []
    for t in toxic:
        words = list(rnd.integers(1000, 9000, 40)) + (list(rnd.choice(20, 4, replace=False)) if t else [])
        docs.append(np.unique(np.array(words, dtype="<i4")))
    none = np.zeros((600, 3), bool)
    post = posteriors(docs, none, toxic.astype(np.int64))
    assert ((post > 0.5) == toxic).mean() > 0.97
    shuffled = rnd.permutation(toxic)
    wrong = posteriors(docs, none, shuffled.astype(np.int64))
    assert ((wrong > 0.5) & shuffled).sum() < 0.2 * shuffled.sum()
    # a wrong label of one text does not move its own posterior across
    flipped = toxic.astype(np.int64).copy()
    flipped[:20] = 1 - flipped[:20]
    again = posteriors(docs, none, flipped)
    assert ((again[:20] > 0.5) == toxic[:20]).sum() >= 18


def test_label_model_learns_who_is_right():
    rng = np.random.default_rng(5)
    y = rng.random(4000) < 0.3
    votes = np.stack([y ^ (rng.random(4000) < p) for p in (0.05, 0.1, 0.2, 0.4)] + [rng.random(4000) < 0.5], axis=1)
    label = y ^ (rng.random(4000) < 0.1)
    post, fitted = label_model(votes, 0.3, np.where(label, 0.95, 0.05))
    assert ((post > 0.5) == y).mean() > 0.95 > (label == y).mean()
    assert abs(fitted["rate"][1][0] - 0.95) < 0.03 and abs(fitted["rate"][1][4] - fitted["rate"][0][4]) < 0.05


def test_a_voter_that_repeats_another_adds_nothing():
    rng = np.random.default_rng(6)
    y = rng.random(3000) < 0.4
    one, other, third = (y ^ (rng.random(3000) < 0.25) for _ in range(3))
    votes = np.stack([one] * 5 + [other, third], axis=1)
    post, fitted = label_model(votes, 0.4, np.where(y, 0.95, 0.05))
    copies = [k for k in range(1, 5) if fitted["parent"][k] < 5]
    assert len(copies) == 4 and (np.abs(np.log(fitted["table"][1, 1, copies] / fitted["table"][0, 1, copies])) < 0.02).all()
    alone, _ = label_model(votes[:, 4:], 0.4, np.where(y, 0.95, 0.05))
    assert np.abs(post - alone).max() < 0.1


def test_the_sample_is_bounded_in_bytes(spark):
    docs, labels = toxic_corpus(300, 2)
    docs += [(5000, " ".join("".join(p) for p in itertools.product("abcdefgh", repeat=5))), (docs[0][0], "another text of the same id")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    lab = spark.createDataFrame([*labels, (5000, 1, 0)], "doc_id long, toxic int, quality int")
    held = {}
    for most in (20_000, 1 << 24):
        rows = sample_features(df, lab, id_col="doc_id", text_col="text", label_col="toxic", sample_toxic=100, sample_clean=100, sample_bytes=most)[0].collect()
        for y in (0, 1):
            assert 0 < sum(len(r["f"]) for r in rows if r["y"] == y) <= most
        held[most] = {r["id"] for r in rows}
        assert len(held[most]) == len(rows) <= 200
    assert not held[20_000] - held[1 << 24] and held[1 << 24] - held[20_000]
    assert 5000 not in held[20_000]


def test_features_count_words_and_beginnings():
    data, offsets = bt.buffers(pa.array(["Idiot, IDIOTEN!", ""]))
    rows, at = features(data, offsets)
    assert (rows == 0).all() and len(rows) == 6 and len(set(at.tolist())) == 5  # two words; idio twice, idiot and idiote once


# -- chat -----------------------------------------------------------------------------------


def exhaustive(em):
    best = None
    for path in itertools.product(range(6), repeat=len(em)):
        s = chat._START[path[0]] + em[0][path[0]] + sum(chat._STEP[a, b] + em[t + 1][b] for t, (a, b) in enumerate(zip(path, path[1:])))
        if best is None or s > best[0] + 1e-12:
            best = (s, list(path))
    return best


@pytest.mark.parametrize("seed", range(4))
def test_viterbi_finds_the_best_path(seed):
    em = np.random.default_rng(seed).standard_normal((5, 6)) * 3
    path = chat.viterbi(em)
    score = chat._START[path[0]] + em[0][path[0]] + sum(chat._STEP[a, b] + em[t + 1][b] for t, (a, b) in enumerate(zip(path, path[1:])))
    assert math.isclose(score, exhaustive(em)[0])


def test_chunks_decode_as_the_whole(spark, monkeypatch):
    rnd = random.Random(2)
    rows = []
    for conv in range(3):
        for turn in range(40):
            who = ["User: ", "Assistant: ", "", "### System:\n"][rnd.randrange(4)]
            rows.append((conv, turn, who + rnd.choice(["How are you?", "fine\nthanks " * 9, "You are a bot.", "- item\n- item"]), "x"))
    rows += [(None, 0, None, "x"), (7, 0, "", "x"), (7, 0, "", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, text string, role string")
    whole = chat.format_transcripts(df).toPandas().sort_values(["conv", "turn"]).reset_index(drop=True)
    monkeypatch.setattr(chat, "CHUNK_BYTES", 200)
    by_bytes = chat.format_transcripts(df.repartition(6)).toPandas().sort_values(["conv", "turn"]).reset_index(drop=True)
    pd.testing.assert_frame_equal(whole, by_bytes)
    monkeypatch.setattr(chat, "CHUNK", 4)
    cut = chat.format_transcripts(df.repartition(6)).toPandas().sort_values(["conv", "turn"]).reset_index(drop=True)
    pd.testing.assert_frame_equal(whole, cut)
    assert len(whole) == len(rows) and chat.format_transcripts(df.limit(0)).count() == 0
    text = "".join(whole[whole["conv"] == 1]["rendered"])
    assert text.count("<|im_start|>") == text.count("<|im_end|>") == whole[whole["conv"] == 1]["n_begun"].sum()


def test_a_very_long_text(spark):
    long = "User: " + "What is this?\nI wonder.\n" * 40_000
    rows = [(1, 0, "System: You are a bot."), (1, 1, long), (1, 2, "Assistant: x" + "y" * 1_000_000), (None, 0, "User: a"), (None, 1, "b")]
    got = chat.format_transcripts(spark.createDataFrame(rows, "conv_id long, turn long, text string")).orderBy("conv", "turn").collect()
    assert [(r["conv"], r["role"], r["n_lines"]) for r in got] == [(None, "user", 1), (None, "user", 1), (1, "system", 1), (1, "user", 80_001), (1, "assistant", 1)]
    assert len(got[4]["rendered"]) > 1_000_000 and got[1]["n_begun"] <= 1


def test_roles_are_recovered(spark):
    rnd = random.Random(3)
    rows = [(c, t, ["user", "assistant"][t % 2], " ".join(rnd.choice(["alpha", "beta", "gamma"]) for _ in range(rnd.randint(3, 30 + 60 * (t % 2))))) for c in range(60) for t in range(rnd.randint(1, 8))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = chat.format_transcripts(raw_transcripts(df)).withColumnRenamed("role", "found").join(df.withColumnRenamed("conv_id", "conv"), ["conv", "turn"])
    assert got.where("found = role").count() / got.count() > 0.9


# -- n-best ---------------------------------------------------------------------------------


def all_paths(lat, text):
    """All segmentations into pieces, and bytes for characters that are none."""
    paths = [[(0, ())]] + [[] for _ in text]
    for b in range(1, len(text) + 1):
        for a in range(b):
            if hit := lat.arcs.get(text[a:b]):
                paths[b] += [(t + hit[0], (*p, hit[1])) for t, p in paths[a]]
            elif b == a + 1:
                raw = text[a].encode()
                paths[b] += [(t + round(BYTE_SCORE / UNIT) * len(raw), (*p, *(lat.bytes[x] for x in raw))) for t, p in paths[a]]
    return sorted(paths[-1], reverse=True)


WORDS = ["▁hello", "▁▁▁straße", "▁日本x", "ab", "▁the▁cat▁sat", "aé▁▁b", "▁a▁b▁c▁d", "", "aaaaaaa", "..,,..", "▁12.5▁🙂"]


@pytest.mark.parametrize("n", [1, 2, 4, 6])
def test_nbest_against_all_segmentations(n):
    lat = lattice("piece_bpe_32k.model")
    row, rank, score, ends, ids = Table(lat, n).encode(WORDS)
    for k, text in enumerate(WORDS):
        mine = np.flatnonzero(row == k)
        want = all_paths(lat, text)[:n]
        assert rank[mine].tolist() == list(range(1, len(want) + 1))
        assert [round(x / UNIT) for x in score[mine]] == [s for s, _ in want]
        every = dict((i, s) for s, i in all_paths(lat, text))
        found = [tuple(ids[ends[m] : ends[m + 1]].tolist()) for m in mine]
        assert len(set(found)) == len(found) and [every[i] for i in found] == [s for s, _ in want]


@given(texts=st.lists(st.text(st.sampled_from("ab th.e▁1é日\x00"), max_size=9), max_size=5))
@settings(max_examples=100, deadline=None)
def test_nbest_of_random_texts(texts):
    lat = lattice("piece_bpe_32k.model")
    row, _, score, ends, ids = table("piece_bpe_32k.model", 3).encode(texts)
    for k, text in enumerate(texts):
        want = all_paths(lat, text)
        every = dict((i, s) for s, i in want)
        mine = np.flatnonzero(row == k)
        assert [every[tuple(ids[ends[m] : ends[m + 1]].tolist())] for m in mine] == [s for s, _ in want[:3]] == [round(x / UNIT) for x in score[mine]]


def test_very_long_words_take_time_in_proportion():
    known = table("piece_bpe_32k.model", 4)
    began = time.perf_counter()
    for word in ("a" * 100_000, "the" * 33_000, "日" * 30_000, "▁" * 100_000):
        row, _, _, ends, _ = known.encode([word])
        assert len(row) == (1 if word[0] == "日" else 4) and (np.diff(ends) > 0).all()  # no piece holds that character twice
    assert time.perf_counter() - began < 10


def test_equal_hashes_of_different_parts_do_no_harm(monkeypatch):
    want = Table(lattice("piece_bpe_32k.model"), 3).encode(WORDS)
    monkeypatch.setattr(bt, "span_hashes", lambda data, starts, lengths: np.zeros(len(starts), np.uint64))
    got = Table(lattice("piece_bpe_32k.model"), 3).encode(WORDS)
    assert all((a == b).all() for a, b in zip(got, want))


def test_nbest_rows_decode(spark):
    rows = [(1, "Hello  world\n ﬁ"), (2, None), (3, ""), (1, "Hello  world\n ﬁ"), (4, "日本語 🙂 hello " * 300), (5, " two\tspaces  ")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("x")).withColumn("ids", F.lit(1))
    got = decode_pieces(encode_nbest(df, n=3)).toPandas()
    text = {i: t or "" for i, t in rows}
    assert (got["decoded"] == got["doc_id"].map(text)).all() and (got["text_crc32"] == [zlib.crc32(t.encode()) for t in got["decoded"]]).all()
    assert got.groupby("doc_id").size().to_dict() == {1: 6, 2: 1, 3: 1, 4: 3, 5: 3}
    assert all((np.diff(g.sort_values("rank")["score"]) <= 0).all() for _, g in got[got["doc_id"] == 4].groupby("doc_id"))
    assert decode_pieces(encode_nbest(df.limit(0), n=3)).count() == 0


def test_decoding_is_that_of_the_library(spark):
    model = lattice("piece_bpe_32k.model").model
    ids = [model.encode(t) for t in ("Hello  world", " x", "🙂é\n", "")] + [[1, 15043, 2], [0, 15043, 0], [259, 15043], [35, 15043], [1, 259, 2, 259], [], [1, 2]]
    df = spark.createDataFrame([(k, x) for k, x in enumerate(ids)], "k int, ids array<int>")
    got = [r["decoded"] for r in decode_pieces(df).orderBy("k").collect()]
    assert got == [model.decode(x) for x in ids]
    odd = spark.createDataFrame([(None, "p"), ([None, 99999, -5], "p")], "ids array<int>, decoded string")
    assert [r["decoded"] for r in decode_pieces(odd).collect()] == [None, " ⁇  ⁇  ⁇ "]


def test_op5_covers_documents_and_turns(spark, tmp_path):
    from tidepool.llm.queries import QUERIES

    docs = [(1, "Hello  world ﬁ"), (2, "日本語 🙂 hello " * 3000), (3, None), (4, "")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(7, 0, "Hello  world")], "conv_id long, turn int, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = QUERIES["op5_nbest"](spark, str(tmp_path)).toPandas()
    assert got.groupby("doc_id").size().to_dict() == {1: 4, 2: 4, 3: 1, 4: 1} and got["decodes"].all()
    assert (got[got["doc_id"] == 2]["n_pieces"] > 9000).all()
    turns = QUERIES["op5_nbest_turns"](spark, str(tmp_path)).toPandas()
    assert turns[["conv_id", "turn"]].drop_duplicates().to_numpy().tolist() == [[7, 0]] and len(turns) == 4


# -- pipeline ---------------------------------------------------------------------------------


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as P

    docs, labels = toxic_corpus(400, 4)
    rows = [(i, t, "en", "s", len(t)) for i, t in docs]
    rows += [(1000, docs[0][1] + " mail a@b.cd", "en", "s", 0), (1001, "short", "en", "s", 5), (1002, docs[1][1], "en", "s", 0), (1003, None, "en", "s", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    now, columns, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), None, {}
    columns = now.columns
    for name, stage in P.STAGES:
        now = stage(spark, now, str(tmp_path))
        now.write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = {r["doc_id"] for r in now.collect()}
        if name != "packing":
            assert now.columns == columns
    assert {1001, 1003} <= {r[0] for r in rows} - seen["quality"] and seen["quality"] >= {i for i, t in docs if len(t.split()) >= 20}
    toxic = {i for (i, t), (_, y, _) in zip(docs, labels) if "zorba" in t or "quilt" in t or "idiot" in t}
    assert len(seen["toxicity"] & toxic) < 0.2 * len(toxic) and len(seen["quality"] - toxic - seen["toxicity"]) < 10
    assert 1002 not in seen["near_duplicates"] and seen["personal_data"] == seen["near_duplicates"] == seen["packing"]
    masked = [r["text"] for r in spark.read.parquet(f"{tmp_path}/personal_data").where("text LIKE '%<EMAIL>%'").collect()]
    assert all("a@b.cd" not in t for t in masked)
    assert P.run(spark, str(tmp_path)).agg(F.sum("length")).first()[0] == now.agg(F.sum("length")).first()[0]
