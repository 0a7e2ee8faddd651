"""Token counts, token files, packing: against the library itself, and exact round trips."""

import hashlib
import itertools
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidepool.llm import bytetext as bt
from tidepool.llm.encoding import Encoder, encoder, stable_cuts
from tidepool.llm.hilbert import hilbert_key
from tidepool.llm.packing import curve_keys, pack_documents, powers_of_two
from tidepool.llm.token_counts import count_column, count_tokens
from tidepool.llm.token_files import read_token_files, write_token_files

ODDS = ["a", "B", "é", "É", "ß", "'", "'s", "'re", "'LL", " ", "  ", "\n", "\n\n", "\t", "1", "23", "²", "×", "ª", "µ", "$", "#%", "<|endoftext|>", "<|", "\xa0", "\x1c", "—", "it's", "\r\n", "日本", "é", "\x00", "\x7f"]
BOTH = [("word_bpe_49k.json", "word"), ("byte_bpe_50k.json", "byte")]


def encoded(enc, texts):
    out = []
    for _, ids, bounds in enc.encode_column(pa.array(texts, pa.string())):
        out += [ids[bounds[i] : bounds[i + 1]].tolist() for i in range(len(bounds) - 1)]
    return out


@pytest.mark.parametrize(("name", "style"), BOTH)
def test_ids_are_the_librarys(name, style):
    rnd = random.Random(3)
    texts = ["".join(rnd.choice(ODDS) for _ in range(rnd.randint(0, 14))) for _ in range(3000)] + ["", "x" * 5000, " " * 99]
    enc = encoder(name, style)
    assert encoded(enc, texts) == [e.ids for e in enc.library.encode_batch(texts, add_special_tokens=False)]
    assert encoded(enc, [None, "a"])[0] == []


@pytest.mark.parametrize(("name", "style"), BOTH)
@given(text=st.text(st.sampled_from([c for o in ODDS for c in o]), max_size=40))
@settings(max_examples=150, deadline=None)
def test_stable_cuts_split_encodings(name, style, text):
    enc = encoder(name, style)
    whole = enc.library.encode(text, add_special_tokens=False).ids
    data = np.frombuffer(text.encode(), dtype=np.uint8)
    for p in stable_cuts(data):
        parts = [data[:p].tobytes().decode(), data[p:].tobytes().decode()]
        assert [i for t in parts for i in enc.library.encode(t, add_special_tokens=False).ids] == whole


@pytest.mark.parametrize(("window", "overlap"), [(97, 5), (700, 40)])
def test_windows_are_spliced(window, overlap):
    rnd = random.Random(1)
    enc = encoder("byte_bpe_50k.json", "byte")
    texts = ["x" * 3000, " " * 2000, "a " * 1500 + "é" * 2000 + " b" * 300, "日本語" * 900 + " ok " * 40, "".join(rnd.choice(ODDS) for _ in range(3000)), "", None]
    got = np.concatenate([n for _, n, _, _ in count_column(enc, pa.array(texts), window, overlap)])
    widened = sum(w.sum() for *_, w in count_column(enc, pa.array(texts), window, overlap))
    assert got.tolist() == [len(enc.library.encode(t or "", add_special_tokens=False).ids) for t in texts]
    assert widened > 0  # some overlaps have no stable boundary


@pytest.mark.parametrize(("name", "style"), BOTH)
def test_equal_hashes_of_different_words_do_no_harm(monkeypatch, name, style):
    texts = ["a cat sat on a mat", "a dog sat in a bag", "a cat"]
    monkeypatch.setattr(bt, "span_hashes", lambda data, starts, lengths: np.ones(len(starts), np.uint64))
    enc = Encoder(encoder(name, style).path, style)
    want = [e.ids for e in enc.library.encode_batch(texts, add_special_tokens=False)]
    assert encoded(enc, texts) == want == encoded(enc, texts)


def test_count_tokens_rows(spark):
    rows = [(1, "Hello world", 9), (2, None, 9), (3, "", 9), (1, "Hello world", 9), (None, "é " * 600, 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    got = {(r["doc_id"], r["n_bytes"]): (r["n_tokens"], r["over_limit"]) for r in count_tokens(df).collect()}
    assert got[1, 11] == (2, False) and got[2, 0] == (0, False) and got[3, 0] == (0, False)
    assert got[None, 1800][1]
    assert count_tokens(df).count() == 5 and count_tokens(df.limit(0)).count() == 0


def ids_of(text):
    return np.array(encoder("word_bpe_49k.json", "word").library.encode(text or "", add_special_tokens=False).ids + [1], dtype="<u4")


DOCS = [(5, "The cat sat."), (2, None), (9, ""), (3, "word " * 9000), (5, "The cat sat."), (7, "naïve café — ok"), (None, "no id")]


def test_token_files_round_trip(spark, tmp_path):
    df = spark.createDataFrame(DOCS, "doc_id long, text string").withColumn("start", F.lit(1))
    path = f"file://{tmp_path}/files"
    write_token_files(df, path, segment_bytes=200)
    rows = sorted(read_token_files(spark, path).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in rows] == [None, 2, 3, 5, 5, 7, 9]
    text, at = dict(DOCS), 0
    for r in rows:
        want = ids_of(text[r["doc_id"]])
        assert bytes(r["ids"]) == want.tobytes() and r["n_tokens"] == len(want) and r["start"] == at
        at += len(want)
    some = read_token_files(spark, path, doc_ids=[7, 9]).collect()
    assert {r["doc_id"]: r["start"] for r in some} == {r["doc_id"]: r["start"] for r in rows if r["doc_id"] in (7, 9)}
    empty = f"file://{tmp_path}/empty"
    write_token_files(df.limit(0), empty)
    assert read_token_files(spark, empty).count() == 0


def wordy(n, seed):
    rnd = random.Random(seed)
    words = [f"{a}{b}" for a in ("sun", "tide", "rock", "moss", "wind") for b in ("", "s", "ed", "ing", "less")]
    return [(k, " ".join(rnd.choice(words) for _ in range(rnd.randint(1, 120)))) for k in range(n)]


def test_a_trained_dictionary_round_trips(spark, tmp_path):
    docs = [*wordy(700, 1), (10_000, "café " * 300_000), (10_001, "")]
    path = f"file://{tmp_path}/files"
    write_token_files(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), path)
    head = spark.read.parquet(f"{path}/dictionary").first()
    assert bytes(head["dictionary"][:4]) == bytes.fromhex("37a430ec")  # zstandard's mark of a trained dictionary
    at = 0
    for (i, text), r in zip(docs, sorted(read_token_files(spark, path).collect(), key=lambda r: r["start"]), strict=True):
        want = ids_of(text)
        assert (r["doc_id"], r["start"], r["n_tokens"], bytes(r["ids"])) == (i, at, len(want), want.tobytes())
        at += len(want)
    other = bytes(head["dictionary"]) + b"x"
    for digest, raised in ((head["dict_hash"], "damaged"), (hashlib.sha256(other).hexdigest(), "another dictionary")):
        spark.createDataFrame([(digest, other, head["tokenizer"], 2)], "dict_hash string, dictionary binary, tokenizer string, id_bytes int").write.mode("overwrite").parquet(f"{path}/dictionary")
        with pytest.raises(Exception, match=raised):
            read_token_files(spark, path).collect()


def packed_fully(rows, docs, sequence):
    """Check pieces against a plain version: all ids once, sequences without gaps, documents along the curve."""
    rows = sorted(rows, key=lambda r: (r["sequence_id"], r["offset"]))
    ids = [ids_of(t) for _, t in docs]
    keys = [int(curve_keys(x.astype(np.uint16), np.array([0, len(x)]))[0]) for x in ids]
    lost = Counter((d, x.tobytes()) for (d, _), x in zip(docs, ids))
    order, at = [], 0  # documents, end to end
    stream = b"".join(bytes(r["ids"]) for r in rows)
    while at < len(rows):
        assert rows[at]["start"] == 0
        total, begin, doc = rows[at]["doc_tokens"], sum(r["length"] for r in rows[:at]), rows[at]["doc_id"]
        have = 0
        while have < total:
            assert (rows[at]["doc_id"], rows[at]["start"], rows[at]["doc_tokens"]) == (doc, have, total) and len(rows[at]["ids"]) == 4 * rows[at]["length"] > 0
            have, at = have + rows[at]["length"], at + 1
        whole = stream[4 * begin : 4 * (begin + total)]
        lost[doc, whole] -= 1
        order.append((next(k for k, x in zip(keys, ids) if x.tobytes() == whole), -1 if doc is None else doc))
    assert order == sorted(order) and not any(lost.values())
    for _, g in itertools.groupby(rows, key=lambda r: r["sequence_id"]):
        end = 0
        for r in g:
            assert r["offset"] == end
            end += r["length"]
        assert end == sequence or (end < sequence and end & (end - 1) == 0)


def test_packing_against_a_plain_version(spark):
    docs = [*DOCS, *((k + 100, t) for k, t in wordy(200, 2)), *[(50, "the same row")] * 40]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("key", F.lit("x")).repartition(3)
    packed_fully(pack_documents(df, sequence=64).collect(), docs, 64)
    packed_fully(pack_documents(df.where("doc_id = 3")).collect(), [(3, "word " * 9000)], 2048)
    assert pack_documents(df.limit(0)).count() == 0


def test_powers_of_two():
    assert powers_of_two(1300) == [1024, 256, 16, 4] and powers_of_two(0) == []


def test_hilbert_key_is_a_walk():
    points = np.array([(x, y) for x in range(16) for y in range(16)])
    order = points[np.argsort(hilbert_key(points, 4))]
    assert sorted(hilbert_key(points, 4).tolist()) == list(range(256))
    assert (np.abs(np.diff(order, axis=0)).sum(axis=1) == 1).all()


def test_like_documents_are_near_on_the_curve():
    a, b = np.arange(100, dtype=np.uint16), np.arange(9000, 9100, dtype=np.uint16)
    ids = np.concatenate([a, b, a])
    keys = curve_keys(ids, np.array([0, 100, 200, 300]))
    assert keys[0] == keys[2] != keys[1]
