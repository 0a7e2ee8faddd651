"""Quality rules and personal data against plain Python versions."""

import hashlib
import re
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidepool.llm import bytetext as bt
from tidepool.llm import pii
from tidepool.llm.pii import find_pii, joined, redact
from tidepool.llm.quality import MEASURES, RULES, Survey, Texts, cascade, keep_documents, order_rules, quality_cascade, survey_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def measured(text):
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    eights = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    hit = {k for i in range(len(w) - 7) if eights[tuple(w[i : i + 8])] > 1 for k in range(i, i + 8)}
    return {
        "n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)), "n_lines": len(lines),
        "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(hit), "n_letter_words": sum(bool(re.search(r"[A-Za-z]|[^\x00-\x7f]", x)) for x in w),
        "n_stutters": sum(a == b for a, b in zip(w, w[1:])),
    }


TEXT = st.lists(st.sampled_from(["a", "bb", "é", "#", "12", " ", "\n", "\n\n", "the", " cat ", "\t", "日本", "a b c d e f g h ", "\x00", "\x01", "abcdef", "abcdefg", "abcdefgh", "\x1f"]), max_size=60).map("".join)


@given(texts=st.lists(TEXT, max_size=6))
@settings(max_examples=200, deadline=None)
def test_measures(texts):
    t = Texts(*bt.buffers(pa.array(texts, pa.string())))
    want = [measured(x) for x in texts]
    for name, f in MEASURES.items():
        assert f(t).tolist() == [m[name] for m in want], name


def test_words_that_differ_in_a_control_character_differ():
    texts = ["abcdef\nabcdef\x01\nabcdef", "abcdefg\nabcdefg\x00", "abcdefgh\nabcdefgh\x00", "\x00\n\x00\x00"]
    assert MEASURES["n_dup_lines"](Texts(*bt.buffers(pa.array(texts)))).tolist() == [1, 0, 0, 0]


@given(texts=st.lists(TEXT, min_size=1, max_size=8), seed=st.integers(0, 99))
@settings(max_examples=100, deadline=None)
def test_cascade_is_a_conjunction_in_any_order(texts, seed):
    rules = [RULES[i] for i in np.random.default_rng(seed).permutation(len(RULES))]
    kept, _ = cascade(Texts(*bt.buffers(pa.array(texts))), rules)
    want = [not any(r.rejects({k: np.array([v]) for k, v in measured(x).items()})[0] for r in RULES) for x in texts]
    assert kept.tolist() == want


def test_rules_run_by_rejection_per_cost_beyond_what_is_paid():
    at = {r.name: k for k, r in enumerate(RULES)}
    cost = {"words": 4.0, "hashes": 4.0} | dict.fromkeys(MEASURES, 1.0)
    names = lambda survey, paid=(): [r.name for r in order_rules(RULES, survey, paid)]
    rejected = Counter({0: 60, 1 << at["symbols"]: 10, 1 << at["few_words"]: 20, 1 << at["stutter"]: 12, 1 << at["few_words"] | 1 << at["short_words"]: 4})
    # symbols: 10 for 2 seconds; few_words: 24 for 5; stutter then shares the words: 12 for 6; short_words has nothing left to reject
    assert names(Survey(cost, rejected))[:3] == ["symbols", "few_words", "stutter"]
    assert names(Survey(cost, rejected), ["n_words"])[:2] == ["few_words", "symbols"]
    assert names(Survey()) == [r.name for r in RULES]


def test_survey_counts_rejections(spark):
    docs = [(1, GOOD), (2, ""), (3, "buy " * 50), (3, "buy " * 50)]
    got = survey_rules(spark.createDataFrame(docs, "doc_id long, text string"))
    want = Counter(sum(int(r.rejects({k: np.array([v]) for k, v in measured(t).items()})[0]) << k for k, r in enumerate(RULES)) for _, t in docs)
    assert got.rejected_by == want and {"words", "hashes", "n_repeat_words"} <= set(got.cost)


GOOD = "This is a plain text of some length. " + " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60))


def test_quality_rows(spark):
    rows = [(1, GOOD), (2, None), (3, ""), (4, "buy " * 50), (1, GOOD), (5, "| # " * 40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("kept", F.lit("x"))
    got = [(r["doc_id"], r["kept"]) for r in quality_cascade(df, measures=["n_words"]).collect()]
    assert sorted(got) == [(1, True), (1, True), (2, False), (3, False), (4, False), (5, False)]
    kept = keep_documents(df)
    assert kept.columns == df.columns and [r["doc_id"] for r in kept.collect()] == [1, 1]
    assert keep_documents(df.limit(0)).count() == 0


# -- personal data ------------------------------------------------------------------

EMAIL, IP = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD, PHONE = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(d):
    return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


def base_spans(t):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out = [(m.start(), 0, m.end(), "email") for m in EMAIL.finditer(t)]
    out += [(m.start(), 1, m.end(), "ip") for m in IP.finditer(t) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [(m.start(), 2, m.end(), "card") for m in CARD.finditer(t) if 12 <= len(digits(m)) <= 19 and luhn(digits(m))]
    out += [(m.start(), 3, m.end(), "phone") for m in PHONE.finditer(t) if 9 <= len(digits(m)) <= 15]
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(out))


def test_base_spans_are_those_of_the_plain_patterns(spark):
    import random

    rnd = random.Random(5)
    bits = ["a", "@", ".", "b.c", "-", "_", " ", "x@y.z", "1", "255", "256", "0", "007", "1.2.3.4", "+", "+1 (555) 123-4567", "4111 1111 1111 1111", "4111111111111111", "日", "é", "\n", "%", "12-34 56", "00"]
    texts = ["".join(rnd.choice(bits) for _ in range(rnd.randint(0, 25))) for _ in range(3000)] + [None, "", "9" * 5000, "a" * 5000 + "@b", "a@b." * 500]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    base = F.filter("pii", lambda s: s["kind"].isin("email", "ip", "card", "phone"))
    got = {r[0]: r[1] for r in find_pii(df).select("doc_id", joined(base)).collect()}
    for i, t in enumerate(texts):
        assert got[i] == base_spans(t or ""), t


@pytest.mark.parametrize(("text", "kinds"), [
    ("pay to GB82 WEST 1234 5698 7654 32 now", ["iban"]),
    ("pay to GB82 WEST 1234 5698 7654 33 now", []),
    ("SSN 123-45-6789", ["ssn"]),
    ("part 123-45-6789", []),
    ('token = "f91f2b873bc89b9c5b8b3a486adf3aaa"', ["secret"]),
    ("hash f91f2b873bc89b9c5b8b3a486adf3aaa", []),
    ("mail me at a.b@example.com", ["email"]),
])
def test_further_kinds_need_proof(spark, text, kinds):
    df = spark.createDataFrame([(text,)], "text string")
    assert [s["kind"] for s in find_pii(df).first()["pii"]] == kinds


@pytest.mark.parametrize(("text", "clean"), [
    ("IBAN DE89370400440532013000 Thanks", "IBAN <IBAN> Thanks"),
    ("IBAN GB82 WEST 1234 5698 7654 32 Please pay", "IBAN <IBAN> Please pay"),
    ("IBAN DE89370400440532013000 BIC COBADEFFXXX", "IBAN <IBAN> BIC COBADEFFXXX"),
    ("IBAN DE89 3704 0044 0532 0130 00 2024 invoice", "IBAN <IBAN> 2024 invoice"),
    ("IBAN DE89 3704 0044 0532 0130 00 1234567890 AND MORE", "IBAN <IBAN> 1234567890 AND MORE"),
    ("IBAN DE89 3704 0044 0532 0130 00 GB82 WEST 1234 5698 7654 32.", "IBAN <IBAN> <IBAN>."),
    ("REF AB12 DE89370400440532013000", "REF AB12 <IBAN>"),
    ("é DE89370400440532013000\nGB82WEST12345698765432", "é <IBAN>\n<IBAN>"),
    ("IBAN DE89370400440532013001 Thanks", "IBAN DE89370400440532013001 Thanks"),
    ("IBAN DE89370400440532013000a", "IBAN DE89370400440532013000a"),
    ("xDE89370400440532013000 Thanks", "xDE89370400440532013000 Thanks"),
])
def test_iban_ends_where_its_checksum_says(spark, text, clean):
    assert redact(spark.createDataFrame([(text,)], "text string")).first()["text"] == clean


def test_very_many_spans_in_a_text(spark):
    parts = ["mail é a%d@b.cd" % k for k in range(100_000)]
    text = ", ".join(parts)
    df = spark.createDataFrame([(text,)], "text string")
    began = time.perf_counter()
    base = F.filter("pii", lambda s: s["kind"] == "email")
    assert find_pii(df).select(joined(base)).first()[0] == base_spans(text)
    assert redact(df).first()["text"] == ", ".join(["mail é <EMAIL>"] * 100_000)
    ibans = " ".join(["IBAN DE89370400440532013000"] * 5000)
    assert redact(spark.createDataFrame([(ibans,)], "text string")).first()["text"] == " ".join(["IBAN <IBAN>"] * 5000)
    assert time.perf_counter() - began < 120


def test_blocks_do_not_show(spark, monkeypatch):
    rows = [(" 1.2.3.4 mail a@b.cd x " * 9 + "card 4111 1111 1111 1111 " * 5,), ("+1 (555) 123-4567 " * 7 + "GB82 WEST 1234 5698 7654 32 " * 4,), ("1.2.3.4@b.cd " * 6,)]
    df = spark.createDataFrame(rows, "text string")
    seen = []
    for size in (256, 1, 2, 5):
        monkeypatch.setattr(pii, "BLOCK", size)
        seen.append((find_pii(df).collect(), redact(df).collect()))
    assert seen[0] == seen[1] == seen[2] == seen[3]


def test_redact_keeps_columns(spark):
    df = spark.createDataFrame([(1, "é a@b.cd and 1.2.3.4!", "p", "t"), (2, None, "p", "t"), (3, "clean", "p", "t"), (3, "clean", "p", "t")], "doc_id long, text string, pii string, __pii_text string")
    got = redact(df)
    assert got.columns == df.columns
    assert [r["text"] for r in got.orderBy("doc_id").collect()] == ["é <EMAIL> and <IP>!", None, "clean", "clean"]
    assert find_pii(df.limit(0)).count() == 0
    assert "Python" not in redact(df)._jdf.queryExecution().executedPlan().toString()


def test_hash_of_no_spans(spark):
    r = find_pii(spark.createDataFrame([("",)], "text string")).select(F.sha2(joined(F.col("pii")), 256)).first()
    assert r[0] == hashlib.sha256(b"").hexdigest()
