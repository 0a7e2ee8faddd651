"""MinHash near-duplicates against all pairs of small corpora, and signatures alone."""

import random
import re
from math import comb

import numpy as np
import pytest

from tidepool.llm import jaccard as J
from tidepool.llm import minhash as M


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def plain(docs):
    sets = [(i, shingles(t)) for i, t in docs]
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in sets:
        for j, b in sets:
            if i is not None and j is not None and i < j and a and b and 100 * len(a & b) >= 85 * len(a | b):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return sorted(((i, len(a), None if i is None else find(i), None if i is None else find(i) == i) for i, a in sets), key=str)


def found(spark, docs):
    df = spark.createDataFrame([(*d, 7, "x") for d in docs], "doc_id long, text string, n int, kept string").repartition(3)
    return sorted((tuple(r) for r in M.near_duplicates(df).select("doc_id", "n_shingles", "component_id", "kept").collect()), key=str)


def corpus(seed, changes=6):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    common = " ".join(rnd.choice(words) for _ in range(60))
    docs = ["", None, " \t\n", "One two", "one TWO", "a a a a a a a a", "b b b b b b b b", "é É five six seven", "w " * 3000]
    for length in (120, 400, 9):
        base = [rnd.choice(words) for _ in range(length)]
        for _ in range(50):  # near copies, many of whose pairs lie near the threshold
            t = list(base)
            for _ in range(rnd.randint(0, changes)):
                t[rnd.randrange(len(t))] = rnd.choice(words)
            docs.append(" ".join(t))
        docs += [" ".join(base)] * 5
    for _ in range(60):
        own = " ".join(rnd.choice(words) for _ in range(rnd.randint(1, 80)))
        docs.append(own + (" " + common if rnd.random() < 0.5 else ""))
    order = list(range(len(docs)))
    rnd.shuffle(order)
    return [(i + 10, d) for i, d in zip(order, docs)]


@pytest.mark.parametrize("seed", [1, 2])
def test_components_are_those_of_all_pairs(spark, monkeypatch, seed):
    if seed == 2:  # few leaders and hot lists, so that the second pass and the dealing have work
        monkeypatch.setattr(M, "LEADERS", 1)
        monkeypatch.setattr(J, "HOT", 4)
    docs = corpus(seed)
    assert found(spark, docs) == plain(docs)


def test_odd_rows(spark):
    base = " ".join(f"word{i}" for i in range(60))
    docs = [(1, base), (1, base), (2, base + " more"), (None, base), (3, None), (3, ""), (4, "x"), (5, "X"), (6, "y " * 200_000), (7, "y " * 200_001)]
    assert found(spark, docs) == plain(docs)
    assert found(spark, []) == []
    # rows that share an id are one node
    other = " ".join(f"other{i}" for i in range(60))
    got = found(spark, [(1, base), (5, base), (5, other), (9, other)])
    assert {r[2] for r in got} == {1}


def test_pairs_of_a_form_stay_few(spark, monkeypatch):
    """Texts of eight fields with four fixed phrases each: lists are long, no two texts link, and few pairs are looked at."""
    rnd = random.Random(3)
    phrases = [[" ".join(f"p{f}{v}{i}" for i in range(12)) for v in range(4)] for f in range(8)]
    docs = {tuple(rnd.randrange(4) for _ in range(8)) for _ in range(1500)}
    docs = [(k, " ".join(phrases[f][v] for f, v in enumerate(d))) for k, d in enumerate(sorted(docs))]
    sizes = []
    linked = J._linked
    monkeypatch.setattr(J, "_linked", lambda pairs, *a: (sizes.append(pairs.count()), linked(pairs, *a))[1])
    got = found(spark, docs)
    assert all(r[2] == r[0] for r in got)
    assert sum(sizes) < 40 * len(docs)  # all pairs: 750 a document


def test_signatures_agree_as_often_as_sets_overlap():
    rnd = np.random.default_rng(1)
    for j in (0.3, 0.85):
        agree, near = [], []
        for _ in range(60):
            n = 400
            common = int(2 * n * j / (1 + j))
            h = rnd.integers(0, 1 << 63, 2 * n, dtype=np.uint64)
            sets = np.concatenate([h[:n], h[n - common : 2 * n - common]])
            s = M.signature_rows(sets, np.array([0, n, 2 * n]))
            agree.append((s[0] == s[1]).mean())
            near.append(sum(bin(int(x) ^ int(y)).count("1") == 0 for x, y in zip(s[0] & 15, s[1] & 15)) / M.COORDINATES)
            b = M.nibbles(s)
            packed = sum(((int(x[0]) ^ int(x[1])) >> (4 * k)) & 15 == 0 for x in b for k in range(16))
            assert packed == round(near[-1] * M.COORDINATES)
        assert abs(np.mean(agree) - j) < 0.03


def test_threshold_of_matches():
    p = sum(comb(64, m) * 0.85**m * 0.15 ** (64 - m) for m in range(M.MATCHES))
    assert p <= 1e-9 and M.MATCHES == 34 and M.PREFIX == 31
