"""Vector codes against plain loops over all entries, and the kd-tree alone."""

import hashlib
import math
import random

import numpy as np
import pytest

from tidepool.llm.vector_codes import KdTree, encode_vectors


def plain(rows, parts=16, entries=64, rounds=2):
    """{(id, label, code, error, label_error, sha): count} of rows (id, vector, label), by loops."""
    kept = [(i, v, c) for i, v, c in rows if v is not None and v and len(v) % parts == 0 and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not kept:
        return []
    dim = len(kept[0][1])
    kept = [r for r in kept if len(r[1]) == dim]
    w = dim // parts
    cut = [[[math.floor(256 * x) for x in v[p * w : (p + 1) * w]] for p in range(parts)] for _, v, _ in kept]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]

    def best(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, e)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            to = [best(c[p], books[p])[1] for c in cut]
            for e in range(len(books[p])):
                mine = [c[p] for c, t in zip(cut, to) if t == e]
                if mine:
                    books[p] = [*books[p][:e], [sum(x) // len(mine) for x in zip(*mine)], *books[p][e + 1 :]]
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    final = [[best(c[p], books[p]) for p in range(parts)] for c in cut]
    errors = [sum(d for d, _ in f) for f in final]
    of = {}
    for (_, _, label), e in zip(kept, errors):
        of[label] = of.get(label, 0) + e
    return sorted(((i, c, "".join(f"{k:02x}" for _, k in f), e, of[c], sha) for (i, _, c), f, e in zip(kept, final, errors)), key=str)


def coded(spark, rows, kind="float", **options):
    df = spark.createDataFrame([(*r, "x") for r in rows], f"vec_id long, embedding array<{kind}>, label int, code string").repartition(3)
    return sorted(map(tuple, encode_vectors(df, **options).collect()), key=str)


def vectors(n, seed, dim=32, grid=4):
    """Coarse components, so that distances tie often."""
    rnd = random.Random(seed)
    return [(k, [rnd.randrange(-grid, grid) / 8 for _ in range(dim)], rnd.choice([None, 0, 0, 0, 1, 2])) for k in range(n)]


def test_codes_are_those_of_plain_loops(spark):
    rows = vectors(300, 1)
    rnd = random.Random(2)
    rows += [(1000 + k, [rnd.gauss(0, 0.2) for _ in range(32)], 3) for k in range(60)]
    rows = [(i, [float(np.float32(x)) for x in v], c) for i, v, c in rows]
    assert coded(spark, rows) == plain(rows)


def test_odd_rows_have_defined_results(spark):
    rows = vectors(20, 3)
    rows += [rows[5], rows[5], (5, rows[6][1], 2), (None, rows[0][1], None), (-1, None, 1), (-2, [], 1), (-3, [0.5] * 33, 1), (50, [0.5] * 16, 1)]
    rows += [(-4, [None] + [0.0] * 31, 1), (-5, [float("nan")] + [0.0] * 31, 1), (-6, [float("inf")] + [0.0] * 31, 1)]
    got = coded(spark, rows, entries=8)
    assert got == plain(rows, entries=8) and len(got) == 24
    assert coded(spark, []) == [] and coded(spark, [(1, None, 2)]) == []
    huge = [(1, [1e300] * 16, 1), (2, [-1e300] * 16, 1), (3, [0.0] * 16, None)]
    assert [r[2] for r in coded(spark, huge, "double")] == ["00" * 16, "01" * 16, "02" * 16]


def test_labels_with_most_rows_are_dealt_out(spark):
    rows = [(k, v, 7 if k % 3 else k) for k, v, _ in vectors(400, 4, 16)]
    assert coded(spark, rows) == plain(rows)


@pytest.mark.parametrize("seed", range(4))
def test_tree_finds_the_lowest_of_equal_entries(seed):
    rnd = np.random.default_rng(seed)
    points, rows = rnd.integers(-3, 4, (64, 4)), rnd.integers(-5, 6, (2000, 4))
    entry, far = KdTree(points).nearest(rows)
    d = ((rows[:, None] - points[None]) ** 2).sum(axis=2)
    assert (far == d.min(axis=1)).all() and (entry == d.argmin(axis=1)).all()
