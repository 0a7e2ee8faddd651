"""Conversation repair against plain Python: all edit sequences of small cases, and a table of costs for whole conversations."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from tidepool.llm import conversation_repair as R
from tidepool.llm.queries import repair_report

SPACE = "[^\x20\x09-\x0d]"


def edit_sequences(signature, most_inserts=3):
    """(cost, audit, initials) of every way to edit a signature, with so many insertions at most."""

    def go(i, cost, audit, out, inserts):
        if i == len(signature):
            yield cost, audit, out
        else:
            c = signature[i]
            yield from go(i + 1, cost + 3, audit + "D", out, inserts)
            if c in R.SOUND + R.TRUNCATED:
                extra = c in R.TRUNCATED
                yield from go(i + 1, cost + extra, audit + "K", out + c.lower(), inserts)
                for r in "ua":
                    yield from go(i + 1, cost + extra + 2, audit + "R", out + r, inserts)
        if inserts:
            for r in "ua":
                yield from go(i, cost + 2, audit + "I", out + r, inserts - 1)

    return go(0, 0, "", "", most_inserts)


@pytest.mark.parametrize("n", [0, 1, 2, 3])
def test_every_small_signature(n):
    letters = "suaoSUA05" if n < 3 else "suaU0o"
    for s in map("".join, itertools.product(letters, repeat=n)):
        want = min((c, a) for c, a, out in edit_sequences(s) if re.fullmatch("(s?(ua)+)?", out))
        assert R.cheapest(s) == want, s


def best_by_table(letters):
    """(cost, audit) by going forward over rows with the least (cost, audit) for each last role."""
    best = {"": (0, "")}

    def insert(b):
        for _ in range(3):
            for last, (c, a) in list(b.items()):
                to, new = ("a" if last == "u" else "u"), (c + 2, a + "I")
                b[to] = min(b.get(to, new), new)
        return b

    for role, fault in letters:
        new = {}
        for last, (c, a) in insert(best).items():
            ways = [(last, c + 3, a + "D")]
            if fault not in ("blank", "duplicate"):
                cut = fault == "truncated"
                to = "a" if last == "u" else "u"
                ways.append((to, c + 2 + cut, a + "R"))
                if role == to or (role == "s" and last == ""):
                    ways.append((role, c + cut, a + "K"))
            for to, x, y in ways:
                new[to] = min(new.get(to, (x, y)), (x, y))
        best = new
    best = insert(best)
    return min(best[x] for x in ("", "a") if x in best)


def plain(rows):
    """The report of rows (conv, turn, role, text), in plain Python."""
    convs = {}
    for conv, turn, role, text in rows:
        convs.setdefault(conv, [])
        d = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if d == 1:
            text = ""
        if d == 2:
            text = re.sub("[.!?]", "", text)
        if d == 4:
            role = "user"
        convs[conv] += [(turn, role, text)] * {0: 0, 3: 2}.get(d, 1)
    out = []
    for conv, turns in convs.items():
        turns.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        known = [t for t, _, _ in turns if t is not None]
        seen, letters = set(), []
        for _, role, text in turns:
            said = re.findall(SPACE, text)
            fault = "blank" if not said else "duplicate" if (role, text) in seen else "truncated" if said[-1] not in ".!?" else ""
            seen.add((role, text))
            letters.append((role[:1], fault))
        cost, audit = best_by_table(letters)
        last, i, lines = "", 0, []
        for e in audit:
            to = "a" if last == "u" else "u"
            name = {"u": "user", "a": "assistant"}[to]
            _, role, text = turns[i] if i < len(turns) else (None, "", "")
            if e == "I":
                lines.append(f"{name}:")
                last = to
            elif e == "R":
                lines.append(f"{name}:{text}")
                last = to
            elif e == "K":
                lines.append(f"{role}:{text}")
                last = role[0]
            i += e != "I"
        count = lambda k: sum(f == k for _, f in letters)
        illegal = sum(a + b not in ("su", "ua", "au") for (a, _), (b, _) in itertools.pairwise(letters))
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        out.append((conv, gaps, count("blank"), count("duplicate"), count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


def report(spark, rows):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, k1 int, kind string").repartition(3)
    return sorted(map(tuple, repair_report(df).collect()), key=str)


def conversations(seed, n=60, longest=12):
    rnd = random.Random(seed)
    rows = []
    for c in range(n):
        for t in range(rnd.randint(1, longest)):
            role = rnd.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "up", "Üser"])
            text = rnd.choice(["Yes.", "No", "", None, " \t", "Why? ", "café…", f"Text {t}!", "a\nb."])
            rows.append((c, rnd.choice([t, 10 * c + 3 * t]), role, text))
    return [(c, t, r, x) for (c, t), (r, x) in {(c, t): (r, x) for c, t, r, x in rows}.items()]


def test_reports_are_those_of_plain_python(spark):
    rows = conversations(1)
    rows += [(900, None, "user", "Hi."), (901, -5, "assistant", "x"), (None, 0, "user", "a."), (None, 1, "assistant", "b.")]
    rows += [(902, 7, "user", "Same.")] * 5 + [(903, t, "user", "Same.") for t in range(9)]  # repeated rows, repeated texts
    rows += [(904, t, ["user", "assistant"][t % 2], f"turn {t}" + "." * (t % 3)) for t in range(1500)]
    rows.append((905, 0, "user", "long " * 50_000))
    assert report(spark, rows) == plain(rows)


def test_empty_table_and_far_turns(spark):
    assert report(spark, []) == []
    rows = [(1, -(2**63), "user", "a."), (1, 2**63 - 1, "assistant", "b."), (2, 0, "user", "a."), (2, 2**40, "assistant", "b.")]
    got = report(spark, rows)
    assert [r[7] for r in got] == [r[7] for r in plain(rows)]


def test_turns_are_those_that_the_digest_hashes(spark):
    df = spark.createDataFrame(conversations(2, 25), "conv_id long, turn long, role string, text string").repartition(3)
    found = R.audits(df)
    turns = {}
    for r in R.repaired_turns(df, found).collect():
        turns.setdefault(r["conv"], []).append((r["place"], f"{r['role']}:{r['text']}"))
    for r in R.repaired_digests(df, found).collect():
        lines = sorted(turns.get(r["conv"], []))
        assert [p for p, _ in lines] == list(range(len(lines)))
        assert r["repaired_sha256"] == hashlib.sha256("\n".join(x for _, x in lines).encode()).hexdigest()


def test_a_signature_that_many_share_is_dealt_out(spark):
    rows = [(c, t, ["user", "assistant"][t % 2], f"text {t}.") for c in range(900) for t in range(4)]
    assert report(spark, rows) == plain(rows)


def test_long_signatures_need_no_deep_recursion():
    cost, audit = R.cheapest("ua" * 30_000 + "u")
    assert (cost, len(audit)) == (2, 60_002) and audit.endswith("KI")
