"""Personal data in texts, with DataFrame functions alone.

Regular expressions propose spans.  Validators confirm them: octets of at most
255, digit counts, the Luhn sum of a card, the mod-97 remainder of an IBAN.
Words near a span raise or lower its score.  Spans of the base kinds (email, ip,
card, phone) stay whatever their score; those of the further kinds (iban, ssn,
secret) count from ``THRESHOLD`` on.  Positions are code points, the end is
exclusive, and within a kind spans are leftmost and do not overlap.

Where a span could only begin at the start of a run of its characters, or where
the match before ended, the pattern says so, and repeats give nothing back.  The
matches are those of the plain pattern, in time linear in the text.  Spans are
folded in blocks of ``BLOCK``, each with its own part of the text, so that a text
with very many spans is not walked, or a long array copied, for each of them.

An IBAN's end is not known from its pattern, as what follows may look like more of
it.  Its pattern finds the first four characters; of the ends at word boundaries
that make the mod-97 remainder right, that of the country's length is taken, or
else the last.

Null and empty texts have no spans.  Each row is judged by itself: repeats, ties
and empty tables need no rule.  All other columns of the input are passed on; one
that has the name of the result is replaced by it.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepool.llm.tables import fresh_name

THRESHOLD, BEFORE, AFTER, BLOCK = 0.5, 40, 20, 256
NEGATIVE = r"\b(?:example|sample|dummy|fake|version|isbn|invoice no|order no)\b"


@dataclass(frozen=True)
class Kind:
    """A kind of span: its pattern, a validator of the match, a prior score, and words that make it likelier."""

    name: str
    pattern: str
    valid: str | None
    prior: float
    context: str
    base: bool = False
    hint: str | None = None  # a text without this string holds no match
    whole: str | None = None  # the longest span from where the pattern matches; it may end at any space in it


BASE = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", None, 0.9, r"mail|contact|write", True, "@"),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", "octets", 0.6, r"\bip\b|address|host|server|login", True, "."),
    Kind("card", r"[0-9](?:[\x20-]?[0-9]){11,}+", "luhn", 0.8, r"card|visa|credit|payment|karte|tarjeta|carte", True),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "phone", 0.7, r"phone|tel|call|mobile|fax", True, "+"),
)
FURTHER = (
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?=(?:\x20?[A-Z0-9]){11})", "mod97", 0.8, r"iban|account|konto|bank|cuenta|compte", whole=r"^[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])"),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", None, 0.4, r"\bssn\b|social security", hint="-"),
    Kind("secret", r"(?<![A-Za-z0-9])[A-Za-z0-9]{32,64}+(?![A-Za-z0-9])", "mixed", 0.3, r"(?:token|secret|passw(?:or)?d|api[_ -]?key)[\"']?\s*[:=]"),
)
KINDS = BASE + FURTHER

#: Characters of an IBAN by country; other countries' may have any length that the pattern allows.
_IBAN_LENGTHS = (
    "NO15 BE16 DK18 FI18 FO18 GL18 NL18 MK19 SI19 AT20 BA20 EE20 KZ20 LT20 LU20 XK20 CH21 HR21 LI21 LV21 BG22 BH22 CR22 DE22 GB22 GE22 IE22 ME22 RS22 VA22 "
    "AE23 GI23 IL23 IQ23 OM23 SO23 TL23 AD24 CZ24 ES24 MD24 PK24 RO24 SA24 SE24 SK24 TN24 VG24 LY25 PT25 ST25 IS26 TR26 BI27 DJ27 FR27 GR27 IT27 MC27 MR27 SM27 "
    "AL28 AZ28 BY28 CY28 DO28 GT28 HN28 HU28 LB28 NI28 PL28 SV28 BR29 EG29 PS29 QA29 UA29 JO30 KW30 MN20 MU30 SD18 YE30 MT31 SC31 LC32 RU33 FK18"
).split()
WINDOW = 69  # 34 characters of an IBAN, each after a space, and the next one

_SPAN = "array<struct<start:bigint,end:bigint,hit:string>>"
_FOUND = "array<struct<start:bigint,rank:int,end:bigint,kind:string,score:double>>"


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check: from the right, every second digit doubled, nines cast out."""
    turned = F.split(F.reverse(digits), "")
    total = F.aggregate(
        F.transform(turned, lambda d, i: F.when(i % 2 == 0, d.cast("int")).when(d.cast("int") < 5, d.cast("int") * 2).otherwise(d.cast("int") * 2 - 9)),
        F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0)),
    )
    return total % 10 == 0


def mod97(hit: Column) -> Column:
    """Whether an IBAN (its first four characters moved to the end, letters as 10 to 35) is 1 modulo 97."""
    plain = F.regexp_replace(hit, " ", "")
    moved = F.split(F.concat(F.substr(plain, F.lit(5)), F.substring(plain, 1, 4)), "")
    step = lambda a, c: F.when(c == "", a).when(c.between("0", "9"), (a * 10 + c.cast("int")) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(moved, F.lit(0), step) == 1


def _valid(kind: Kind, hit: Column) -> Column:
    if kind.valid == "octets":
        octet = "0*+(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
        # a lone zero is eaten by the leading zeros, so an octet may also be zeros alone
        return hit.rlike(rf"^(?:{octet}|0+)(?:\.(?:{octet}|0+)){{3}}$")
    if kind.valid == "luhn":
        d = _digits(hit)
        return F.length(d).between(12, 19) & luhn(d)
    if kind.valid == "phone":
        return F.length(_digits(hit)).between(9, 15)
    if kind.valid == "mod97":
        return mod97(hit)
    if kind.valid == "mixed":
        return hit.rlike("[0-9]") & hit.rlike("[A-Za-z]")
    return F.lit(True)


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _blocks(items: Column) -> Column:
    """An array in blocks, none for an empty one."""
    cut = lambda x: F.transform(F.sequence(F.lit(0), F.greatest(F.size(x) - 1, F.lit(0)), F.lit(BLOCK)), lambda k: F.slice(x, k + 1, F.lit(BLOCK)))
    return F.filter(_let(items, cut), lambda part: F.size(part) > 0)


def _scan(items: Column, kind: str, put: Callable[..., Column], setup: Callable[[Column, Column], Column] | None = None, finish: Callable[[Column], Column] | None = None) -> Column:
    """A running fold.  ``put(at, item, own)`` gives struct(at, out); the arrays ``out`` (of type ``kind``) are strung together.

    ``at`` begins at 0.  ``own`` is what ``setup(at, block)`` gives once for a block.
    ``finish(at)`` is a last ``out``.
    """
    none = F.array().cast(kind)

    def block(a, part):
        own = setup(a["at"], part) if setup else F.lit(0)
        step = lambda b, z, o: _let(put(b["at"], z, o), lambda r: F.struct(r["at"].alias("at"), F.concat(b["out"], r["out"]).alias("out")))
        inner = _let(own, lambda o: F.aggregate(part, F.struct(a["at"].alias("at"), none.alias("out")), lambda b, z: step(b, z, o)))
        return _let(inner, lambda r: F.struct(r["at"].alias("at"), F.concat(a["out"], F.array(r["out"])).alias("out")))

    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(f"array<{kind}>").alias("out"))
    last = (lambda a: F.flatten(F.concat(a["out"], F.array(finish(a["at"]))))) if finish else (lambda a: F.flatten(a["out"]))
    return F.aggregate(_blocks(items), start, block, last)


def _near(text: Column, spans: Column, before: int, after: int, f: Callable[[Column, Callable[[Column, Column], Column]], Column]) -> Column:
    """f(span, cut) of each span; cut(position, length) is the text there, from so many characters before a span to so many behind its block."""

    def block(part):
        base = F.greatest(F.element_at(part, 1)["start"] - before, F.lit(0))
        size = F.element_at(part, -1)["end"] + after - base
        own = F.struct(base.alias("base"), F.substr(text, base.cast("int") + 1, size.cast("int")).alias("text"))
        return _let(own, lambda o: F.transform(part, lambda s: f(s, lambda at, n: F.substr(o["text"], (at - o["base"]).cast("int") + 1, n.cast("int")))))

    return F.flatten(F.transform(_blocks(spans), block))


def _spans(text: Column, hits: Column, pattern: str) -> Column:
    """Matches with positions: the texts between them, from split, give the distances."""

    def put(at, z, _):
        begin = at + F.length(z["gaps"])
        end = begin + F.length(z["hits"])
        return F.struct(end.alias("at"), F.array(F.struct(begin.alias("start"), end.alias("end"), z["hits"].alias("hit"))).alias("out"))

    gaps = F.split(text, pattern, -1)
    pairs = F.filter(F.arrays_zip(gaps.alias("gaps"), hits.alias("hits")), lambda z: z["hits"].isNotNull())
    return F.when(F.size(hits) == 0, F.array().cast(_SPAN)).otherwise(_scan(pairs, _SPAN, put))


def _ended(kind: Kind, text: Column, spans: Column) -> Column:
    """Spans from where ``kind.whole`` begins to their right ends; those without one, and those that begin in the span before, are left out."""
    usual = F.create_map(*(F.lit(x) for c in _IBAN_LENGTHS for x in (c[:2], int(c[2:]))))
    length = lambda hit: F.length(F.regexp_replace(hit, " ", ""))

    def ends(s, cut):
        parts = F.split(F.regexp_extract(cut(s["start"], F.lit(WINDOW)), kind.whole, 0), " ")
        return F.struct(s["start"].alias("start"), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), " ")).alias("hits"))

    def right(s):
        return F.struct(s["start"].alias("start"), F.filter(s["hits"], lambda h: (length(h) >= 15) & _valid(kind, h)).alias("hits"))

    def best(s):
        known = F.filter(s["hits"], lambda h: F.coalesce(F.try_element_at(usual, F.substring(h, 1, 2)) == length(h), F.lit(False)))
        hit = F.coalesce(F.get(known, F.lit(0)), F.element_at(s["hits"], -1))
        return F.struct(s["start"].alias("start"), (s["start"] + F.length(hit)).alias("end"), hit.alias("hit"))

    def put(at, s, _):
        apart = s["start"] >= at
        return F.struct(F.when(apart, s["end"]).otherwise(at).alias("at"), F.when(apart, F.array(s)).otherwise(F.array().cast(_SPAN)).alias("out"))

    found = F.transform(F.filter(F.transform(_near(text, spans, 0, WINDOW, ends), right), lambda s: F.size(s["hits"]) > 0), best)
    return F.when(F.size(spans) == 0, F.array().cast(_SPAN)).otherwise(_scan(found, _SPAN, put))


def _judged(kind: Kind, rank: int, text: Column, spans: Column) -> Column:
    """Confirmed spans with scores; further kinds need the threshold."""

    def scored(s, cut):
        begin = F.greatest(s["start"] - BEFORE, F.lit(0))
        near = F.lower(F.concat(cut(begin, s["start"] - begin), F.lit(" "), cut(s["end"], F.lit(AFTER))))
        score = F.lit(kind.prior) + F.when(near.rlike(kind.context), 0.3).otherwise(0.0) - F.when(near.rlike(NEGATIVE), 0.3).otherwise(0.0)
        return F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"), F.lit(kind.name).alias("kind"), F.least(score, F.lit(1.0)).alias("score"))

    found = _near(text, spans if kind.whole else F.filter(spans, lambda s: _valid(kind, s["hit"])), BEFORE, AFTER, scored)
    if not kind.base:
        found = F.filter(found, lambda s: s["score"] >= THRESHOLD)
    return F.when(F.size(spans) == 0, F.array().cast(_FOUND)).otherwise(found)


def find_pii(df: DataFrame, kinds: Sequence[Kind] = KINDS, *, text_col: str = "text", out_col: str = "pii") -> DataFrame:
    """``df`` with ``out_col``: array<struct<start, rank, end, kind, score>> by start, then kind as listed."""
    own = fresh_name(df, "__pii")
    kept = [c for c in df.columns if c != out_col]
    text = F.col(f"{own}_text")
    df = df.withColumn(f"{own}_text", F.coalesce(F.col(text_col), F.lit("")))
    hits = {f"{own}_hits_{k.name}": F.regexp_extract_all(text, F.lit(k.pattern), F.lit(0)) for k in kinds}
    hits |= {f"{own}_hits_{k.name}": F.when(F.contains(text, F.lit(k.hint)), hits[f"{own}_hits_{k.name}"]).otherwise(F.array().cast("array<string>")) for k in kinds if k.hint}
    df = df.withColumns(hits)
    df = df.withColumns({f"{own}_spans_{k.name}": _spans(text, F.col(f"{own}_hits_{k.name}"), k.pattern) for k in kinds})
    df = df.withColumns({f"{own}_spans_{k.name}": _ended(k, text, F.col(f"{own}_spans_{k.name}")) for k in kinds if k.whole})
    df = df.withColumns({f"{own}_found_{k.name}": _judged(k, i, text, F.col(f"{own}_spans_{k.name}")) for i, k in enumerate(kinds)})
    found = F.array_sort(F.concat(*(F.col(f"{own}_found_{k.name}") for k in kinds)))
    return df.select(*(F.col(f"`{c}`") for c in kept), found.alias(out_col))


def joined(spans: Column) -> Column:
    """Spans as kind:start:end, comma-joined."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def redact(df: DataFrame, kinds: Sequence[Kind] = KINDS, *, text_col: str = "text") -> DataFrame:
    """``df`` with every span of its texts replaced by its kind in angle brackets; of overlapping spans the first names it."""
    spans = fresh_name(df, "__spans")
    found = find_pii(df, kinds, text_col=text_col, out_col=spans)
    text = F.col(text_col)

    def setup(at, part):
        end = F.array_max(F.transform(part, lambda s: s["end"]))
        return F.struct(at.alias("base"), F.substr(text, at.cast("int") + 1, F.greatest(end - at, F.lit(0)).cast("int")).alias("text"))

    def put(at, s, own):
        apart = s["start"] >= at
        kept = F.substr(own["text"], (at - own["base"]).cast("int") + 1, (s["start"] - at).cast("int"))
        mark = F.array(kept, F.concat(F.lit("<"), F.upper(s["kind"]), F.lit(">")))
        return F.struct(F.greatest(s["end"], at).alias("at"), F.when(apart, mark).otherwise(F.array().cast("array<string>")).alias("out"))

    pieces = _scan(F.col(spans), "array<string>", put, setup, lambda at: F.array(F.substr(text, at.cast("int") + 1)))
    return found.withColumn(text_col, F.when(text.isNull() | (F.size(spans) == 0), text).otherwise(F.array_join(pieces, ""))).drop(spans)
