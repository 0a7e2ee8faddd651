"""Preferences of texts as a query, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidepool.functions import preferences as P
from tidepool.plans.tables import table

#: What a shopper might say, put before the documents' texts so that every rule has cases.
SAID = (
    "I loved the old ones and I like stealth, but I hated the long grind, and bugs. Too long!",
    "I want co-op, cozy farms; must have fishing. I don't like pvp.",
    "Need single player, not multiplayer. Too too grindy",
    "looking for: - long campaigns -",
    "More of the same, but less of the endless grind. I enjoy versus modes",
    "I dislike menus, ads, and menus. Avoid ads",
    "",
)


def _raw():
    said = F.element_at(F.array(*(F.lit(s) for s in SAID)), F.pmod("doc_id", F.lit(len(SAID))).cast("int") + 1)
    return F.concat_ws(" ", said, "text")


def preferences(spark, d):
    docs = table(spark, d, "documents").select("doc_id", _raw().alias("raw"))
    p = F.col("preferences")
    return P.with_preferences(docs, "raw").select("doc_id", *(F.array_join(p[f], "|").alias(f) for f in P.FIELDS), p["confidence"].alias("confidence"), P.embedding_text(p).alias("embedding_text"))


# -- the same in SQL ------------------------------------------------------------------


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _has(x: str, terms) -> str:
    return "(" + " OR ".join(f"contains({x}, {_quoted(t)})" for t in terms) + ")"


def _off(x: str, chars: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^[{chars}]+', ''), '[{chars}]+$', '')"


def _rests(x: str, cue: str, size: str = "") -> str:
    """What follows each match of a cue."""
    cut, hit = f"string_split_regex({x}, {_quoted(cue)})", f"regexp_extract_all({x}, {_quoted(cue)})"
    at = f"(len(array_to_string({cut}[1:k], '')) + len(array_to_string({hit}[1:k], '')) + 1)"
    return f"list_transform(range(1, len({hit}) + 1), lambda k: substr({x}, {at}{size}))"


def _behind(x: str, cue: str) -> str:
    w = _off("w", " :,.\\-")
    return f"list_filter(list_transform({_rests(x, f'\\b{cue}\\b', f', {P.WINDOW}')}, lambda w: trim(regexp_extract({w}, '^[^,;.!?\\n]*'))), lambda q: q <> '')"


def _joined(lists) -> str:
    return "flatten([" + ", ".join(lists) + "])"


def _polarity(x: str) -> str:
    return f"CASE WHEN {_has(x, P.NEGATIVE)} OR ({_has(x, P.POSITIVE)} AND {_has(x, P.NEGATIONS)}) THEN 'negative' WHEN {_has(x, P.POSITIVE)} THEN 'positive' ELSE 'neutral' END"


def _disliked(x: str) -> str:
    rest = "regexp_extract(r, '^[^.!?\\n]*')"
    parts = f"flatten(list_transform({_rests(x, P.DISLIKE_CUE)}, lambda r: string_split({_off(rest, ' ,.')}, ',')))"
    return f"list_filter(list_transform({parts}, lambda p: {_off('p', ' ,.')}), lambda p: len(p) > 1)"


def _signals(field: str) -> str:
    out = []
    for group in P.SIGNALS:
        rows = [f"CASE WHEN {_has('s', terms)} AND {_polarity('s')} = '{side}' THEN {_quoted(phrase)} END" for terms, side, name, phrase in group if name == field]
        if rows:
            out.append(f"flatten(list_transform(sentences, lambda s: list_filter([{', '.join(rows)}], lambda z: z IS NOT NULL)))")
    return _joined(out)


def _distinct(x: str) -> str:
    return f"list_reduce(list_prepend([]::VARCHAR[], list_transform({x}, lambda z: [z])), lambda have, z: CASE WHEN list_contains(have, z[1]) THEN have ELSE list_concat(have, z) END)"


_CUT = r"string_split_regex(raw_text, ',\s*but\s+')"
_REST = r"substr(raw_text, len(regexp_extract(raw_text, '^(.*?),\s*but\s+')) + 1)"
_TWO = f"list_filter([{_off(f'{_CUT}[1]', ' ,.')}, {_off(_REST, ' ,.')}], lambda p: p <> '')"
_KNOWN = "len(list_filter(have, lambda a: contains(a, d[1]) OR contains(d[1], a) OR (len(list_filter(string_split(d[1], ' '), lambda w: len(w) > 2)) > 0 AND len(list_filter(list_filter(string_split(d[1], ' '), lambda w: len(w) > 2), lambda w: NOT contains(a, w))) = 0))) > 0"
_TOLD = f"list_reduce(list_prepend(warned, list_transform(dislikes, lambda d: [d])), lambda have, d: CASE WHEN {_KNOWN} THEN have ELSE list_concat(have, d) END)"
_LINE = lambda label, f: f"'{label}: ' || CASE WHEN len({f}) > 0 THEN array_to_string({f}, ', ') ELSE 'none' END || '.'"
_STYLES = "[" + ", ".join(map(_quoted, P.STYLES)) + "]"

SAID_SQL = "[" + ", ".join(map(_quoted, SAID)) + "]"
SQL_TEXT = f"""WITH t0 AS (SELECT doc_id, {SAID_SQL}[(doc_id % {len(SAID)}) + 1] || coalesce(' ' || text, '') AS raw FROM documents),
t1 AS (SELECT doc_id, raw, trim(regexp_replace(lower(regexp_replace(raw, '^\\s+|\\s+$', '', 'g')), '\\s+', ' ', 'g')) AS raw_text FROM t0),
t2 AS (SELECT *, CASE WHEN len({_CUT}) = 1 OR len({_TWO}) = 0 THEN [raw_text] ELSE {_TWO} END AS clauses FROM t1),
t3 AS (SELECT *, len(clauses) >= 2 AS two, flatten(list_transform(clauses, lambda p: list_filter(list_transform(string_split_regex(p, '[.!?\\n]+'), lambda s: trim(s)), lambda s: s <> ''))) AS sentences FROM t2),
t4 AS (SELECT *, CASE WHEN two THEN list_filter(clauses, lambda c: {_polarity('c')} <> 'negative') ELSE [raw_text] END AS good, CASE WHEN two THEN list_filter(clauses, lambda c: {_polarity('c')} <> 'positive') ELSE [raw_text] END AS bad FROM t3),
t5 AS (SELECT *, {_distinct('list_concat(flatten(list_transform(good, lambda c: ' + _joined(_behind('c', q) for q in P.LIKE_CUES) + ')), ' + _signals('likes') + ')')} AS likes,
  {_distinct('list_concat(flatten(list_transform(bad, lambda c: ' + _disliked('c') + ')), flatten(list_transform(bad, lambda c: ' + _joined(_behind('c', q) for q in P.DISLIKE_CUES) + ')))')} AS dislikes,
  {_distinct(_joined(_behind('raw_text', q) for q in P.MUST_CUES))} AS must_have, list_filter({_STYLES}, lambda s: contains(raw_text, s)) AS style_tone,
  {_distinct(_signals('constraints'))} AS constraints, {_distinct(_signals('avoid'))} AS warned FROM t4),
t6 AS (SELECT *, {_distinct(_TOLD)} AS avoid FROM t5),
t7 AS (SELECT *, CASE WHEN len(likes) + len(dislikes) + len(must_have) + len(avoid) + len(style_tone) + len(constraints) >= 2 AND len(raw_text) >= 20 THEN 'normal' ELSE 'low' END AS confidence,
  rtrim(substr(CASE WHEN len(dislikes) > 0 AND two THEN clauses[len(clauses)] ELSE raw_text END, 1, {P.CONTEXT})) AS told FROM t6)
SELECT doc_id, array_to_string(likes, '|') AS likes, array_to_string(dislikes, '|') AS dislikes, array_to_string(must_have, '|') AS must_have, array_to_string(avoid, '|') AS avoid, array_to_string(style_tone, '|') AS style_tone, array_to_string(constraints, '|') AS constraints, confidence,
  {_LINE('WANTS', 'likes')} || ' ' || {_LINE('AVOIDS', 'avoid')} || ' ' || {_LINE('MUST_HAVE', 'must_have')} || ' ' || {_LINE('DISLIKES', 'dislikes')} || ' ' || {_LINE('STYLE_TONE', 'style_tone')} || ' ' || {_LINE('CONSTRAINTS', 'constraints')} || ' CONFIDENCE: ' || confidence || '.' || CASE WHEN told <> '' THEN ' OPTIONAL_CONTEXT: ' || told || '.' ELSE '' END AS embedding_text FROM t7"""

Q, SQL = {"preferences": preferences}, {"preferences": SQL_TEXT}
