"""DuckDB SQL for the queries that SQL can express on whole tables."""

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

QUALITY = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {_WORDS} AS w FROM documents),
base AS (
  SELECT doc_id, len(w) AS n_words,
    coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
    len(list_filter(w, lambda x: regexp_matches(x, '[A-Za-z]|[^\x00-\x7F]'))) AS n_letter_words
  FROM d),
ls AS (
  SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
pos AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS i FROM d),
win AS (
  SELECT doc_id, i, word = lag(word) OVER (PARTITION BY doc_id ORDER BY i) AS stutter,
    CASE WHEN count(*) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) = 8
      THEN string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) END AS eight
  FROM pos),
marked AS (SELECT doc_id, i, stutter, (eight IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, eight) > 1)::INT AS twice FROM win),
covered AS (SELECT doc_id, stutter, max(twice) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS hit FROM marked),
rep AS (SELECT doc_id, sum(hit) AS n_repeat_words, count(*) FILTER (stutter) AS n_stutters FROM covered GROUP BY doc_id),
m AS (
  SELECT base.*, coalesce(n_lines, 0) AS n_lines, coalesce(n_dup_lines, 0) AS n_dup_lines,
    coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_stutters, 0) AS n_stutters
  FROM base LEFT JOIN ls USING (doc_id) LEFT JOIN rep USING (doc_id))
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
  n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
  (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words OR 100 * n_symbols > 5 * word_chars
    OR 100 * n_dup_lines > 50 * n_lines OR 100 * word_chars < 300 * n_words OR 100 * word_chars > 1000 * n_words
    OR 100 * n_letter_words < 80 * n_words OR 100 * n_stutters > 20 * n_words) AS kept
FROM m
"""

JACCARD = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
    WHEN len(w) > 0 THEN ['short ' || len(w) || ' ' || array_to_string(w, ' ')] ELSE [] END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 80 * (a.n + b.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id AS x, doc_id AS y FROM n UNION SELECT r.x, e.y FROM r JOIN e ON e.x = r.y)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(m.component, d.doc_id)::BIGINT AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT x AS doc_id, min(y) AS component FROM r GROUP BY x) m USING (doc_id)
"""

#: The same components at 0.85, and which document stays.
MINHASH = f"SELECT *, doc_id = component_id AS kept FROM ({JACCARD.replace('>= 80 *', '>= 85 *')})"


def _vector_codes() -> str:
    """Two rounds, then the final assignment; a part is a row (r, p, v), a codebook entry (p, e, v)."""
    near = lambda books: f"SELECT r, p, min([d, e]) AS best FROM (SELECT r, p, e, list_sum(list_transform(list_zip(part.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM part JOIN {books} b USING (p)) GROUP BY r, p"
    rounds = "".join(
        f"""
near{k} AS MATERIALIZED (SELECT r, p, best[2] AS e FROM ({near(f"book{k}")})),
mean{k} AS (SELECT p, e, list(floor(s / n)::BIGINT ORDER BY i) AS v FROM (
  SELECT p, e, i, sum(v[i])::BIGINT AS s, count(*) AS n FROM near{k} JOIN part USING (r, p), range(1, len(v) + 1) t(i) GROUP BY p, e, i) GROUP BY p, e),
book{k + 1} AS MATERIALIZED (SELECT p, e, coalesce(m.v, b.v) AS v FROM book{k} b LEFT JOIN mean{k} m USING (p, e)),"""
        for k in range(2)
    )
    return f"""
WITH kept AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q, row_number() OVER (ORDER BY vec_id) AS r FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
part AS MATERIALIZED (SELECT r, p, q[p * (len(q) // 16) + 1 : (p + 1) * (len(q) // 16)] AS v FROM kept, range(16) t(p)),
book0 AS MATERIALIZED (SELECT p, r - 1 AS e, v FROM part WHERE r <= 64),{rounds}
final AS MATERIALIZED ({near("book2")}),
code AS (SELECT r, string_agg(lower(printf('%02x', best[2])), '' ORDER BY p) AS code, sum(best[1])::BIGINT AS error FROM final GROUP BY r),
digest AS (SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY p, e, i)) AS sha FROM (SELECT p, e, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM book2))
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, sha AS codebooks_sha256
FROM kept JOIN code USING (r), digest
"""


VECTOR_CODES = _vector_codes()


def _repair() -> str:
    """The cheapest edits by going forward over rows: for each last role (nothing, s, u, a) the least ten-digit cost followed by its audit."""
    far = "'5000000000'"
    add = lambda x, cost, edit: f"(lpad((left({x}, 10)::BIGINT + {cost})::VARCHAR, 10, '0') || substr({x}, 11) || '{edit}')"
    closed = f"""SELECT *, least(u1, {add('a1', 2, 'I')}) AS u2, least(a1, {add('u1', 2, 'I')}) AS a2 FROM (
    SELECT *, least(u, {add('n', 2, 'I')}, {add('s', 2, 'I')}, {add('a', 2, 'I')}) AS u1, least(a, {add('u', 2, 'I')}) AS a1 FROM walk)"""
    stays = lambda role, froms: f"CASE WHEN sound AND init = '{role}' THEN least({', '.join(add(x, 'cut', 'K') for x in froms)}) ELSE {far} END" if len(froms) > 1 else f"CASE WHEN sound AND init = '{role}' THEN {add(froms[0], 'cut', 'K')} ELSE {far} END"
    turned = lambda froms: f"CASE WHEN sound THEN {'least(' + ', '.join(add(x, '(2 + cut)', 'R') for x in froms) + ')' if len(froms) > 1 else add(froms[0], '(2 + cut)', 'R')} ELSE {far} END"
    return f"""
WITH RECURSIVE tab AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, x: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS v FROM range(256) r(i))),
d AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda c: ascii(c)::BIGINT)),
    lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) % 20 AS k FROM conversations, tab),
r0 AS (SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role, CASE WHEN k = 1 THEN '' WHEN k = 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(CASE WHEN k = 3 THEN [0, 1] ELSE [0] END) AS copy FROM d WHERE k <> 0),
r1 AS (SELECT *, left(role, 1) AS init, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS said, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM r0),
r2 AS (SELECT *, said = '' AS blank, said <> '' AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS dup, lag(init) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM r1),
r AS MATERIALIZED (SELECT *, NOT (blank OR dup) AS sound, (NOT (blank OR dup) AND right(said, 1) NOT IN ('.', '!', '?'))::BIGINT AS cut FROM r2),
walk AS (
  SELECT DISTINCT conv_id, 0::BIGINT AS i, '0000000000' AS n, {far} AS s, {far} AS u, {far} AS a FROM r
  UNION ALL
  SELECT w.conv_id, r.i, {add('n', 3, 'D')}, least({add('s', 3, 'D')}, {stays('s', ['n'])}),
    least({add('u2', 3, 'D')}, {turned(['n', 's', 'a2'])}, {stays('u', ['n', 's', 'a2'])}), least({add('a2', 3, 'D')}, {turned(['u2'])}, {stays('a', ['u2'])})
  FROM ({closed}) w JOIN r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.i = w.i + 1),
found AS MATERIALIZED (SELECT conv_id, left(best, 10)::BIGINT AS cost, substr(best, 11) AS audit FROM (SELECT conv_id, least(n, a2) AS best FROM ({closed}) QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) = 1)),
edits AS (SELECT conv_id, j, edit, sum((edit <> 'I')::INT) OVER (PARTITION BY conv_id ORDER BY j) AS i FROM (SELECT conv_id, unnest(string_split(audit, '')) AS edit, unnest(range(length(audit))) AS j FROM found WHERE audit <> '')),
out AS (SELECT e.conv_id, j, edit, role, text, init, row_number() OVER (PARTITION BY e.conv_id ORDER BY j) AS m FROM edits e LEFT JOIN r ON r.conv_id IS NOT DISTINCT FROM e.conv_id AND r.i = e.i WHERE edit <> 'D'),
led AS (SELECT *, max((m = 1 AND edit = 'K' AND init = 's')::INT) OVER (PARTITION BY conv_id) AS led FROM out),
lines AS (SELECT conv_id, sha256(string_agg(CASE WHEN edit = 'K' THEN role ELSE CASE WHEN (m - led) % 2 = 1 THEN 'user' ELSE 'assistant' END END || ':' || CASE WHEN edit = 'I' THEN '' ELSE text END, chr(10) ORDER BY j)) AS sha FROM led GROUP BY conv_id),
counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (dup) AS duplicate, sum(cut) AS truncated,
  count(*) FILTER (before IS NOT NULL AND before || init NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY conv_id)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
  coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit, coalesce(sha, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN counts n ON n.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN found f ON f.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN lines l ON l.conv_id IS NOT DISTINCT FROM c.conv_id
"""


REPAIR = _repair()
