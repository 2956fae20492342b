"""DuckDB twins of the queries that SQL can express (brute force, on the same tables)."""

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FOLDED = f"translate(text, '{UPPER}', '{LOWER}')"
SPACE_WORD = r"[^\x20\x09-\x0D]+"
ALNUM_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

OP1 = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all({FOLDED}, '{SPACE_WORD}') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 1), lambda i : array_to_string(ws[i:i + 2], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM i JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 85 * (p.n + q.n - c)),
r AS (SELECT doc_id, doc_id AS to_id FROM documents UNION SELECT r.doc_id, l.y FROM r JOIN l ON r.to_id = l.x)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.c AS component_id, d.doc_id = m.c AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(to_id) AS c FROM r GROUP BY doc_id) m USING (doc_id)
"""

OP6 = f"""
WITH w AS (
  SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{SPACE_WORD}') AS ws FROM documents),
g AS (
  SELECT doc_id, i, array_to_string(ws[i:i + 7], ' ') AS g
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) >= 8)),
t AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g) WHERE c > 1),
p AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM t, (SELECT unnest(range(0, 8)) AS j) GROUP BY doc_id),
li AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM w),
dl AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM li WHERE regexp_matches(line, '{SPACE_WORD}') GROUP BY doc_id),
b AS (
  SELECT w.doc_id, source, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
    (length(text) - length(translate(text, '#*$%&|<>', '')))::BIGINT AS n_symbols,
    coalesce(dl.n, 0)::BIGINT AS n_dup_lines, coalesce(p.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN dl USING (doc_id) LEFT JOIN p USING (doc_id)),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM b),
h AS (SELECT source, count(*) AS host_docs, count(*) FILTER (base_failed) AS host_failed FROM f WHERE source IS NOT NULL GROUP BY source),
m AS (SELECT avg(host_failed / host_docs) AS m, var_pop(host_failed / host_docs) AS v FROM h),
k AS (SELECT m, CASE WHEN v > 0 THEN greatest(2.0, least(1000.0, m * (1 - m) / v - 1)) ELSE 1000.0 END AS strength FROM m),
r AS (SELECT source, host_docs, m, strength, (host_failed + m * strength) / (host_docs + strength) AS host_rate FROM h, k),
v AS (
  SELECT source, host_rate, host_rate <= 0.5
    AND host_rate - 1.645 * sqrt(host_rate * (1 - host_rate) / (host_docs + strength + 1)) <= m + 0.1 AS host_kept FROM r)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND coalesce(host_kept, true) AS kept, round(host_rate, 6) AS host_rate
FROM f LEFT JOIN v USING (source)
"""

OP7 = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({FOLDED}, '{ALNUM_WORD}') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all({FOLDED}, '{ALNUM_WORD}') AS ws FROM benchmark),
win AS (
  SELECT DISTINCT item_id, n, array_to_string(ws[i:i + n - 1], ' ') AS g
  FROM (SELECT item_id, ws, least(10, len(ws)) AS n, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) AS i FROM b WHERE len(ws) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
dw AS (
  SELECT doc_id, n, i, array_to_string(ws[i:i + n - 1], ' ') AS g
  FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, sizes WHERE len(ws) >= n)),
o AS (SELECT doc_id, dw.n, i, item_id FROM dw JOIN win ON dw.n = win.n AND dw.g = win.g),
h AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM o) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n, array_to_string(list_sort(list(item_id)), ',') AS ids
      FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM o) GROUP BY doc_id)
SELECT doc_id, coalesce(len(ws), 0)::BIGINT AS n_words, coalesce(h.n, 0)::BIGINT AS n_hit, coalesce(t.n, 0)::BIGINT AS n_items,
  sha256(coalesce(t.ids, '')) AS items_sha256, coalesce(h.n, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""

_TURNS = "list({'role': coalesce(role, ''), 'text': coalesce(text, '')} ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, ''))"
_RENDER = "list_transform({0}, lambda x : '<|' || x.role || '|>' || chr(10) || x.text || '<|end|>' || chr(10))"


def _mask(tail: str) -> str:
    shown = _RENDER.format(tail)
    before = f"(length(prompt) + length(array_to_string(({shown})[1:i - 1], '')))"
    return (f"array_to_string(list_transform(list_filter(range(1, len({tail}) + 1), lambda i : {tail}[i].role = 'assistant'), lambda i : "
            f"({before} + length({tail}[i].role) + 5)::VARCHAR || ':' || ({before} + length(({shown})[i]) - 1)::VARCHAR), ',')")


OP2 = f"""
WITH t AS (SELECT conv_id, {_TURNS} AS t FROM conversations GROUP BY conv_id),
a AS (SELECT *, list_filter(range(1, len(t) + 1), lambda i : t[i].role = 'assistant') AS a FROM t),
p AS (
  SELECT conv_id, CASE WHEN len(a) = 0 THEN t ELSE t[1:a[-1]] END AS c,
    CASE WHEN len(a) = 0 THEN t WHEN len(a) = 1 THEN t[1:a[1] - 1] ELSE list_concat(t[1:a[-1] - 1], [t[a[1]]]) END AS r FROM a),
k AS (
  SELECT *, coalesce(list_min(list_filter(range(1, least(len(c), len(r)) + 1), lambda i : c[i] <> r[i])) - 1, least(len(c), len(r))) AS n FROM p),
s AS (
  SELECT conv_id, n, CASE WHEN n = len(c) AND n = len(r) THEN 'identical' WHEN n = len(c) OR n = len(r) THEN 'prefix' ELSE 'pair' END AS status,
    array_to_string({_RENDER.format('c[1:n]')}, '') AS prompt, c[n + 1:] AS c, r[n + 1:] AS r FROM k)
SELECT conv_id, status, n::BIGINT AS n_prompt_turns, length(prompt)::BIGINT AS prompt_chars, sha256(prompt) AS prompt_sha256,
  sha256(array_to_string({_RENDER.format('c')}, '')) AS chosen_sha256, sha256(array_to_string({_RENDER.format('r')}, '')) AS rejected_sha256,
  {_mask('c')} AS chosen_mask, {_mask('r')} AS rejected_mask
FROM s
"""

OP12 = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || doc_id::VARCHAR) AS x,
    regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS t FROM documents),
h AS (
  SELECT *, len(t)::BIGINT AS n, ('0x' || x[1:8])::BIGINT AS h1, ('0x' || x[9:16])::BIGINT AS h2,
    ('0x' || x[17:24])::BIGINT AS h3, ('0x' || x[25:32])::BIGINT AS h4 FROM d),
k AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain'
      WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (
  SELECT doc_id, n, form, text, array_to_string(t[1:a], '') AS p, array_to_string(t[a + 1:b], '') AS m,
    array_to_string(t[b + 1:], '') AS s FROM k)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p)::BIGINT END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(m)::BIGINT END AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
    WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE text END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM p
"""
