"""The subpackage's queries in SQL, for those that SQL can express on whole tables."""

from __future__ import annotations

_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

OP1 = f"""
WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), {_AZ}) AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r(rhost, rpath, verdict) AS (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
m AS (SELECT page_id, rhost || rpath AS rule, verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(rhost || rpath) DESC, length(rhost) DESC) AS nth
  FROM p JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT p.page_id, p.host, p.path, m.rule, coalesce(m.verdict, 'allow') AS verdict FROM p LEFT JOIN m ON p.page_id = m.page_id AND m.nth = 1
"""

_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP4 = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
b AS (SELECT item_id::VARCHAR AS item, ws, least(10, len(ws)) AS size FROM (SELECT item_id, {_WORDS} AS ws FROM benchmark) WHERE len(ws) > 0),
g AS (SELECT DISTINCT item, size, array_to_string(ws[i:i + size - 1], ' ') AS gram FROM (SELECT *, unnest(range(1, len(ws) - size + 2)) AS i FROM b)),
s AS (SELECT DISTINCT size FROM b),
x AS (SELECT doc_id, size, i, array_to_string(ws[i:i + size - 1], ' ') AS gram FROM (SELECT doc_id, ws, size, unnest(range(1, len(ws) - size + 2)) AS i FROM d, s)),
h AS (SELECT doc_id, item, x.size, i FROM x JOIN g ON x.size = g.size AND x.gram = g.gram),
c AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS place FROM h) GROUP BY doc_id),
i AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN i USING (doc_id)
"""

OP7 = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS hx FROM documents),
g AS (SELECT doc_id, place, substr(hx, 2 * place + 1, 100) AS gram FROM (SELECT doc_id, hx, unnest(range(0, length(hx) // 2 - 49)) AS place FROM d)),
q AS (SELECT doc_id, place FROM (SELECT doc_id, place, min(doc_id) OVER (PARTITION BY gram) AS least FROM g) WHERE least < doc_id),
n AS (SELECT doc_id, place, coalesce(place - lag(place) OVER (PARTITION BY doc_id ORDER BY place) > 50, true) AS fresh FROM q),
r AS (SELECT doc_id, place, sum(fresh::INTEGER) OVER (PARTITION BY doc_id ORDER BY place) AS run FROM n),
s AS (SELECT doc_id, min(place) AS a, max(place) + 50 AS b FROM r GROUP BY doc_id, run),
k AS (SELECT s.doc_id, coalesce(lag(b) OVER w, 0) AS x, a AS y FROM s WINDOW w AS (PARTITION BY s.doc_id ORDER BY a)
  UNION ALL SELECT d.doc_id, coalesce(max(b), 0), any_value(length(hx) // 2) FROM d LEFT JOIN s USING (doc_id) GROUP BY d.doc_id),
t AS (SELECT d.doc_id, string_agg(substr(hx, 2 * x + 1, 2 * (y - x)), '' ORDER BY x) AS kept FROM d JOIN k USING (doc_id) GROUP BY d.doc_id),
z AS (SELECT doc_id, count(*) AS n_spans, sum(b - a)::BIGINT AS n_removed FROM s GROUP BY doc_id)
SELECT d.doc_id, (length(hx) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(kept)) AS kept_sha256
FROM d JOIN t USING (doc_id) LEFT JOIN z USING (doc_id)
"""

OP9 = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (SELECT doc_id, i, array_to_string(ws[i:i + 7], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM d)),
u AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM w) WHERE n > 1),
r AS (SELECT doc_id, count(DISTINCT place) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS place FROM u) GROUP BY doc_id),
l AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
e AS (SELECT doc_id, count(*) AS n FROM (SELECT doc_id, ws, unnest(range(1, len(ws))) AS i FROM d) WHERE ws[i] = ws[i + 1] GROUP BY doc_id),
s AS (SELECT d.doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
  coalesce(n_dup, 0) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines, coalesce(e.n, 0) AS n_stutter,
  length(regexp_replace(t, '[^0-9]+', '', 'g')) AS n_digits, length(regexp_replace(t, '[^\p{Lu}]+', '', 'g')) AS n_upper
  FROM d LEFT JOIN r USING (doc_id) LEFT JOIN l USING (doc_id) LEFT JOIN e USING (doc_id)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, word_chars / greatest(n_words, 1) AS mean FROM s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR n_symbols > n_words * 0.25 OR n_dup_lines > n_lines * 0.4 OR mean < 1.5 OR mean > 25 OR n_digits > word_chars * 0.4 OR n_upper > word_chars * 0.6 OR n_stutter > n_words * 0.3) AS kept
FROM b
"""

ORACLES = {"op1_url_filters": OP1, "op4_decontaminate": OP4, "op7_suffix_dedup": OP7, "op9_quality_rules": OP9}
