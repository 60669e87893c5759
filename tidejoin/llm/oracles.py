"""DuckDB SQL for the operators that SQL can express over whole tables."""

from __future__ import annotations

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP5 = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, w, least(13, len(w)) AS n FROM (SELECT item_id, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL) WHERE len(w) > 0),
g AS (SELECT DISTINCT item_id, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS gram FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM b)),
lengths AS (SELECT DISTINCT n FROM g),
p AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lengths WHERE len(w) >= n),
m AS (SELECT doc_id, i, p.n AS n, item_id FROM (SELECT doc_id, i, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS gram FROM p) AS p JOIN g ON p.gram = g.gram AND p.n = g.n),
h AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM m) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h ON d.doc_id = h.doc_id LEFT JOIN t ON d.doc_id = t.doc_id
"""

_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_RULES = "(VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')) AS r(rh, rp, verdict)"
_HOST = f"coalesce(translate(regexp_extract(u, '(?s)^.*?://([^/?#]*)', 1), {_AZ}), '')"
_PATH = "coalesce(regexp_extract(u, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '')"
_NODE = f"CASE WHEN contains(u, '://') THEN {_HOST} || CASE {_PATH} WHEN '' THEN '/' ELSE {_PATH} END || regexp_extract(u, '(?s)^.*?://[^?#]*(\\?[^#]*)', 1) END"
_FITS = "(h = rh OR ends_with(h, '.' || rh)) AND starts_with(p, rp)"

#: Canonical links and refreshes to whole addresses, in double quotes, as a recursive walk from the blocked URLs.
OP13 = rf"""
WITH RECURSIVE l AS (SELECT url AS s, unnest(regexp_extract_all(html, '(?i)<link\s[^>]*>|<meta\s[^>]*>')) AS tag FROM pages WHERE regexp_matches(html, '(?i)canonical|refresh')),
t AS (SELECT s, CASE WHEN regexp_matches(tag, '(?i)^<link\s.*\srel="canonical"|^<link\srel="canonical"') THEN regexp_extract(tag, '(?i)\shref="([^"]*://[^"]*)"', 1)
  WHEN regexp_matches(tag, '(?i)^<meta\s.*http-equiv="refresh"') THEN regexp_extract(tag, '(?i)url=([^"]*://[^"]*)', 1) ELSE '' END AS t FROM l),
ends AS (SELECT (SELECT {_NODE} FROM (SELECT s AS u)) AS a, (SELECT {_NODE} FROM (SELECT t AS u)) AS b FROM t WHERE t <> ''),
edges AS (SELECT a, b FROM ends WHERE a IS NOT NULL AND b IS NOT NULL UNION SELECT b, a FROM ends WHERE a IS NOT NULL AND b IS NOT NULL),
pg AS (SELECT page_id, u, {_HOST} AS h, {_PATH} AS p, {_NODE} AS node FROM (SELECT page_id, url AS u FROM pages)),
nodes AS (SELECT node, {_HOST} AS h, {_PATH} AS p FROM (SELECT a AS node, 'x://' || a AS u FROM edges)),
ruled AS (SELECT node, verdict FROM (SELECT node, verdict, row_number() OVER (PARTITION BY node ORDER BY length(rh || rp) DESC, length(rh) DESC, verdict) AS k FROM nodes JOIN {_RULES} ON {_FITS}) WHERE k = 1),
seen AS (SELECT DISTINCT node FROM ruled WHERE verdict = 'block'
  UNION SELECT b FROM seen JOIN edges ON node = a),
best AS (SELECT h, p, rh || rp AS rule, verdict, row_number() OVER (PARTITION BY h, p ORDER BY length(rh || rp) DESC, length(rh) DESC, verdict) AS k FROM (SELECT DISTINCT h, p FROM pg) JOIN {_RULES} ON {_FITS})
SELECT page_id, pg.h AS host, pg.p AS path, best.rule AS rule, coalesce(best.verdict, CASE WHEN pg.node IN (SELECT node FROM seen) AND pg.node NOT IN (SELECT node FROM ruled WHERE verdict = 'allow') THEN 'block' END, 'allow') AS verdict
FROM pg LEFT JOIN best ON pg.h = best.h AND pg.p = best.p AND best.k = 1
"""

#: Every phrase of one to four words counted, then cuts and containment as joins.
OP11 = rf"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), {_AZ}), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^ \t]+') AS w FROM p),
g AS (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM w, (SELECT unnest([1, 2, 3, 4]) AS m) WHERE len(w) >= m),
f AS (SELECT lang, list_slice(w, i, i + m - 1) AS q, count(*) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE len(q) = 1 GROUP BY lang),
c AS (SELECT lang, q, f AS a FROM f WHERE f >= 30 AND len(q) > 1),
k AS (SELECT lang, q, a, unnest(range(1, len(q))) AS k FROM c),
s AS (SELECT k.lang, k.q, a, k, l.f AS l, r.f AS r, CAST(CAST(2000000 AS HUGEINT) * a // (l.f + r.f) AS BIGINT) AS score FROM k
  JOIN f AS l ON l.lang = k.lang AND l.q = list_slice(k.q, 1, k) JOIN f AS r ON r.lang = k.lang AND r.q = list_slice(k.q, k + 1, len(k.q))),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, q ORDER BY score, k) = 1),
u AS (SELECT lang, list_slice(q, i, i + m - 1) AS q, max(a) AS most FROM (SELECT lang, q, a, m, unnest(range(1, len(q) - m + 2)) AS i FROM c, (SELECT unnest([2, 3]) AS m) WHERE len(q) > m) GROUP BY ALL),
o AS (SELECT b.lang, array_to_string(b.q, ' ') AS phrase, a, l, r, score FROM b LEFT JOIN u ON u.lang = b.lang AND u.q = b.q WHERE most IS NULL OR 100 * CAST(most AS HUGEINT) < 80 * CAST(a AS HUGEINT)),
z AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM o QUALIFY rank <= 2000)
SELECT z.lang, rank, phrase, a, l, r, n, score FROM z JOIN n ON n.lang = z.lang
"""

ORACLES = {"op5_decontamination": OP5, "op11_collocations": OP11, "op13_url_rules": OP13}
