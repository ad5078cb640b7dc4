"""DuckDB SQL for the rows of the corpus queries."""

OP8 = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS t, row_number() OVER () AS r FROM documents
), w AS (
  SELECT *, list_filter(string_split(translate(t, chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '     '), ' '), lambda x: x <> '') AS ws,
    list_filter(string_split(t, chr(10)), lambda x: length(translate(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')) > 0) AS ls
  FROM d
), g AS (
  SELECT r, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS gram
  FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)
), twice AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, gram) AS n FROM g) WHERE n >= 2
), covered AS (
  SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY r
), f AS (
  SELECT w.r, doc_id, source, CAST(len(ws) AS BIGINT) AS n_words,
    CAST(length(translate(t, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
    CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, len(ls) AS n_lines,
    CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN covered ON w.r = covered.r
), b AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f
), h AS (
  SELECT rule, source, count(*) AS docs, sum(CAST(failed AS INTEGER)) AS failed
  FROM (SELECT source, unnest([{'rule': 'few', 'failed': n_words < 50}, {'rule': 'runs', 'failed': 100 * n_repeat_words > 50 * n_words},
    {'rule': 'symbols', 'failed': 10 * n_symbols > word_chars}, {'rule': 'lines', 'failed': 10 * n_dup_lines > 3 * n_lines}], recursive := true) FROM b)
  WHERE source IS NOT NULL GROUP BY rule, source
), p AS (
  SELECT rule, avg(failed / docs) AS m, var_pop(failed / docs) - avg(failed / docs) * (1 - avg(failed / docs)) * avg(1 / docs) AS v FROM h GROUP BY rule
), k AS (
  SELECT rule, m, CASE WHEN v <= m * (1 - m) / 1e6 THEN 1e6 ELSE greatest(1.0, m * (1 - m) / v - 1) END AS k FROM p
), bad AS (
  SELECT source FROM h JOIN k USING (rule) WHERE (failed + m * k) / (docs + k) > greatest(0.5, m + 2 * sqrt(m * (1 - m) / (k + 1)))
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND (source IS NULL OR source NOT IN (SELECT source FROM bad)) AS kept
FROM b
"""

OP4 = r"""
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages
), d AS (
  SELECT *, min(page_id) OVER (PARTITION BY h) AS first_id,
    array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      CAST((CAST('0x' || substr(h, CAST(5 * (i // 4) + 1 AS INT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS INT)) & 31 AS INT) + 1, 1)), '') AS payload_digest
  FROM p
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
  CASE WHEN page_id IS DISTINCT FROM first_id AND first_id IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to
FROM d
"""

_GAPS = "chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_LOW = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = f"list_filter(string_split(translate({_LOW}, {_GAPS}, '     '), ' '), lambda x: x <> '')"

#: The similarity of two documents is exact here; the operator estimates it.
OP10 = f"""
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS raw, {_WORDS.format("coalesce(text, '')")} AS ws FROM documents),
l AS (
  SELECT doc_id, pos, list_transform({_WORDS.format("raw[pos]")}, lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN chr(1) ELSE x END) AS w
  FROM (SELECT doc_id, raw, unnest(range(1, len(raw) + 1)) AS pos FROM d)
), k AS (SELECT doc_id, pos, w, len(w) AS n, hash(len(w), w[1:3]) AS leaf FROM l WHERE len(w) > 0),
known AS (SELECT leaf FROM k GROUP BY leaf HAVING count(DISTINCT doc_id) > 1),
seen AS (SELECT * FROM k SEMI JOIN known USING (leaf)),
token AS (SELECT DISTINCT doc_id, leaf, j, w[j] AS t FROM (SELECT doc_id, leaf, w, unnest(range(1, n + 1)) AS j FROM seen)),
constant AS (SELECT leaf, j, t FROM token WHERE t <> chr(1) GROUP BY leaf, j, t HAVING count(DISTINCT doc_id) > 1),
line AS (SELECT DISTINCT leaf, n, w FROM seen),
kind AS (
  SELECT leaf, n, w, list({{'j': j, 't': t}} ORDER BY j) AS template
  FROM (SELECT leaf, n, w, unnest(range(1, n + 1)) AS j FROM line) x JOIN constant c USING (leaf, j) WHERE x.w[j] = c.t
  GROUP BY leaf, n, w HAVING count(*) >= 0.6 * n
), found AS (SELECT doc_id, pos, seen.leaf, template FROM seen JOIN kind ON seen.leaf = kind.leaf AND seen.w = kind.w),
first AS (SELECT leaf, template, min(doc_id) AS r FROM found GROUP BY leaf, template),
pair AS (SELECT DISTINCT f.leaf, f.template, doc_id, r FROM found f JOIN first USING (leaf, template) WHERE doc_id <> r),
grams AS (
  SELECT doc_id, CASE WHEN len(ws) < 5 THEN [list_aggregate(ws, 'string_agg', ' ')] ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS g
  FROM d WHERE doc_id IN (SELECT doc_id FROM pair UNION SELECT r FROM pair)
), unlike AS (
  SELECT doc_id, r FROM (SELECT DISTINCT p.doc_id, p.r, len(list_intersect(a.g, b.g)) AS shared, len(a.g) AS na, len(b.g) AS nb
    FROM pair p JOIN grams a ON a.doc_id = p.doc_id JOIN grams b ON b.doc_id = p.r) WHERE shared < 0.3 * (na + nb - shared)
), gone AS (SELECT DISTINCT leaf, template FROM pair JOIN unlike USING (doc_id, r)),
cut AS (SELECT doc_id, list(DISTINCT pos) AS cuts FROM found JOIN gone USING (leaf, template) GROUP BY doc_id)
SELECT doc_id, CAST(coalesce(len(raw), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(cuts), 0) AS BIGINT) AS n_dropped,
  sha256(CASE WHEN cuts IS NULL THEN text ELSE coalesce(array_to_string(list_filter(raw, lambda x, i: NOT list_contains(cuts, i)), chr(10)), '') END) AS text_sha256
FROM d LEFT JOIN cut USING (doc_id)
"""

OP7 = f"""
WITH l AS (
  SELECT doc_id, line, pos, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begin_at
  FROM (SELECT doc_id, unnest(raw) AS line, unnest(range(1, len(raw) + 1)) AS pos FROM (SELECT doc_id, string_split(text, chr(10)) AS raw FROM documents WHERE text IS NOT NULL))
), u AS (
  SELECT doc_id, pos, begin_at + length(line) - length(ltrim(line, ' ' || {_GAPS})) AS "start", begin_at + length(line) AS "end",
    list_aggregate(list_filter(string_split(translate(lower(line), {_GAPS}, '     '), ' '), lambda x: x <> ''), 'string_agg', ' ') AS unit
  FROM l WHERE length(ltrim(line, ' ' || {_GAPS})) > 0
), r AS (
  SELECT *, min(doc_id) OVER (PARTITION BY unit) AS kept, row_number() OVER (PARTITION BY unit, doc_id ORDER BY pos) AS nth FROM u
)
SELECT doc_id, CAST("start" AS BIGINT) AS "start", CAST("end" AS BIGINT) AS "end", kept AS kept_doc_id FROM r WHERE doc_id > kept OR nth > 1
"""

#: All runs of 51 words, compared as texts; runs that overlap or touch are one span.
OP7_PASSAGES = f"""
WITH p AS (
  SELECT doc_id, piece, pos, coalesce(sum(length(piece) + 1) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begin_at
  FROM (SELECT doc_id, unnest(raw) AS piece, unnest(range(1, len(raw) + 1)) AS pos FROM (SELECT doc_id, string_split(translate(text, {_GAPS}, '     '), ' ') AS raw FROM documents WHERE text IS NOT NULL))
), w AS (SELECT doc_id, lower(piece) AS word, begin_at, begin_at + length(piece) AS end_at, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS k FROM p WHERE piece <> ''),
r AS (
  SELECT doc_id, k, begin_at, lead(end_at, 50) OVER d AS end_at, md5(string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN CURRENT ROW AND 50 FOLLOWING)) AS run
  FROM w WINDOW d AS (PARTITION BY doc_id ORDER BY k)
), f AS (SELECT *, min({{'doc': doc_id, 'k': k}}) OVER (PARTITION BY run) AS kept FROM r WHERE end_at IS NOT NULL),
l AS (SELECT *, k > coalesce(lag(k) OVER (PARTITION BY doc_id ORDER BY k), -99) + 51 AS new FROM f WHERE doc_id <> kept.doc OR k >= kept.k + 51),
g AS (SELECT *, count_if(new) OVER (PARTITION BY doc_id ORDER BY k) AS span FROM l)
SELECT doc_id, CAST(min(begin_at) AS BIGINT) AS "start", CAST(max(end_at) AS BIGINT) AS "end", min(kept.doc) AS kept_doc_id FROM g GROUP BY doc_id, span
"""

#: Every pair of sets that share a shingle; components by the smallest id that is reachable.
OP9 = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS ws FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [hash(ws)] ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: hash(ws[i:i + 4]))) END AS g FROM w
), n AS (SELECT doc_id, len(g) AS n, list_sort(g) AS g FROM s),
c AS (SELECT *, min(doc_id) OVER (PARTITION BY g) AS class_id FROM n WHERE n > 0),
k AS MATERIALIZED (SELECT doc_id AS id, n, g FROM c WHERE doc_id = class_id),
p AS MATERIALIZED (SELECT id, n, unnest(g) AS h FROM k),
l AS MATERIALIZED (
  SELECT a.id AS a, b.id AS b FROM p a JOIN p b ON a.h = b.h AND a.id < b.id AND 100 * a.n >= 80 * b.n AND 100 * b.n >= 80 * a.n
  GROUP BY a.id, b.id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), e AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT a AS id, a AS root FROM e UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.id AND r.root < e.b),
m AS (SELECT id, min(root) AS root FROM r GROUP BY id),
d AS (SELECT a, count(*) AS links FROM e GROUP BY a)
SELECT n.doc_id, CAST(n.n AS BIGINT) AS n_shingles, coalesce(m.root, c.class_id, n.doc_id) AS component_id, coalesce(c.class_id, n.doc_id) AS class_id, coalesce(d.links, 0) AS n_links
FROM n LEFT JOIN c ON c.doc_id = n.doc_id LEFT JOIN m ON m.id = c.class_id LEFT JOIN d ON d.a = c.class_id
"""

#: All windows of an item's size of texts that share a shingle with the item, by counts of their shingles.
OP6 = f"""
WITH split AS (SELECT 'd' AS side, doc_id AS id, {_WORDS.format("coalesce(text, '')")} AS ws FROM documents
  UNION ALL SELECT 'i', item_id, {_WORDS.format("coalesce(text, '')")} FROM benchmark),
g AS MATERIALIZED (SELECT side, id, pos, hash(ws[pos:pos + 4]) AS h FROM (SELECT side, id, ws, unnest(range(1, len(ws) - 3)) AS pos FROM split WHERE len(ws) > 4)),
i AS MATERIALIZED (SELECT id AS item_id, h, count(*) AS times FROM g WHERE side = 'i' GROUP BY id, h),
m AS MATERIALIZED (SELECT id AS item_id, len(ws) AS m FROM split WHERE side = 'i' AND len(ws) > 4),
hit AS MATERIALIZED (SELECT g.id AS doc_id, g.pos, g.h, i.item_id FROM g JOIN i ON g.h = i.h WHERE side = 'd'),
size AS MATERIALIZED (SELECT id AS doc_id, len(ws) AS n FROM split WHERE side = 'd'),
win AS MATERIALIZED (
  SELECT doc_id, item_id, m, n, unnest(range(0, greatest(0, n - m) + 1)) AS start
  FROM (SELECT DISTINCT doc_id, item_id FROM hit) JOIN m USING (item_id) JOIN size USING (doc_id)
), shared AS (
  SELECT w.doc_id, w.item_id, w.start, any_value(w.m) AS m, any_value(w.n) AS n, least(count(*), any_value(i.times)) AS shared
  FROM win w JOIN hit ON hit.doc_id = w.doc_id AND hit.item_id = w.item_id AND hit.pos - 1 BETWEEN w.start AND w.start + w.m - 5
  JOIN i ON i.item_id = w.item_id AND i.h = hit.h GROUP BY w.doc_id, w.item_id, w.start, hit.h
), alike AS (
  SELECT doc_id, item_id, start, sum(shared) / ((any_value(m) - 4) + (least(any_value(n), any_value(m)) - 4) - sum(shared)) AS similarity FROM shared GROUP BY doc_id, item_id, start
), brief AS (
  SELECT DISTINCT d.id AS doc_id, i.id AS item_id, pos - 1 AS start, 1.0 AS similarity
  FROM (SELECT id, ws FROM split WHERE side = 'i' AND len(ws) BETWEEN 1 AND 4) i
  JOIN (SELECT id, ws, unnest(range(1, len(ws) + 1)) AS pos FROM split WHERE side = 'd' AND EXISTS (SELECT 1 FROM split WHERE side = 'i' AND len(ws) BETWEEN 1 AND 4)) d ON d.ws[pos:pos + len(i.ws) - 1] = i.ws
)
SELECT doc_id, item_id, round(max(similarity), 9) AS similarity, CAST(min(start) AS BIGINT) AS "start", count(*) AS n_windows
FROM (SELECT * FROM alike WHERE similarity >= 0.8 UNION ALL SELECT * FROM brief) GROUP BY doc_id, item_id
"""

#: Host, path and rule of each page, and the rule's verdict.
URL_RULES = r"""
WITH p AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
r AS (SELECT rule, verdict, split_part(rule, '/', 1) AS suffix, substr(rule, instr(rule, '/')) AS start
  FROM (VALUES ('com/', 'allow'), ('example.com/en/', 'block'), ('www.example.com/en/', 'allow'), ('net/es/', 'block'), ('net/fr/', 'block')) t(rule, verdict))
SELECT page_id, host, path, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict
FROM h LEFT JOIN r ON (host = suffix OR ends_with(host, '.' || suffix)) AND starts_with(path, start) GROUP BY ALL
"""
