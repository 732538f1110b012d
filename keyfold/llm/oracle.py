"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

SQL: dict[str, str] = {}

SQL["op10_decontamination"] = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(13, len(w)) AS k, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS s
       FROM (SELECT item_id, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
k AS (SELECT DISTINCT k FROM bw),
dw AS (SELECT doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') AS s
       FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d CROSS JOIN k WHERE len(w) >= k)),
m AS (SELECT doc_id, i, dw.k AS k, item_id FROM dw JOIN bw ON dw.s = bw.s AND dw.k = bw.k),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM m) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""

SQL["op1_line_dedup"] = r"""
WITH l AS (SELECT rid, doc_id, i, lines[i] AS line, trim(translate(lines[i], 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS key
           FROM (SELECT rid, doc_id, lines, unnest(range(1, len(lines) + 1)) AS i
                 FROM (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents))),
f AS (SELECT key, max(doc_id) AS keeper FROM l WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5)
SELECT l.doc_id AS doc_id, count(*) AS n_lines, CAST(count(*) FILTER (keeper IS NOT NULL AND l.doc_id <> keeper) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (keeper IS NULL OR l.doc_id = keeper), '')) AS kept_sha256
FROM l LEFT JOIN f ON l.key = f.key GROUP BY rid, l.doc_id
"""

SQL["op4_mixing"] = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size, left(md5(coalesce(CAST(doc_id AS VARCHAR), text, '')), 9) AS h FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, CAST(([5, 2, 1])[1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS DOUBLE) AS weight FROM d GROUP BY source),
o AS (SELECT *, CAST(sum(2 * source_size) OVER w AS DOUBLE) AS capped, sum(weight) OVER () - sum(weight) OVER w AS open, CAST(1.5 AS DOUBLE) * CAST(sum(source_size) OVER () AS DOUBLE) AS budget
      FROM s WINDOW w AS (ORDER BY source_size / weight, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
u AS (SELECT *, (budget - (capped - 2 * source_size)) / (open + weight) AS level FROM o),
z AS (SELECT source, source_size, weight, max(CASE WHEN level * weight <= 2 * source_size THEN level END) OVER () AS first_level, level, CAST(2 * source_size AS DOUBLE) AS cap FROM u),
g AS (SELECT source, source_size, CASE WHEN cap = 0 THEN CAST(0 AS DOUBLE) ELSE least(cap, first_level * weight) END AS target FROM z),
p AS (SELECT *, CAST(CASE WHEN source_size = 0 THEN 0 ELSE floor(target / source_size) END AS BIGINT) AS full_copies FROM g),
b AS (SELECT d.source AS source, h, sum(size) AS n FROM d GROUP BY d.source, h),
c AS (SELECT b.source AS source, h, sum(n) OVER (PARTITION BY b.source ORDER BY h) - n + n / 2.0 <= target - full_copies * source_size AS taken
      FROM b JOIN p ON b.source IS NOT DISTINCT FROM p.source)
SELECT d.doc_id AS doc_id, CAST(d.size AS BIGINT) AS size, p.source_size AS source_size, p.target AS target,
       CAST(d.size * (p.full_copies + CASE WHEN c.taken THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source JOIN c ON d.source IS NOT DISTINCT FROM c.source AND d.h = c.h
"""

# All pairs of the query set and all rows: exact, so it also holds the graph's recall to 1 on tables of its size.
SQL["op8_nearest"] = r"""
WITH v AS (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (SELECT q.rid AS rid, q.vec_id AS query_id, c.vec_id AS vec_id, list_reduce(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2]), lambda a, b: a + b) AS score
      FROM v q JOIN v c ON q.rid <> c.rid AND len(q.e) = len(c.e) WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id) AS rank FROM p)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20
"""

SQL["url_rules"] = r"""
WITH p AS (SELECT page_id, CASE WHEN instr(coalesce(url, ''), '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM p),
r(rule_host, prefix, what) AS (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
m AS (SELECT page_id, rule_host || prefix AS rule, what, row_number() OVER (PARTITION BY page_id ORDER BY length(rule_host || prefix) DESC, rule_host || prefix) AS k
      FROM h JOIN r ON (host = rule_host OR host LIKE '%.' || rule_host) AND starts_with(path, prefix))
SELECT h.page_id AS page_id, host, path, m.rule AS rule, m.what AS ruled FROM h LEFT JOIN m ON m.page_id = h.page_id AND m.k = 1
"""

SQL["op3_chat_format"] = r"""
WITH c AS (SELECT conv_id, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS alone, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, NULL, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, NULL, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, 24 + length(role) + length(text)
              + (length(role || text) - length(replace(replace(replace(role || text, '\', ''), '<', ''), '[', ''))) AS n FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(n) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id, alone
"""


# The notices stand here as they do on licensed works; their bigrams are taken by the SQL itself.
SQL["op7_license_scan"] = r"""
WITH t(licence, text) AS (VALUES
  ('Apache-2.0', 'licensed under the apache license version 2 0'),
  ('BSD', 'redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met'),
  ('CC-BY-4.0', 'this work is licensed under a creative commons attribution 4 0 international license'),
  ('CC-BY-NC-4.0', 'licensed under cc by nc 4 0'),
  ('CC-BY-SA-4.0', 'this work is licensed under a creative commons attribution sharealike 4 0 international license'),
  ('GPL-3.0', 'this work is licensed under the gnu general public license version 3'),
  ('LGPL-3.0', 'this library is licensed under the gnu lesser general public license version 3'),
  ('MIT', 'released under the mit license'),
  ('MPL-2.0', 'this source code form is subject to the terms of the mozilla public license version 2 0')),
tw AS (SELECT licence, string_split(text, ' ') AS w FROM t),
tg AS (SELECT licence, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM tw),
u AS (SELECT rid, doc_id, unnest(regexp_split_to_array(lower(coalesce(text, '')), '\n|[.!?][ \t\r]+')) AS unit FROM (SELECT row_number() OVER () AS rid, doc_id, text FROM documents)),
w AS (SELECT rid, row_number() OVER () AS uid, regexp_extract_all(unit, '[a-z0-9]+') AS w FROM u),
b AS (SELECT rid, uid, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM w),
k AS (SELECT rid, uid, licence, CAST(2 * len(list_intersect(b.g, tg.g)) AS DOUBLE) / (len(b.g) + len(tg.g)) AS dice FROM b, tg),
m AS (SELECT * FROM k WHERE dice >= 0.8),
n AS (SELECT rid, licence, dice, row_number() OVER (PARTITION BY rid ORDER BY dice DESC, licence) AS r FROM m),
c AS (SELECT rid, count(DISTINCT uid) AS n_units FROM m GROUP BY rid)
SELECT d.doc_id AS doc_id, n.licence AS licence, coalesce(n.dice, CAST(0 AS DOUBLE)) AS dice, CAST(coalesce(c.n_units, 0) AS BIGINT) AS n_units
FROM (SELECT row_number() OVER () AS rid, doc_id FROM documents) d LEFT JOIN n ON n.rid = d.rid AND n.r = 1 LEFT JOIN c ON c.rid = d.rid
"""

SQL["op2_near_dedup"] = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + least(5, len(w)) - 1], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY x.doc_id, y.doc_id),
l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 85 * (na.n + nb.n - c)),
r(doc_id, low) AS (SELECT doc_id, doc_id FROM documents UNION SELECT l.b, r.low FROM r JOIN l ON l.a = r.doc_id)
SELECT documents.doc_id AS doc_id, coalesce(n.n, 0) AS n_shingles, m.low AS component_id, documents.doc_id = m.low AS kept
FROM documents LEFT JOIN n ON n.doc_id = documents.doc_id JOIN (SELECT doc_id, min(low) AS low FROM r GROUP BY doc_id) m ON m.doc_id = documents.doc_id
"""
