"""DuckDB SQL for the numbered operators that SQL can express."""

from __future__ import annotations

#: words of op1 as an array of (word, position)
_OP1 = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
sizes AS (SELECT item_id, w, least(10, len(w)) AS n FROM items WHERE len(w) > 0),
windows AS (
  SELECT DISTINCT item_id, n, list_slice(w, i, i + n - 1) AS g
  FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM sizes)),
lengths AS (SELECT DISTINCT n FROM windows),
grams AS (
  SELECT doc_id, n, i, list_slice(w, i, i + n - 1) AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM words, lengths WHERE len(w) >= n)),
found AS (SELECT doc_id, item_id, grams.n, i FROM grams JOIN windows USING (n, g)),
hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM found) GROUP BY doc_id),
listed AS (
  SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS s
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM found) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM words LEFT JOIN hits USING (doc_id) LEFT JOIN listed USING (doc_id)
"""

#: sets of op4, links between all pairs that share a shingle, and what each document reaches
_OP4 = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
shingles AS MATERIALIZED (
  SELECT DISTINCT doc_id, g FROM (
    SELECT doc_id, unnest(CASE WHEN len(w) = 1 THEN w ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS g FROM words)),
sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
sized AS MATERIALIZED (SELECT * FROM shingles JOIN sizes USING (doc_id)),
links AS MATERIALIZED (
  SELECT a.doc_id AS p, b.doc_id AS q
  FROM sized a JOIN sized b ON a.g = b.g AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
both_ways AS MATERIALIZED (SELECT p, q FROM links UNION ALL SELECT q, p FROM links),
reach AS (SELECT p, q FROM both_ways UNION SELECT r.p, b.q FROM reach r JOIN both_ways b ON r.q = b.p),
least_of AS (SELECT p AS doc_id, min(q) AS q FROM reach GROUP BY p)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, least(doc_id, coalesce(q, doc_id)) AS component_id, doc_id <= coalesce(q, doc_id) AS kept
FROM documents LEFT JOIN sizes USING (doc_id) LEFT JOIN least_of USING (doc_id)
"""

#: all 100-byte strings of op6 with their first places, runs of removed bytes and what is left between them
_OP6 = """
WITH texts AS MATERIALIZED (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
sized AS MATERIALIZED (SELECT doc_id, b, octet_length(b) AS n FROM texts),
strings AS (SELECT doc_id, i, b[i:i + 99] AS g FROM (SELECT doc_id, b, unnest(range(1, n - 98)) AS i FROM sized)),
later AS MATERIALIZED (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS k FROM strings) WHERE k > 1),
cut AS (SELECT doc_id, i, sum(CASE WHEN i <= before + 100 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS run
  FROM (SELECT doc_id, i, lag(i, 1, -1000) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM later)),
runs AS MATERIALIZED (SELECT doc_id, min(i) AS lo, max(i) + 100 AS hi FROM cut GROUP BY doc_id, run),
gaps AS (SELECT doc_id, lag(hi, 1, 1) OVER (PARTITION BY doc_id ORDER BY lo) AS lo, lo AS hi FROM runs UNION ALL SELECT doc_id, max(hi), NULL FROM runs GROUP BY doc_id),
kept AS (SELECT doc_id, sha256(unhex(string_agg(CASE WHEN coalesce(g.hi, n + 1) > g.lo THEN hex(b[g.lo:coalesce(g.hi, n + 1) - 1]) ELSE '' END, '' ORDER BY g.lo))) AS s FROM gaps g JOIN sized USING (doc_id) GROUP BY doc_id),
counted AS (SELECT doc_id, sum(hi - lo) AS n_removed, count(*) AS n_spans FROM runs GROUP BY doc_id)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, coalesce(s, sha256(b)) AS kept_sha256
FROM sized LEFT JOIN counted USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

#: passages, originals, parents, reply paths and threads of op8
_OP8 = r"""
WITH RECURSIVE m AS MATERIALIZED (SELECT row_number() OVER () AS id, conv_id, turn, role, text FROM conversations),
lines AS (
  SELECT id, conv_id, turn, i, line, regexp_extract(line, '^(?:[ \t]*>)+[ \t]?') AS mark
  FROM (SELECT id, conv_id, turn, unnest(range(len(parts))) AS i, unnest(parts) AS line
    FROM (SELECT *, string_split(text, chr(10)) AS parts FROM m WHERE conv_id IS NOT NULL AND turn IS NOT NULL AND regexp_matches(text, '(^|\n)[ \t]*>')))),
leveled AS (SELECT *, len(mark) - len(replace(mark, '>', '')) AS level, line[len(mark) + 1:] AS body FROM lines),
marked AS MATERIALIZED (
  SELECT *, regexp_matches(body, '^[\s>]*$') AS blank, level = 0 AND regexp_matches(line, '^\s*On .*wrote:\s*$') AND lead(level, 1, 0) OVER (PARTITION BY id ORDER BY i) > 0 AS said FROM leveled),
own AS MATERIALIZED (
  SELECT id, regexp_replace(regexp_replace(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (level = 0 AND NOT said), ''), '\n[ \t]*(?:\n[ \t]*)+', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS own
  FROM marked GROUP BY id),
cut AS (SELECT *, level <> lag(level, 1, -1) OVER w OR lag(blank, 1, true) OVER w AS fresh FROM marked WINDOW w AS (PARTITION BY id ORDER BY i)),
parts AS (SELECT *, sum(CAST(fresh AS INTEGER)) OVER (PARTITION BY id ORDER BY i) AS part FROM cut),
quoted AS MATERIALIZED (
  SELECT id, conv_id, turn, part, level, trim(regexp_replace(lower(string_agg(body, ' ' ORDER BY i)), '\s+', ' ', 'g')) AS h
  FROM parts WHERE level > 0 AND NOT blank GROUP BY id, conv_id, turn, part, level),
texts AS (SELECT conv_id, turn, coalesce(own, text) AS t FROM m LEFT JOIN own USING (id) WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
pieces AS (
  SELECT DISTINCT conv_id, turn, trim(regexp_replace(lower(p), '\s+', ' ', 'g')) AS h
  FROM (SELECT conv_id, turn, unnest(list_append(string_split_regex(t, '\n[ \t]*\n'), t)) AS p FROM texts WHERE t IS NOT NULL)),
inside AS MATERIALIZED (SELECT h, conv_id, min(turn) AS first_turn FROM pieces WHERE h <> '' AND h IN (SELECT h FROM quoted) GROUP BY h, conv_id),
firsts AS (SELECT h, min((conv_id, first_turn)) AS f FROM inside GROUP BY h),
linked AS MATERIALIZED (
  SELECT q.*, CASE WHEN i.first_turn < q.turn THEN (q.conv_id, i.first_turn) WHEN f < (q.conv_id, q.turn) THEN f END AS t
  FROM quoted q LEFT JOIN inside i ON q.h = i.h AND q.conv_id = i.conv_id LEFT JOIN firsts ON q.h = firsts.h),
counts AS (SELECT id, count(*) AS n_quotes, count(t) AS n_linked, min(level) FILTER (t IS NOT NULL) AS shallow FROM linked GROUP BY id),
votes AS (SELECT id, conv_id, turn, t, count(*) AS v FROM linked JOIN counts USING (id) WHERE t IS NOT NULL AND level = shallow GROUP BY id, conv_id, turn, t),
parents AS MATERIALIZED (SELECT id, conv_id, turn, min((-v, t))[2][1] AS pc, min((-v, t))[2][2] AS pt FROM votes GROUP BY id, conv_id, turn),
ups AS MATERIALIZED (SELECT conv_id, turn, min((pc, pt)) AS up FROM parents GROUP BY conv_id, turn),
walks AS (
  SELECT conv_id, turn, up, 1 AS depth, format('{:020d}.{:020d}/{:020d}.{:020d}', up[1], up[2], conv_id, turn) AS path FROM ups
  UNION ALL
  SELECT w.conv_id, w.turn, u.up, depth + 1, format('{:020d}.{:020d}/', u.up[1], u.up[2]) || path FROM walks w JOIN ups u ON u.conv_id = w.up[1] AND u.turn = w.up[2]),
paths AS (SELECT conv_id, turn, max(depth) AS depth, arg_max(path, depth) AS path FROM walks GROUP BY conv_id, turn),
ties AS (SELECT DISTINCT conv_id AS p, pc AS q FROM parents WHERE pc <> conv_id),
both_ways AS MATERIALIZED (SELECT p, q FROM ties UNION SELECT q, p FROM ties),
reach AS (SELECT p, q FROM both_ways UNION SELECT r.p, b.q FROM reach r JOIN both_ways b ON r.q = b.p),
threads AS (SELECT p AS conv_id, min(q) AS t FROM reach GROUP BY p)
SELECT m.conv_id, m.turn, role, coalesce(own, text) AS text, coalesce(n_quotes, 0) AS n_quotes, coalesce(n_linked, 0) AS n_linked, pc AS parent_conv, pt AS parent_turn,
  least(m.conv_id, coalesce(threads.t, m.conv_id)) AS thread_id, CAST(coalesce(paths.depth, 0) AS BIGINT) AS depth, coalesce(path, format('{:020d}.{:020d}', m.conv_id, m.turn)) AS reply_path
FROM m LEFT JOIN own USING (id) LEFT JOIN counts USING (id) LEFT JOIN parents USING (id)
LEFT JOIN paths ON paths.conv_id = m.conv_id AND paths.turn = m.turn LEFT JOIN threads ON threads.conv_id = m.conv_id
"""

#: rebuilt conversations of op12, a hash for each of their prefixes, and each node with all nodes below it
_OP12 = """
WITH RECURSIVE own AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL),
sizes AS (SELECT conv_id, count(*) AS n, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT)) AS bytes FROM own GROUP BY conv_id),
crc AS (SELECT conv_id, n, CAST(1 AS BIGINT) AS i, bytes, CAST(4294967295 AS BIGINT) AS v FROM sizes
  UNION ALL SELECT conv_id, n, i + 1, bytes, list_reduce([xor(v, bytes[i]), 0, 0, 0, 0, 0, 0, 0, 0], lambda a, z: CASE WHEN a % 2 = 1 THEN xor(a // 2, CAST(3988292384 AS BIGINT)) ELSE a // 2 END) FROM crc WHERE i <= len(bytes)),
plans AS (SELECT conv_id, xor(v, CAST(4294967295 AS BIGINT)) % 9 AS h FROM crc WHERE i > len(bytes)),
made AS (
  SELECT p.conv_id, o.pos, o.role, o.text FROM plans p JOIN own o ON o.conv_id = p.conv_id - p.conv_id % 5 WHERE o.pos <= p.h
  UNION ALL SELECT p.conv_id, least(p.h, coalesce(b.n, 0)) + o.pos - p.h, o.role, o.text FROM plans p JOIN own o ON o.conv_id = p.conv_id LEFT JOIN sizes b ON b.conv_id = p.conv_id - p.conv_id % 5 WHERE o.pos > p.h),
path AS (SELECT m.conv_id, m.pos AS depth, strlen(m.text) AS size, list(sha256(m.role) || sha256(m.text)) OVER (PARTITION BY m.conv_id ORDER BY m.pos) AS way FROM made m
  UNION ALL SELECT conv_id, 0, 0, [] FROM plans),
keyed AS (SELECT conv_id, depth, size, md5(array_to_string(way, '')) AS k, depth = max(depth) OVER (PARTITION BY conv_id) AS ends FROM path),
node AS (SELECT depth, k, min(conv_id) AS conv_id, count(*) AS n_convs, max(size) AS size, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256 FROM keyed GROUP BY depth, k),
pair AS (SELECT a.depth, a.k, n.depth AS below, n.conv_id AS by, n.n_convs, n.size, NOT EXISTS (SELECT 1 FROM keyed e JOIN keyed f ON e.conv_id = f.conv_id AND f.depth = e.depth + 1 WHERE e.depth = n.depth AND e.k = n.k) AS leaf FROM node n JOIN keyed a ON a.conv_id = n.conv_id AND a.depth <= n.depth)
SELECT n.conv_id, n.depth, u.conv_id AS parent_conv_id, n.n_convs, t.n_children, t.n_leaves, t.saved_tokens, n.ends_sha256
FROM node n JOIN (SELECT depth, k, CAST(sum(CASE WHEN below = depth + 1 THEN 1 ELSE 0 END) AS BIGINT) AS n_children, CAST(sum(CASE WHEN leaf THEN 1 ELSE 0 END) AS BIGINT) AS n_leaves, CAST(sum((n_convs - 1) * size) AS BIGINT) AS saved_tokens FROM pair GROUP BY depth, k) t ON n.depth = t.depth AND n.k = t.k
LEFT JOIN keyed w ON w.conv_id = n.conv_id AND w.depth = n.depth - 1 LEFT JOIN node u ON u.depth = w.depth AND u.k = w.k
"""

#: all scores of op13's anchors
_OP13 = """
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda e: floor(256 * CAST(e AS DOUBLE))) AS x
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
scored AS MATERIALIZED (
  SELECT a.r, a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_dot_product(a.x, b.x) AS BIGINT) AS s
  FROM v a JOIN v b ON a.r <> b.r WHERE a.vec_id % 100 = 0),
positive AS (
  SELECT *, row_number() OVER (PARTITION BY r ORDER BY s DESC, vec_id) AS k FROM scored WHERE same),
negative AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, n.vec_id AS negative_id, p.s AS positive_score, n.s AS negative_score, row_number() OVER (PARTITION BY p.r, p.k ORDER BY n.s DESC, n.vec_id) AS k
  FROM positive p JOIN scored n ON n.r = p.r AND NOT n.same AND 30 * p.s <= 100 * n.s AND 100 * n.s <= 90 * p.s WHERE p.k <= 5)
SELECT anchor_id, positive_id, CAST(k AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM negative WHERE k <= 10
"""

ORACLES = {"op1_decontamination": _OP1, "op4_near_duplicates": _OP4, "op6_repeated_bytes": _OP6, "op8_quotation": _OP8, "op12_prefix_trie": _OP12, "op13_hard_negatives": _OP13}
