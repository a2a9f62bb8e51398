"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PLAIN = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
_SPACED = r"'[^\x20\x09-\x0D]+'"

OP3 = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, {_PLAIN}) AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOWER}, {_PLAIN}) AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM (SELECT item_id, w, least(13, len(w)) AS n, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
dw AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d CROSS JOIN (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
hit AS (SELECT dw.doc_id, dw.i, dw.n, bw.item_id FROM dw JOIN bw ON dw.win = bw.win AND dw.n = bw.n),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY 1),
found AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit WHERE item_id IS NOT NULL) GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN found USING (doc_id)
"""

OP4 = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_SPACED}) AS w FROM documents),
win AS (
  SELECT doc_id, i, sha256(array_to_string(w[i:i + 49], ' ')) AS h
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
least AS (SELECT h, min(doc_id) AS first FROM win GROUP BY 1),
gone AS (
  SELECT DISTINCT doc_id, p FROM (
    SELECT doc_id, unnest(range(i, i + 50)) AS p FROM win JOIN least USING (h) WHERE first < doc_id)),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (
  SELECT words.doc_id, count(gone.p) AS n_removed, string_agg(word, ' ' ORDER BY words.p) FILTER (gone.p IS NULL) AS t
  FROM words LEFT JOIN gone ON words.doc_id = gone.doc_id AND words.p = gone.p GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

OP5 = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, {_SPACED}) AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
met AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM met JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 5 * m >= 4 * (x.n + y.n - m)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a),
cls AS (SELECT a AS doc_id, min(b) AS class_id, count(*) AS class_size FROM reach GROUP BY 1),
deg AS (SELECT a AS doc_id, count(*) AS n_links FROM link GROUP BY 1)
SELECT doc_id, class_id, coalesce(n_links, 0) AS n_links, class_size FROM cls LEFT JOIN deg USING (doc_id)
"""

OP10 = rf"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), {_SPACED})) AS BIGINT) AS size, md5(concat_ws(':', '11', doc_id)) AS draw FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY 1),
w AS (
  SELECT source, source_size, [5.0, 2.0, 1.0][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS BIGINT)]::DOUBLE AS weight,
    2 * source_size::DOUBLE AS cap, 1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE AS total FROM s),
l AS (
  SELECT *, cap / weight AS ratio,
    (total - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
goal AS (
  SELECT source, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
    CAST('0x' || substr(md5('11:offset:' || coalesce(source, chr(1) || 'null')), 1, 8) AS BIGINT)::DOUBLE / 4294967296.0::DOUBLE AS start
  FROM (SELECT *, least(cap, coalesce((SELECT max(level) FROM l WHERE level <= ratio) * weight, cap)) AS target FROM l)),
r AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY
    8 * (length(bin(size)) - 1) + ((size * 8) >> (length(bin(size)) - 1)), CAST('0x' || substr(draw, 1, 4) AS BIGINT) % 64, size, draw, doc_id NULLS FIRST) AS k FROM d)
SELECT doc_id, size, source_size, target, CAST(floor(k * rate + start) - floor((k - 1) * rate + start) AS BIGINT) AS copies,
  size * CAST(floor(k * rate + start) - floor((k - 1) * rate + start) AS BIGINT) AS taken
FROM r JOIN goal ON r.source IS NOT DISTINCT FROM goal.source
"""

OP12 = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, {_PLAIN}) AS w FROM documents),
k AS (SELECT count(*) AS docs, CAST(sum(len(w)) AS BIGINT) AS terms FROM d WHERE len(w) > 0),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all({_LOWER}, {_PLAIN})) AS t FROM benchmark),
f AS (
  SELECT doc_id, n, t, count(*) AS tf FROM (SELECT doc_id, CAST(len(w) AS BIGINT) AS n, unnest(w) AS t FROM d)
  WHERE t IN (SELECT t FROM q) GROUP BY 1, 2, 3),
wt AS (SELECT t, CAST(floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE)) AS BIGINT) AS weight
  FROM (SELECT t, count(*) AS df FROM f GROUP BY 1) CROSS JOIN k),
s AS (
  SELECT item_id, doc_id, CAST(sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // terms)))) AS BIGINT) AS score
  FROM q JOIN f USING (t) JOIN wt USING (t) CROSS JOIN k GROUP BY 1, 2)
SELECT item_id, rank, doc_id, score FROM (
  SELECT item_id, doc_id, score, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM s WHERE score > 0)
WHERE rank <= 10
"""

# The CRC-32 of the decimal digits, bit by bit; then the rebuilt turns, their prefixes as lists, and each prefix's ancestors.
OP13 = """
WITH RECURSIVE t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
o AS (
  SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(role || chr(10) || text)) AS k FROM t),
n AS (SELECT conv_id, conv_id - conv_id % 100 AS root_id, count(*) AS n FROM o GROUP BY 1),
bits AS (
  SELECT conv_id, CAST(conv_id AS VARCHAR) AS digits, 0 AS i, 4294967295::BIGINT AS c FROM n
  UNION ALL
  SELECT conv_id, digits, i + 1, CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END
  FROM (SELECT conv_id, digits, i, CASE WHEN i % 8 = 0 THEN xor(c, ascii(digits[i // 8 + 1])::BIGINT) ELSE c END AS x FROM bits WHERE i < 8 * length(digits))),
h AS (SELECT conv_id, xor(c, 4294967295::BIGINT) % 6 AS h FROM bits WHERE i = 8 * length(digits)),
p AS (SELECT n.conv_id, n.root_id, h, least(h, coalesce(r.n, 0)) AS got FROM n JOIN h USING (conv_id) LEFT JOIN n r ON r.conv_id = n.root_id),
turns AS (
  SELECT o.conv_id, k - h + got AS d, role, text FROM o JOIN p USING (conv_id) WHERE k > h
  UNION ALL SELECT p.conv_id, k, role, text FROM p JOIN o ON o.conv_id = p.root_id WHERE k <= got),
step AS (
  SELECT conv_id, d, text, list({'r': role, 't': text}) OVER (PARTITION BY conv_id ORDER BY d) AS key FROM turns
  UNION ALL SELECT conv_id, 0, '', [] FROM n),
node AS (SELECT key, max(d) AS d, min(conv_id) AS conv_id, count(*) AS n_convs, max(length(text)) AS chars FROM step GROUP BY key),
kid AS (SELECT key[:d - 1] AS key, count(*) AS n FROM node WHERE d > 0 GROUP BY 1),
val AS (SELECT node.*, coalesce(kid.n, 0) AS n_children, (n_convs - 1) * chars AS saved FROM node LEFT JOIN kid USING (key)),
total AS (
  SELECT step.key, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS leaves, sum(saved) AS saved
  FROM val JOIN step ON step.conv_id = val.conv_id AND step.d <= val.d GROUP BY 1),
tail AS (SELECT key, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) AS ids
  FROM step JOIN (SELECT conv_id, max(d) AS d FROM step GROUP BY 1) USING (conv_id, d) GROUP BY 1)
SELECT val.conv_id, CAST(val.d AS BIGINT) AS depth, up.conv_id AS parent_conv_id, val.n_convs, val.n_children, CAST(leaves AS BIGINT) AS n_leaves,
  CAST(total.saved AS BIGINT) AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM val JOIN total USING (key) LEFT JOIN tail USING (key) LEFT JOIN node up ON val.d > 0 AND up.key = val.key[:val.d - 1]
"""

ORACLES = {"op3_decontamination": OP3, "op4_substring_dedup": OP4, "op5_jaccard_join": OP5, "op10_source_mixing": OP10, "op12_lexical_search": OP12, "op13_prefix_trie": OP13}
