"""The corpus queries as SQL for DuckDB, where SQL can express them."""

ORACLE: dict[str, str] = {}

ORACLE["op8_mixing"] = r"""
WITH sized AS (
  SELECT doc_id, source, md5(coalesce(text, '')) AS body,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size
  FROM documents),
totals AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
ranked AS (
  SELECT source, source_size, source_size * 2.0::DOUBLE AS cap,
         list_extract([3.0, 1.0, 2.0], (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS weight,
         sum(source_size) OVER () AS total
  FROM totals),
filled AS (
  SELECT *, sum(cap) OVER w AS cap_before, sum(weight) OVER w AS weight_before,
         sum(weight) OVER () AS weights
  FROM ranked
  WINDOW w AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (
  SELECT min_by((1.5::DOUBLE * total - coalesce(cap_before, 0)) / (weights - coalesce(weight_before, 0)),
                cap / weight) AS share
  FROM filled
  WHERE cap / weight > (1.5::DOUBLE * total - coalesce(cap_before, 0)) / (weights - coalesce(weight_before, 0))),
plan AS (
  SELECT source, source_size, least(cap, coalesce(share, 1e300) * weight) AS target FROM ranked, level),
rated AS (
  SELECT doc_id, size, source_size, target,
         CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate,
         ('0x' || substr(md5('8:' || coalesce(doc_id::VARCHAR, '') || ':' || body), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u
  FROM sized JOIN plan ON sized.source IS NOT DISTINCT FROM plan.source)
SELECT doc_id, size, source_size, target,
       (size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM rated
"""

ORACLE["op6_decontamination"] = r"""
WITH it AS (
  SELECT item_id::VARCHAR AS item,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
starts AS (SELECT item, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM it WHERE len(w) > 0),
win AS (SELECT DISTINCT item, array_to_string(w[i:i + 12], ' ') AS t, least(len(w), 13) AS n FROM starts),
d AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
sizes AS (SELECT DISTINCT n FROM win),
places AS (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n),
grams AS (SELECT rid, i, n, array_to_string(w[i:i + n - 1], ' ') AS t FROM places),
hit AS (SELECT rid, i, n, item FROM grams JOIN win USING (t, n)),
spots AS (SELECT rid, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT rid, i, n FROM hit)),
covered AS (SELECT rid, count(DISTINCT p) AS n_hit FROM spots GROUP BY rid),
named AS (
  SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
  FROM (SELECT DISTINCT rid, item FROM hit) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
       coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(names, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN covered USING (rid) LEFT JOIN named USING (rid)
"""

ORACLE["op4_suffix_dedup"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, hex(encode(coalesce(text, ''))) AS h,
         octet_length(encode(coalesce(text, ''))) AS n
  FROM documents),
stretches AS (SELECT rid, h, n, unnest(range(0, n - 399, 1024)) AS z FROM d WHERE n >= 400),
cut AS (SELECT rid, z, least(n - 399 - z, 1024) AS k, substr(h, 2 * z + 1, 2 * (1024 + 399)) AS s FROM stretches),
places AS (SELECT rid, z, s, unnest(range(0, k)) AS j FROM cut),
windows AS (SELECT rid, z + j AS i, md5(substr(s, 2 * j + 1, 800)) AS m FROM places),
twice AS (SELECT m FROM windows GROUP BY m HAVING count(*) > 1),
repeated AS (SELECT rid, i FROM windows SEMI JOIN twice USING (m)),
marked AS (
  SELECT rid, i, CASE WHEN i <= lag(i) OVER (PARTITION BY rid ORDER BY i) + 400 THEN 0 ELSE 1 END AS fresh
  FROM repeated),
numbered AS (SELECT rid, i, sum(fresh) OVER (PARTITION BY rid ORDER BY i) AS g FROM marked),
spans AS (SELECT rid, min(i) AS a, max(i) + 400 AS b FROM numbered GROUP BY rid, g),
parts AS (SELECT rid, a, b, coalesce(lag(b) OVER (PARTITION BY rid ORDER BY a), 0) AS z FROM spans),
pieces AS (
  SELECT rid, sum(b - a) AS n_removed, count(*) AS n_spans, max(b) AS tail,
         string_agg(substr(h, 2 * z + 1, 2 * (a - z)), '' ORDER BY a) AS front
  FROM parts JOIN d USING (rid) GROUP BY rid)
SELECT doc_id, n::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed,
       coalesce(n_spans, 0)::BIGINT AS n_spans,
       sha256(unhex(coalesce(front, '') || substr(h, 2 * coalesce(tail, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN pieces USING (rid)
"""

ORACLE["op12_merkle"] = r"""
WITH RECURSIVE d AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, doc_id, source, lang, n_chars, text,
         list_reduce(list_concat([4294967295], list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
                     lambda a, b: list_reduce(list_concat([xor(a, b)], [0, 0, 0, 0, 0, 0, 0, 0]),
                                           lambda x, z: xor(x >> 1, 3988292384 * (x & 1)))) AS crc
  FROM (SELECT * REPLACE (n_chars::BIGINT AS n_chars) FROM documents)),
cells AS (
  SELECT rid, doc_id, source, [doc_id::VARCHAR, source, lang, n_chars::VARCHAR] AS head, text,
         CASE WHEN (xor(crc, 4294967295) & 1) = 0 THEN replace(text, chr(10), '') ELSE text END AS seen
  FROM d),
hashed AS MATERIALIZED (
  SELECT rid, doc_id, source,
         sha256(array_to_string(list_transform(list_concat(head, [text]),
                lambda v: CASE WHEN v IS NULL THEN '-' ELSE strlen(v)::VARCHAR || ':' || v END), '')) AS leaf,
         sha256(array_to_string(list_transform(list_concat(head, [seen]),
                lambda v: CASE WHEN v IS NULL THEN '-' ELSE strlen(v)::VARCHAR || ':' || v END), '')) AS now
  FROM cells),
groups AS MATERIALIZED (
  SELECT source, n, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS tree
  FROM (SELECT source, count(*) AS n FROM hashed GROUP BY source)),
placed AS MATERIALIZED (
  SELECT rid, doc_id, leaf, now, tree, n,
         row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i
  FROM hashed JOIN groups ON hashed.source IS NOT DISTINCT FROM groups.source),
below AS (
  SELECT tree, 0 AS level, i AS idx, leaf AS h FROM placed
  UNION ALL
  SELECT tree, level + 1, idx // 3, sha256(string_agg(h, '' ORDER BY idx))
  FROM (SELECT *, count(*) OVER (PARTITION BY tree) AS many FROM below)
  WHERE many > 1 GROUP BY tree, level, idx // 3),
subroots AS MATERIALIZED (
  SELECT tree, arg_max(h, level) AS subroot, max(level) AS height FROM below GROUP BY tree),
above AS (
  SELECT 0 AS level, tree AS idx, subroot AS h FROM subroots
  UNION ALL
  SELECT level + 1, idx // 3, sha256(string_agg(h, '' ORDER BY idx))
  FROM (SELECT *, count(*) OVER () AS many FROM above)
  WHERE many > 1 GROUP BY level, idx // 3),
peak AS MATERIALIZED (SELECT arg_max(h, level) AS root, max(level) AS height FROM above),
nodes AS MATERIALIZED (
  SELECT tree, level, idx, idx // 3 AS run, h FROM below
  UNION ALL SELECT -1, level, idx, idx // 3, h FROM above),
steps AS MATERIALIZED (
  SELECT rid, level AS s, tree, level, i // (3 ** level)::BIGINT AS idx
  FROM (SELECT rid, tree, i, unnest(range(0, height)) AS level FROM placed JOIN subroots USING (tree))
  UNION ALL
  SELECT rid, low + level, -1, level, tree // (3 ** level)::BIGINT
  FROM (SELECT rid, tree, subroots.height AS low, unnest(range(0, peak.height)) AS level
        FROM placed JOIN subroots USING (tree), peak)),
proofs AS (
  SELECT rid, string_agg(h, '' ORDER BY s, nodes.idx) AS proof
  FROM steps JOIN nodes ON nodes.tree = steps.tree AND nodes.level = steps.level
       AND nodes.run = steps.idx // 3 AND nodes.idx <> steps.idx
  GROUP BY rid),
folded AS (
  SELECT rid, 0::BIGINT AS s, now AS h FROM placed
  UNION ALL
  SELECT folded.rid, folded.s + 1,
         sha256(string_agg(CASE WHEN nodes.idx = steps.idx THEN folded.h ELSE nodes.h END, '' ORDER BY nodes.idx))
  FROM folded JOIN steps ON steps.rid = folded.rid AND steps.s = folded.s
       JOIN nodes ON nodes.tree = steps.tree AND nodes.level = steps.level AND nodes.run = steps.idx // 3
  GROUP BY folded.rid, folded.s),
ends AS (SELECT rid, arg_max(h, s) AS folded_root FROM folded GROUP BY rid)
SELECT doc_id, leaf, subroot, root, sha256(coalesce(proof, '')) AS proof_sha256, folded_root,
       folded_root = root AS verified
FROM placed JOIN subroots USING (tree) JOIN ends USING (rid) LEFT JOIN proofs USING (rid), peak
"""
