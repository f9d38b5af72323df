"""DuckDB SQL of the text operators that SQL can express, written from their definitions."""

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPACE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

NEAR_DEDUP = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), s AS MATERIALIZED (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 3 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 2], ' ') END AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM d WHERE len(w) > 0)
), n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
links AS MATERIALIZED (
  SELECT a, b FROM shared JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 85 * (p.n + q.n - c)
), reach AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
least AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, least(doc_id, coalesce(least.b, doc_id)) AS component_id,
  doc_id = least(doc_id, coalesce(least.b, doc_id)) AS kept
FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN least ON least.a = doc_id
"""

LINE_DEDUP = f"""
WITH l AS (
  SELECT doc_id, i, lines[i] AS line, translate(trim(lines[i], {SPACE}), '{UPPER}', '{LOWER}') AS k
  FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents))
), c AS (SELECT k, max(doc_id) AS last_doc FROM l WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT l.*, c.k IS NOT NULL AND l.doc_id <> c.last_doc AS gone FROM l LEFT JOIN c USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""

#: Targets: rows of a source to the power 1/2, as whole numbers of 1e-12; blocks of 8 rows; slot after slot the released block of
#: earliest deadline.
MIX = """
WITH RECURSIVE r AS (SELECT doc_id, coalesce(source, '(none)') AS source, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS g FROM documents),
n AS (SELECT source, count(*) AS n FROM r GROUP BY source),
w AS (SELECT source, (n + 7) // 8 AS need, CAST(greatest(round(sqrt(n) / (SELECT sum(sqrt(n)) FROM n) * 1e12), 1e6) AS HUGEINT) AS w FROM n),
s AS MATERIALIZED (
  SELECT list(w ORDER BY source) AS w, list(source ORDER BY source) AS names, sum(w) AS d,
    (SELECT max((need * (SELECT sum(w) FROM w) + w - 1) // w) FROM w) AS slots FROM w
), f AS (
  SELECT 0 AS slot, list_transform(w, lambda x: 0::HUGEINT) AS done, -1::BIGINT AS chosen, w, d, slots FROM s
  UNION ALL
  SELECT slot + 1, list_transform(range(1, len(w) + 1), lambda i: done[i] + CASE WHEN i = pick THEN 1 ELSE 0 END), pick, w, d, slots
  FROM (
    SELECT *, CAST(list_min(list_filter(list_transform(range(1, len(w) + 1), lambda i: CASE WHEN done[i] * d // w[i] <= slot
      THEN ((done[i] + 1) * d + w[i] - 1) // w[i] * 100000 + i END), lambda x: x IS NOT NULL)) % 100000 AS BIGINT) AS pick FROM f WHERE slot < slots
  )
), p AS (SELECT names[chosen] AS source, slot - 1 AS slot, row_number() OVER (PARTITION BY chosen ORDER BY slot) - 1 AS block FROM f, s WHERE chosen > 0),
o AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY g) - 1 AS number FROM r)
SELECT o.doc_id, o.source, p.block, CAST(p.slot AS BIGINT) AS slot, CAST(p.slot * 8 + number % 8 AS BIGINT) AS position
FROM o JOIN p ON p.source = o.source AND p.block = number // 8
"""

TOP_K = """
WITH c AS MATERIALIZED (
  SELECT DISTINCT vec_id, array_to_string(list_transform(embedding, lambda x: CASE WHEN x > 0 THEN '1' ELSE '0' END), '') AS code FROM embeddings
), p AS (
  SELECT q.vec_id AS query_id, c.vec_id AS neighbour_id, hamming(q.code, c.code) AS distance
  FROM c q JOIN c ON c.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbour_id) AS rank FROM p)
SELECT query_id, CAST(rank AS INTEGER) AS rank, neighbour_id, distance FROM r WHERE rank <= 10
"""

SQL = {
    "op6_exact_topk": TOP_K,
    "op10_mix_sources": MIX,
    "op2_line_dedup": LINE_DEDUP,
    "op8_minhash_near_dedup": NEAR_DEDUP,
}
