"""SQL for the operators that it can express, over whole tables."""

_WORDS = r"[^\x20\x09-\x0D]+"

SUBSTRINGS = f"""
WITH w AS (SELECT doc_id, coalesce(regexp_extract_all(text, '{_WORDS}'), []) AS ws FROM documents),
h AS (SELECT doc_id, unnest(range(1, len(ws) - 11)) AS i, unnest(list_transform(range(1, len(ws) - 11), lambda i: array_to_string(ws[i:i + 12], ' '))) AS win FROM w WHERE len(ws) >= 13),
f AS (SELECT win, min(doc_id) AS first FROM h GROUP BY win),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS k FROM h JOIN f USING (win) WHERE first < doc_id),
k AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS k FROM w),
r AS (SELECT k.doc_id, string_agg(word, ' ' ORDER BY k.k) AS kept, count(*) AS n FROM k ANTI JOIN c ON c.doc_id = k.doc_id AND c.k = k.k GROUP BY k.doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN r ON r.doc_id = w.doc_id
"""

NEAR_TEXTS = f"""
WITH RECURSIVE w AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORDS}'), []) AS ws FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS x FROM w),
e AS (SELECT doc_id, len(x) AS n, unnest(x) AS x FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS n, any_value(b.n) AS m, count(*) AS c FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT a, b FROM p WHERE 100 * c >= 75 * (n + m - c)),
g AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS node, doc_id AS root FROM s UNION SELECT g.b, r.root FROM r JOIN g ON g.a = r.node),
m AS (SELECT node, min(root) AS root FROM r GROUP BY node)
SELECT doc_id, CAST(len(x) AS BIGINT) AS n_shingles, root AS component_id FROM s JOIN m ON m.node = s.doc_id
"""

ARCHIVES = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS x FROM pages),
f AS (SELECT x, min(page_id) AS first FROM p GROUP BY x)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((CAST('0x' || substr(x, CAST(5 * (k // 4) + 1 AS INT), 5) AS INT) >> CAST(15 - 5 * (k % 4) AS INT)) & 31) + 1, 1)), '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM p JOIN f USING (x)
"""

NEAR_VECTORS = """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
g AS (SELECT * FROM v WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM g a JOIN g b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.98),
r AS (SELECT vec_id AS node, vec_id AS root FROM v UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.node),
m AS (SELECT node, min(root) AS root FROM r GROUP BY node), d AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, root AS component_id, vec_id = root AS kept FROM v JOIN m ON m.node = vec_id LEFT JOIN d ON d.a = vec_id
"""

# The smallest capacity by binary search over greedy filling, then cuts nearest to an equal share of what is left: no earlier than the
# rest can be held by the shards that are left (b: filled from the end), and no later than the capacity allows.
SHARDS = """
WITH RECURSIVE crc AS (SELECT list(list_reduce(list_prepend(CAST(i AS UBIGINT), CAST(range(8) AS UBIGINT[])), lambda r, k: CASE WHEN r & 1 = 1 THEN xor(r >> 1, CAST(3988292384 AS UBIGINT)) ELSE r >> 1 END) ORDER BY i) AS t FROM range(256) r(i)),
d AS (SELECT doc_id, coalesce(text, '') AS x, CAST(doc_id AS VARCHAR) AS id FROM documents),
y AS (SELECT doc_id, CAST(strlen(x) + 16 AS BIGINT) AS size, CAST('0x' || substr(md5(x), 1, 12) AS BIGINT) % 163840 AS atom,
  list_reduce(list_prepend(CAST(4294967295 AS UBIGINT), CAST(list_transform(regexp_extract_all(hex(encode(x)), '..'), lambda h: CAST('0x' || h AS INT)) AS UBIGINT[])), lambda r, b: xor(t[CAST(xor(r, b) & 255 AS INT) + 1], r >> 8)) AS r,
  list_reduce(list_prepend(CAST(4294967295 AS UBIGINT), CAST(list_transform(regexp_extract_all(hex(encode(id)), '..'), lambda h: CAST('0x' || h AS INT)) AS UBIGINT[])), lambda r, b: xor(t[CAST(xor(r, b) & 255 AS INT) + 1], r >> 8)) AS q FROM d, crc),
z AS (SELECT doc_id, size, atom, CAST(xor(r, CAST(4294967295 AS UBIGINT)) AS BIGINT) AS crc, CAST(xor(q, CAST(4294967295 AS UBIGINT)) AS BIGINT) % greatest(64, (SELECT count(*) FROM d) // 10000000) AS chunk FROM y),
a AS (SELECT atom, CAST(sum(size) AS BIGINT) AS s FROM z GROUP BY atom),
e AS (SELECT list(s ORDER BY atom) AS sizes, list(atom ORDER BY atom) AS atoms FROM a),
f AS (SELECT sizes, atoms, list_transform(range(1, len(sizes) + 1), lambda i: CAST(list_sum(sizes[:i]) AS BIGINT)) AS ends, list_transform(sizes, lambda v: {'s': v, 'n': CAST(1 AS BIGINT)}) AS parts FROM e),
g AS (SELECT greatest(list_max(sizes), (ends[-1] + 39) // 40) AS lo, ends[-1] AS hi FROM f
  UNION ALL SELECT CASE WHEN n <= 40 THEN lo ELSE (lo + hi) // 2 + 1 END, CASE WHEN n <= 40 THEN (lo + hi) // 2 ELSE hi END
  FROM (SELECT lo, hi, list_reduce(parts, lambda u, v: CASE WHEN u.s + v.s <= (lo + hi) // 2 THEN {'s': u.s + v.s, 'n': u.n} ELSE {'s': v.s, 'n': u.n + 1} END).n AS n FROM g, f WHERE lo < hi)),
cap AS (SELECT min(hi) AS c FROM g),
b AS (SELECT 0 AS j, CAST(len(ends) AS BIGINT) AS i FROM f
  UNION ALL SELECT j + 1, CASE WHEN i = 0 OR ends[CAST(i AS INT)] <= c THEN 0 ELSE len(list_filter(ends, lambda v: v < ends[CAST(i AS INT)] - c)) + 1 END FROM b, f, cap WHERE j < 40),
cuts AS (SELECT 40 AS remaining, CAST(0 AS BIGINT) AS pos, CAST(0 AS BIGINT) AS done FROM f
  UNION ALL SELECT remaining - 1, cut, CASE WHEN cut = 0 THEN 0 ELSE ends[CAST(cut AS INT)] END
  FROM (SELECT remaining, ends, greatest(least(CASE WHEN near < stop AND near < len(ends) AND ends[CAST(near AS INT) + 1] - share < share - CASE WHEN near = 0 THEN 0 ELSE ends[CAST(near AS INT)] END THEN near + 1 ELSE near END, stop), i) AS cut
    FROM (SELECT remaining, ends, share, stop, b.i, greatest(pos, len(list_filter(ends, lambda v: v <= share))) AS near
      FROM (SELECT remaining, pos, ends, done + (ends[-1] - done) / remaining AS share, len(list_filter(ends, lambda v: v <= done + c)) AS stop FROM cuts, f, cap WHERE remaining > 1), b WHERE b.j = remaining - 1))),
k AS (SELECT CASE WHEN pos < len(atoms) THEN atoms[CAST(pos AS INT) + 1] ELSE 163840 END AS first FROM cuts, f WHERE remaining < 40),
p AS (SELECT z.*, (SELECT count(*) FROM k WHERE first <= z.atom) AS shard FROM z)
SELECT doc_id, size, crc AS text_crc32, 'bytes' AS law, CAST(shard AS INT) AS shard, row_number() OVER (PARTITION BY shard ORDER BY chunk, atom, doc_id, crc) - 1 AS slot, CAST(NULL AS INT) AS grown_shard FROM p
"""
