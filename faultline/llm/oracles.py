"""DuckDB SQL for those queries that SQL can express on whole tables."""

from . import mixing

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

CELL_NEAR_DEDUP = """
WITH RECURSIVE u AS (SELECT vec_id, embedding AS x, list_reduce(list_prepend(0.0::DOUBLE, list_transform(embedding, lambda v: CAST(v AS DOUBLE) * v)), lambda s, v: s + v) AS q FROM embeddings),
l AS (SELECT a.vec_id AS i, b.vec_id AS j FROM u a JOIN u b ON a.vec_id <> b.vec_id AND a.q > 0 AND b.q > 0
  AND list_reduce(list_prepend(0.0::DOUBLE, list_transform(list_zip(a.x, b.x), lambda p: CAST(p[1] AS DOUBLE) * p[2])), lambda s, v: s + v) / sqrt(a.q) / sqrt(b.q) >= 0.95),
r AS (SELECT vec_id AS i, vec_id AS j FROM u UNION SELECT r.i, l.j FROM r JOIN l ON r.j = l.i),
c AS (SELECT i, min(j) AS component_id FROM r GROUP BY i), n AS (SELECT i, count(*) AS n FROM l GROUP BY i)
SELECT vec_id, coalesce(n.n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM u JOIN c ON c.i = vec_id LEFT JOIN n ON n.i = vec_id
"""

PREFIX_TREE_JOIN = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(ws) - 3, 2)), lambda i: array_to_string(ws[i : i + 4], ' '))) AS shingle FROM w WHERE len(ws) > 0),
n AS (SELECT w.doc_id, count(shingle) AS n FROM w LEFT JOIN s ON s.doc_id = w.doc_id GROUP BY w.doc_id),
p AS (SELECT a.doc_id AS i, b.doc_id AS j, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT i, j FROM p JOIN n x ON x.doc_id = i JOIN n y ON y.doc_id = j WHERE 100 * c >= 80 * (x.n + y.n - c)),
r AS (SELECT doc_id AS i, doc_id AS j FROM w UNION SELECT r.i, l.j FROM r JOIN l ON r.j = l.i),
c AS (SELECT i, min(j) AS component_id FROM r GROUP BY i)
SELECT doc_id, n AS n_shingles, component_id, doc_id = component_id AS kept FROM n JOIN c ON c.i = doc_id
"""

DOUBLING_WINDOWS = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
x AS (SELECT doc_id, unnest(range(1, len(ws) - 18)) AS i, unnest(list_transform(range(1, len(ws) - 18), lambda i: md5(array_to_string(ws[i : i + 19], ' ')))) AS h FROM w WHERE len(ws) >= 20),
y AS (SELECT doc_id, i, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) AS place FROM x),
g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS k FROM y WHERE place > 1),
e AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS k, unnest(ws) AS word FROM w),
j AS (SELECT e.doc_id, e.k, word, g.k IS NOT NULL AS gone FROM e LEFT JOIN g ON g.doc_id = e.doc_id AND g.k = e.k),
a AS (SELECT doc_id, count(*) AS n, count(*) FILTER (gone) AS removed, string_agg(word, ' ' ORDER BY k) FILTER (NOT gone) AS kept FROM j GROUP BY doc_id)
SELECT w.doc_id, coalesce(n, 0) AS n_words, coalesce(removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN a ON a.doc_id = w.doc_id
"""

DIFFERENCE_COVER_DEDUP = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(coalesce(text, '')) AS x FROM documents),
c AS (SELECT r, k, substr(x, 800 * k + 1, 1598) AS y FROM (SELECT r, x, unnest(range(strlen(x) // 800)) AS k FROM d)),
p AS (SELECT r, 400 * k + j AS i, md5_number(substr(y, 2 * j + 1, 800)) AS h FROM (SELECT r, k, y, unnest(range(strlen(y) // 2 - 399)) AS j FROM c)),
g AS (SELECT r, i, lag(i) OVER (PARTITION BY r ORDER BY i) AS before FROM (SELECT r, i, count(*) OVER (PARTITION BY h) AS n FROM p) WHERE n > 1),
k AS (SELECT r, i, sum(CASE WHEN i <= before + 400 THEN 0 ELSE 1 END) OVER (PARTITION BY r ORDER BY i) AS span FROM g),
s AS (SELECT r, min(i) AS low, max(i) + 400 AS high FROM k GROUP BY r, span),
b AS (SELECT r, low, high, lag(high, 1, 0) OVER (PARTITION BY r ORDER BY low) AS since FROM s),
a AS (SELECT r, sum(high - low) AS n, count(*) AS spans, string_agg(substr(x, 2 * since + 1, 2 * (low - since)), '' ORDER BY low) || substr(any_value(x), 2 * max(high) + 1) AS kept FROM b JOIN d USING (r) GROUP BY r)
SELECT doc_id, CAST(len(x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(coalesce(kept, x))) AS kept_sha256 FROM d LEFT JOIN a USING (r)
"""

BAND_JOIN = """
WITH bits AS (SELECT list(list_reduce(list_prepend(i::BIGINT, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) g(i)),
l AS (SELECT sale_id, line_no, item_id, quantity::BIGINT AS q, floor(100 * amount + 0.5)::BIGINT AS a FROM sale_lines WHERE sale_id IS NOT NULL AND item_id IS NOT NULL AND quantity <> 0 AND isfinite(amount)),
n AS (SELECT sale_id, line_no, item_id, CASE WHEN m >= 0 OR m % d = 0 THEN m // d ELSE m // d - 1 END AS u, sale_id || ',' || coalesce(line_no::VARCHAR, '') || ',' || item_id AS s FROM (SELECT *, (2 * a + q) * sign(q) AS m, abs(2 * q) AS d FROM l)),
c AS (SELECT n.*, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, strlen(s) + 1), lambda i: ascii(substr(s, i, 1))::BIGINT)), lambda h, b: xor(h >> 8, t[(xor(h, b) & 255) + 1])), 4294967295) AS crc FROM n, bits),
i AS (SELECT row_number() OVER () AS r, item_id, CASE WHEN isfinite(price) THEN floor(100 * price + 0.5)::BIGINT END AS p FROM items),
j AS (SELECT r, abs(u - p) AS gap, u, sale_id, line_no::BIGINT AS line_no, c.item_id AS line_item_id, crc FROM i JOIN c ON c.u BETWEEN p - greatest(10, p // 500) AND p + greatest(10, p // 500) WHERE c.item_id <> i.item_id AND (abs(u - p) <= 10 OR 1000 * abs(u - p) <= 2 * p)),
o AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY gap, u, sale_id, line_no NULLS LAST, line_item_id) AS k FROM j QUALIFY k <= 5),
t AS (SELECT r, count(*) AS n, sum(gap)::BIGINT AS g, sum(crc)::BIGINT AS x FROM j GROUP BY r)
SELECT i.item_id, coalesce(k, 0)::INT AS rank, gap, u, sale_id, line_no, line_item_id, coalesce(n, 0) AS n_pairs, coalesce(g, 0) AS gap_sum, coalesce(x, 0) AS lines_crc FROM i LEFT JOIN t USING (r) LEFT JOIN o USING (r)
"""

ORACLES = {"op4_cell_near_dedup": CELL_NEAR_DEDUP, "op5_prefix_tree_join": PREFIX_TREE_JOIN, "op6_difference_cover_dedup": DIFFERENCE_COVER_DEDUP, "op8_doubling_windows": DOUBLING_WINDOWS, "op9_water_filling_mix": mixing.ORACLE, "op13_band_join": BAND_JOIN}
