"""DuckDB SQL that recomputes, by brute force, what a query returns."""

from __future__ import annotations

JACCARD = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS a
  FROM documents),
sh AS MATERIALIZED (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(a) = 0 THEN [] WHEN len(a) < 4 THEN [array_to_string(a, ' ')]
    ELSE list_transform(range(1, len(a) - 2), lambda i: array_to_string(a[i:i + 3], ' ')) END) AS s FROM w),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
links AS MATERIALIZED (
  SELECT p.a, p.b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM sh x JOIN sh y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2) p
  JOIN n na ON na.doc_id = p.a JOIN n nb ON nb.doc_id = p.b WHERE 100 * c >= 85 * (na.n + nb.n - c)),
reach AS (SELECT doc_id AS id, doc_id AS r FROM documents UNION SELECT l.b, reach.r FROM reach JOIN links l ON l.a = reach.id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.c AS component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT id, min(r) AS c FROM reach GROUP BY 1) m ON m.id = d.doc_id
"""

MIXING = r"""
WITH s AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size, md5(coalesce(CAST(doc_id AS VARCHAR), 'null ' || md5(coalesce(text, '')))) AS h FROM documents),
src AS (SELECT source, sum(size) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS sid FROM s GROUP BY source),
w AS (SELECT *, CASE sid % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0 ELSE 2.0 END AS w, 2.0::DOUBLE * source_size AS most FROM src),
f AS (SELECT *, 1.5::DOUBLE * sum(source_size) OVER () AS budget, sum(w) OVER () AS all_w,
  coalesce(sum(most) OVER o, 0) AS used, coalesce(sum(w) OVER o, 0) AS used_w FROM w
  WINDOW o AS (ORDER BY most / w, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
g AS (SELECT *, most / w <= (budget - used) / (all_w - used_w) AS capped FROM f),
h AS (SELECT *, sum(CASE WHEN capped THEN most ELSE 0 END) OVER () AS held, sum(CASE WHEN capped THEN w ELSE 0 END) OVER () AS held_w FROM g),
t AS MATERIALIZED (SELECT sid, source, source_size, CASE WHEN capped THEN most ELSE (budget - held) * w / (all_w - held_w) END AS target FROM h),
p AS MATERIALIZED (SELECT s.*, t.sid, t.source_size, t.target, CAST(round(t.target) AS BIGINT) AS take, row_number() OVER () AS rid,
  CAST(coalesce(sum(s.size) OVER (PARTITION BY t.sid ORDER BY s.h, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS pos
  FROM s JOIN t ON s.source IS NOT DISTINCT FROM t.source),
need AS (SELECT sid, CAST(ceil(CAST(round(target) AS BIGINT) / 1024::DOUBLE) AS BIGINT) AS blocks FROM t),
span AS MATERIALIZED (SELECT sid, blocks, sum(blocks) OVER o / greatest(1, sum(blocks) OVER ())::DOUBLE AS hi, coalesce((sum(blocks) OVER o - blocks) / greatest(1, sum(blocks) OVER ())::DOUBLE, 0) AS lo, sum(blocks) OVER () AS slots
  FROM need WHERE blocks > 0 WINDOW o AS (ORDER BY sid)),
point AS (SELECT i, (i >> 24) * FAR::DOUBLE + (i & 16777215) * GOLDEN::DOUBLE AS x FROM (SELECT unnest(range(0, CAST(max(slots) AS BIGINT))) AS i FROM span)),
drawn AS (SELECT i, sid, blocks, row_number() OVER (PARTITION BY sid ORDER BY i) - 1 AS block_no FROM (SELECT i, x - floor(x) AS x FROM point) JOIN span ON x >= lo AND x < hi),
got AS (SELECT sid, count(*) AS n FROM drawn GROUP BY 1),
late AS (SELECT sid, slots, unnest(range(coalesce(n, 0), blocks)) AS block_no FROM span LEFT JOIN got USING (sid)),
plan AS MATERIALIZED (SELECT sid, block_no, i AS slot FROM drawn WHERE block_no < blocks UNION ALL SELECT sid, block_no, CAST(slots AS BIGINT) + block_no FROM late),
part AS (SELECT rid, sid, c * CAST(source_size AS BIGINT) + pos AS a, least(c * CAST(source_size AS BIGINT) + pos + size, take) AS b FROM (SELECT *, unnest(range(0, CAST(greatest(0, (take - 1) // source_size) AS BIGINT) + 1)) AS c FROM p WHERE size > 0)),
frag AS (SELECT rid, sid, unnest(range(a // 1024, (b - 1) // 1024 + 1)) AS block_no FROM part WHERE a < b),
slot AS (SELECT rid, min(slot) AS first_slot, count(*) AS n_slots FROM frag JOIN plan USING (sid, block_no) GROUP BY 1)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(source_size AS BIGINT) AS source_size, CAST(target AS DOUBLE) AS target,
  CAST(CASE WHEN source_size = 0 THEN 0 ELSE size * (take // source_size) + greatest(0, least(pos + size, take % source_size) - pos) END AS BIGINT) AS taken,
  first_slot, coalesce(n_slots, 0) AS n_slots
FROM p LEFT JOIN slot USING (rid)
""".replace("GOLDEN", repr((5**0.5 - 1) / 2)).replace("FAR", repr(((5**0.5 - 1) / 2 * (1 << 24)) % 1.0))

DECONTAMINATION = r"""
WITH d AS MATERIALIZED (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS a FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS a FROM benchmark),
win AS MATERIALIZED (SELECT DISTINCT item_id, least(len(a), 13) AS len, unnest(list_transform(range(1, greatest(1, len(a) - 12) + 1), lambda i: array_to_string(a[i:i + 12], ' '))) AS s FROM b WHERE len(a) > 0),
lens AS (SELECT DISTINCT len FROM win),
occ AS MATERIALIZED (
  SELECT o.doc_id, o.i, o.len, win.item_id FROM (
    SELECT doc_id, len, unnest(range(1, len(a) - len + 2)) AS i, unnest(list_transform(range(1, len(a) - len + 2), lambda i: array_to_string(a[i:i + len - 1], ' '))) AS s FROM d, lens WHERE len(a) >= len) o
  JOIN win ON win.s = o.s AND win.len = o.len),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + len)) AS p FROM occ) GROUP BY 1),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM occ) GROUP BY 1),
wt AS (SELECT s, len, min(i) - 1 AS off, term FROM (SELECT s, len, unnest(string_split(s, ' ')) AS term, unnest(range(1, len + 1)) AS i FROM (SELECT DISTINCT s, len FROM win)) GROUP BY ALL),
vocab AS (SELECT DISTINCT term FROM wt),
dt AS MATERIALIZED (SELECT doc_id, term, pos, n FROM (SELECT doc_id, len(a) AS n, unnest(a) AS term, unnest(range(len(a))) AS pos FROM d) JOIN vocab USING (term)),
tc AS (SELECT term, count(*) AS n FROM dt GROUP BY 1),
keys AS (SELECT *, max(rank) OVER (PARTITION BY s) AS terms FROM (
  SELECT s, len, off, term, row_number() OVER (PARTITION BY s ORDER BY n, term) AS rank, bool_or(n IS NULL) OVER (PARTITION BY s) AS lost FROM wt LEFT JOIN tc USING (term)) WHERE NOT lost AND rank <= 2),
post AS MATERIALIZED (SELECT doc_id, s, pos - off AS start, rank, terms FROM dt JOIN keys USING (term) WHERE pos - off >= 0 AND pos - off + len <= dt.n),
near AS (SELECT doc_id, count(*) AS n_near FROM (
  SELECT DISTINCT f.doc_id, f.s, f.start FROM post f WHERE f.rank = 1 AND (f.terms = 1 OR EXISTS (SELECT 1 FROM post r WHERE r.rank = 2 AND r.doc_id = f.doc_id AND r.s = f.s AND r.start BETWEEN f.start - 2 AND f.start + 2))) GROUP BY 1)
SELECT doc_id, CAST(len(a) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(a) AS contaminated, coalesce(n_near, 0) AS n_near
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id) LEFT JOIN near USING (doc_id)
"""

NEAR_VECTORS = r"""
WITH RECURSIVE v AS MATERIALIZED (SELECT vec_id, CAST(embedding AS DOUBLE[64]) AS e FROM embeddings),
l AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND array_cosine_similarity(a.e, b.e) >= 0.9),
reach AS (SELECT vec_id AS id, vec_id AS r FROM v UNION SELECT l.b, reach.r FROM reach JOIN l ON l.a = reach.id)
SELECT v.vec_id, (SELECT count(*) FROM l WHERE l.a = v.vec_id) AS n_links, m.c AS component_id, m.c = v.vec_id AS kept
FROM v JOIN (SELECT id, min(r) AS c FROM reach GROUP BY 1) m ON m.id = v.vec_id
"""

LINE_SPREAD = r"""
WITH a AS (SELECT doc_id, source, text, string_split(text, chr(10)) AS a FROM documents),
l AS MATERIALIZED (SELECT doc_id, source, unnest(range(len(a))) AS pos, unnest(a) AS raw, trim(raw, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ') AS line FROM a),
b AS (SELECT line, min((doc_id IS NULL, doc_id, pos)) AS first FROM l WHERE line <> '' GROUP BY line HAVING count(DISTINCT coalesce('=' || source, 'null')) >= 5),
m AS (SELECT l.*, b.line IS NOT NULL AND (doc_id IS NULL, doc_id, pos) IS DISTINCT FROM b.first AS gone FROM l LEFT JOIN b USING (line)),
g AS (SELECT doc_id, count(*) FILTER (line <> '') AS n_lines, count(*) FILTER (gone) AS n_removed, string_agg(raw, chr(10) ORDER BY pos) FILTER (NOT gone) AS text FROM m GROUP BY doc_id)
SELECT documents.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, CASE WHEN documents.text IS NULL THEN NULL ELSE coalesce(g.text, '') END AS text
FROM documents LEFT JOIN g ON g.doc_id IS NOT DISTINCT FROM documents.doc_id
"""

LINE_SPREAD_TWO_SITES = LINE_SPREAD.replace(">= 5", ">= 2")


def oracle_sql() -> dict[str, str]:
    return {"op1_ngram_jaccard_join": JACCARD, "op2_mixing_sources": MIXING, "op4_decontamination": DECONTAMINATION, "op5_line_spread": LINE_SPREAD, "op5_line_spread_two_sites": LINE_SPREAD_TWO_SITES, "op7_cap_join": NEAR_VECTORS}
