"""DuckDB SQL for the queries of this subpackage that SQL can express, on the same Parquet tables."""

from __future__ import annotations

LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP2 = rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex({LOWERED}, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN []
    WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s
  FROM words
), grams AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n_both, any_value(a.n) AS na, any_value(b.n) AS nb
  FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id < b.doc_id AND 10 * least(a.n, b.n) >= 9 * greatest(a.n, b.n)
  GROUP BY ALL
), links AS (SELECT a, b FROM shared WHERE 100 * n_both >= 90 * (na + nb - n_both)),
ends AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM reach r JOIN ends e ON r.b = e.a),
component AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a),
classes AS (SELECT doc_id, len(s) AS n, CASE WHEN len(s) = 0 THEN doc_id ELSE min(doc_id) OVER (PARTITION BY list_sort(s)) END AS class_id FROM sets),
partners AS (
  SELECT ca.class_id, count(DISTINCT cb.class_id) AS n_links
  FROM ends e JOIN classes ca ON ca.doc_id = e.a JOIN classes cb ON cb.doc_id = e.b
  WHERE ca.class_id <> cb.class_id GROUP BY 1
)
SELECT c.doc_id, CAST(c.n AS BIGINT) AS n_shingles, m.component_id, c.class_id, coalesce(p.n_links, 0) AS n_links
FROM classes c JOIN component m USING (doc_id) LEFT JOIN partners p ON p.class_id = c.class_id
"""

OP4 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes, sha1(body) AS h FROM p),
b AS (
  SELECT page_id, payload_bytes, h, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(
    ((('0x' || substr(h || '0', 1 + 5 * i // 4, 2))::INTEGER >> (3 - (5 * i) % 4)) & 31) AS INTEGER) + 1, 1)), '') AS payload_digest FROM d
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN page_id = max(page_id) OVER same THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = max(page_id) OVER same THEN NULL ELSE max(page_id) OVER same END AS refers_to
FROM b WINDOW same AS (PARTITION BY h)
"""

OP10 = f"""
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
  doc_id = max(doc_id) OVER same AS kept, sha256({LOWERED}) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY {LOWERED})
"""

OP11 = rf"""
WITH crc AS (
  SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) r(i)
  )
), rows AS (
  SELECT true AS of_docs, row_number() OVER () AS r, doc_id, {LOWERED} AS text FROM documents
  UNION ALL SELECT false, row_number() OVER (), NULL, {LOWERED} FROM benchmark
), words AS (SELECT of_docs, r, unnest(string_split_regex(text, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM rows),
counts AS (SELECT of_docs, r, w, count(*) AS n FROM words WHERE w <> '' GROUP BY ALL),
hashed AS (
  SELECT w, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, CAST(length(h) // 2 + 1 AS BIGINT)), lambda i: ('0x' || substr(h, 2 * i - 1, 2))::BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 10000 AS bucket
  FROM (SELECT DISTINCT w, hex(encode(w)) AS h FROM counts), crc
), sides AS (
  SELECT bucket, coalesce(sum(n) FILTER (of_docs), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (NOT of_docs), 0)::DOUBLE AS t FROM counts JOIN hashed USING (w) GROUP BY bucket
), gains AS (
  SELECT bucket, CAST(floor(1000 * ln((t + 1) * ((SELECT sum(s) FROM sides) + 10000) / ((s + 1) * ((SELECT sum(t) FROM sides) + 10000)))) AS BIGINT) AS gain FROM sides
), weighed AS (SELECT r, CAST(sum(n) AS BIGINT) AS n_features, CAST(sum(n * gain) AS BIGINT) AS weight FROM counts JOIN hashed USING (w) JOIN gains USING (bucket) WHERE of_docs GROUP BY r),
scored AS (
  SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score
  FROM rows LEFT JOIN weighed USING (r) WHERE of_docs
), placed AS (SELECT *, n_features >= 20 AS able, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS LAST, n_features, weight) AS place, count(*) OVER (PARTITION BY n_features >= 20) AS total FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN able AND place <= 10 * total // 100 THEN place END AS rank FROM placed
"""

OP12 = r"""
WITH RECURSIVE plain AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
    min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first FROM documents
), failing AS (
  SELECT doc_id, part, [len(w) < 100, 100 * len(list_distinct(w)) < 80 * len(w), 100 * (length(text) - length(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', ''))) > 10 * length(text), regexp_matches(text, '[#$%&*|]'), coalesce(doc_id > first, false)] AS f
  FROM plain
), known AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
masks AS (
  SELECT part, f, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM failing LEFT JOIN known USING (doc_id) GROUP BY ALL
), orders AS (
  SELECT '' AS o UNION ALL SELECT o || l FROM orders, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l) WHERE NOT contains(o, l)
), steps AS (SELECT o, s, ascii(o[s]) - 64 AS own, list_transform(string_split(o[1:s - 1], ''), lambda l: ascii(l) - 64) AS before FROM orders, range(1, 6) r(s) WHERE length(o) = 5),
met AS (
  SELECT part, o, s, own, n, good, toxic, f[own] AS fails, len(list_filter(before, lambda b: b > 0 AND f[b])) > 0 AS gone, len(list_filter(f, lambda x: x)) AS many FROM masks, steps
), out AS (
  SELECT part, o AS filter_order, s AS step, own, coalesce(sum(n) FILTER (NOT gone AND NOT fails), 0) AS kept, coalesce(sum(n) FILTER (NOT gone AND fails), 0) AS removed, coalesce(sum(n) FILTER (gone AND fails), 0) AS redundant,
    coalesce(sum(n) FILTER (fails AND many = 1), 0) AS unique_fails, coalesce(sum(good) FILTER (NOT gone AND fails), 0) AS good_lost, coalesce(sum(toxic) FILTER (NOT gone AND fails), 0) AS toxic_lost
  FROM met GROUP BY ALL
)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM out
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_ngram_jaccard_join": OP2, "op4_warc": OP4, "op10_exact_dedup": OP10, "op11_importance_resampling": OP11, "op12_filter_audit": OP12}
