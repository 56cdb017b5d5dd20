"""Results of queries stated in SQL, for those that SQL can express."""

from __future__ import annotations

from .line_dedup import ORACLE as LINES

_COMPONENTS = """
sym AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT a, b FROM sym UNION SELECT r.a, s.b FROM reach r JOIN sym s ON r.b = s.a),
comp AS (SELECT a AS id, least(a, min(b)) AS component_id FROM reach GROUP BY a)
"""

NGRAM = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, list_slice(w, k, k + 3) AS g FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(1, len(w) - 3))) AS k FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
h AS (SELECT doc_id, md5_number_lower(array_to_string(g, ' ')) AS g FROM s),
o AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM h x JOIN h y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM o JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 85 * (p.n + q.n - c)),
{_COMPONENTS}
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(component_id, d.doc_id) AS component_id
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN comp ON comp.id = d.doc_id
"""

_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

DECONTAMINATION = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS item, {_WORDS} AS w FROM benchmark),
p AS (SELECT DISTINCT item, least(10, len(w)) AS n, array_to_string(list_slice(w, k, k + 9), ' ') AS g FROM (SELECT *, unnest(generate_series(1, greatest(1, len(w) - 9))) AS k FROM i WHERE len(w) > 0)),
l AS (SELECT DISTINCT n FROM p),
g AS (SELECT r, n, k, array_to_string(list_slice(w, k, k + n - 1), ' ') AS g FROM (SELECT r, w, n, unnest(generate_series(1, len(w) - n + 1)) AS k FROM d JOIN l ON n <= len(w))),
m AS (SELECT g.r, g.k, g.n, p.item FROM g JOIN p ON g.n = p.n AND g.g = p.g),
h AS (SELECT r, count(DISTINCT pos) AS n_hit FROM (SELECT r, unnest(generate_series(k, k + n - 1)) AS pos FROM m) GROUP BY r),
t AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM m) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h ON h.r = d.r LEFT JOIN t ON t.r = d.r
"""

WARC = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS g FROM pages),
f AS (SELECT g, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY g HAVING count(*) > 1)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, p.g AS payload_digest,
       CASE WHEN first IS NOT NULL AND first IS DISTINCT FROM page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first IS DISTINCT FROM page_id THEN first END AS refers_to
FROM p LEFT JOIN f ON p.g = f.g AND p.n >= 100
"""

EMBEDDING = f"""
WITH RECURSIVE v AS (SELECT row_number() OVER () AS r, vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
ok AS (SELECT * FROM v WHERE vec_id IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
near AS (SELECT x.r AS ra, y.r AS rb, x.vec_id AS a, y.vec_id AS b FROM ok x JOIN ok y ON x.r < y.r AND len(x.e) = len(y.e) WHERE list_cosine_similarity(x.e, y.e) >= 0.95),
n AS (SELECT r, count(*) AS n FROM (SELECT ra AS r FROM near UNION ALL SELECT rb FROM near) GROUP BY r),
links AS (SELECT DISTINCT a, b FROM near WHERE a <> b),
{_COMPONENTS}
SELECT vec_id, coalesce(n.n, 0) AS n_links, coalesce(component_id, vec_id) AS component_id, coalesce(component_id, vec_id) IS NOT DISTINCT FROM vec_id AS kept
FROM v LEFT JOIN n ON n.r = v.r LEFT JOIN comp ON comp.id = v.vec_id
"""

ORACLE = {
    "op2_ngram_jaccard": NGRAM,
    "op3_benchmark_decontamination": DECONTAMINATION,
    "op7_warc": WARC,
    "op8_line_dedup": LINES,
    "op9_embedding_dedup": EMBEDDING,
}
