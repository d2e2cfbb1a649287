"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

from tidewake.llm import mixing, secret_scan

_W = mixing.WEIGHTS
OP2 = f"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, 'null') || ':' || md5(coalesce(text, ''))), 1, 15))::BIGINT >> {60 - mixing.BITS * mixing.LEVELS} AS p FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, source_size * {mixing.CAP} AS cap, sum(source_size) OVER () AS total,
        CASE (row_number() OVER (ORDER BY source IS NULL, source) - 1) % {len(_W)} {' '.join(f'WHEN {k} THEN {x}' for k, x in enumerate(_W))} END AS weight FROM s),
r AS (SELECT *, coalesce(sum(cap) OVER (ORDER BY cap / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
        sum(weight) OVER (ORDER BY cap / weight, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights FROM w),
f AS (SELECT before, weights FROM r WHERE (total - before) * weight <= cap * weights ORDER BY cap / weight, before, weights LIMIT 1),
t AS (SELECT r.source, source_size, coalesce(least(cap::DOUBLE, (weight * (total - f.before))::DOUBLE / f.weights), 0.0) AS target FROM r LEFT JOIN f ON true),
q AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS passes FROM t),
g AS (SELECT source, p, sum(size) AS n FROM d GROUP BY source, p),
c AS (SELECT g.source, p, n, coalesce(sum(n) OVER (PARTITION BY g.source ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c FROM g),
e AS (SELECT c.source, max(p) AS p, arg_max(c, p) AS c, arg_max(n, p) AS n, any_value(target - passes * source_size) AS rest
      FROM c JOIN q ON c.source IS NOT DISTINCT FROM q.source WHERE c.c <= target - passes * source_size GROUP BY c.source),
l AS (SELECT source, p + CASE WHEN (rest - c) * 2 >= n THEN 1 ELSE 0 END AS below FROM e)
SELECT d.doc_id, d.size, q.source_size, q.target, (d.size * (q.passes + CASE WHEN d.p < coalesce(l.below, 0) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source LEFT JOIN l ON d.source IS NOT DISTINCT FROM l.source
"""

OP4 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
h AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
        ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM h GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM h a JOIN h b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
e AS (SELECT a, b, c, x.n AS na, y.n AS nb FROM c JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 5 * c >= 4 * (x.n + y.n - c)),
r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
k AS (SELECT a, min(b) AS m FROM r GROUP BY a),
l AS (SELECT a, count(*) AS n_links, min(b) FILTER (c = na AND c = nb) AS copy FROM e GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(l.copy, d.doc_id)) AS copy_id,
       least(d.doc_id, coalesce(k.m, d.doc_id)) AS class_id, coalesce(l.n_links, 0)::BIGINT AS n_links
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN l ON l.a = d.doc_id LEFT JOIN k ON k.a = d.doc_id
"""


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _kind(number: int, rule: secret_scan.Rule) -> str:
    p = _quoted(rule.pattern)
    size = f"length(regexp_extract(hit, {p}, {rule.group}))" if rule.group else "length(hit)"
    return f"""SELECT doc_id, {number} AS k, '{rule.kind}' AS kind, start, start + length(hit) AS stop FROM (
      SELECT doc_id, hits[i] AS hit, list_sum(list_transform(gaps[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda g: length(g))), 0) AS start
      FROM (SELECT doc_id, hits, gaps, unnest(range(1, len(hits) + 1)) AS i FROM (
        SELECT doc_id, regexp_extract_all(coalesce(text, ''), {p}) AS hits, string_split_regex(coalesce(text, ''), {p}) AS gaps FROM documents))) WHERE {size} >= {rule.least}"""


OP5 = f"""
WITH s AS ({' UNION ALL '.join(_kind(k, r) for k, r in enumerate(secret_scan.RULES))}),
g AS (SELECT doc_id, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
  string_agg(concat_ws(':', kind, start::BIGINT, stop::BIGINT), ',' ORDER BY start, k) FILTER (k < {len(secret_scan.BASE)}) AS base,
  string_agg(concat_ws(':', kind, start::BIGINT, stop::BIGINT), ',' ORDER BY start, k) AS spans FROM s GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM documents d LEFT JOIN g USING (doc_id)
"""

OP6 = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.98),
r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
k AS (SELECT a, min(b) AS m FROM r GROUP BY a),
l AS (SELECT a, count(*) AS n FROM e GROUP BY a)
SELECT x.vec_id, coalesce(l.n, 0)::BIGINT AS n_links, least(x.vec_id, coalesce(k.m, x.vec_id)) AS component_id, least(x.vec_id, coalesce(k.m, x.vec_id)) = x.vec_id AS kept
FROM embeddings x LEFT JOIN l ON l.a = x.vec_id LEFT JOIN k ON k.a = x.vec_id
"""

OP10 = """
WITH p AS (SELECT page_id, sha256(coalesce(html, '')) AS payload_digest, strlen(coalesce(html, ''))::BIGINT AS payload_bytes FROM pages),
q AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to FROM q
"""

ORACLES = {"op2_mix_sources": OP2, "op4_ngram_join": OP4, "op5_secret_scan": OP5, "op6_embedding_near_dedup": OP6, "op10_warc_archive": OP10}
