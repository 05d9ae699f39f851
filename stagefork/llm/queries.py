"""The queries of this subpackage and their SQL, by name.

`url_rules`, `secret_base` and `mix_targets` are those columns of op4, op5 and op9 that
SQL can express; the operators' other columns are sampled or learnt.
"""

from __future__ import annotations

from . import ann, divergence, exact_dedup, fim, line_dedup, lm_score, mixing, pieces, quality, secrets, simhash, top_products, url_filter


def _columns(query, *names: str):
    return lambda spark, sf_dir: query(spark, sf_dir).select(*names)


QUERIES = {
    "op1_quality": quality.op1_quality,
    "op2_nearest": ann.op2_nearest,
    "op3_simhash": simhash.op3_simhash,
    "op4_url_filter": url_filter.op4_url_filter,
    "op5_secret_scan": secrets.op5_secret_scan,
    "op6_exact_dedup": exact_dedup.op6_exact_dedup,
    "op7_pieces": pieces.op7_pieces,
    "op8_lm_score": lm_score.op8_lm_score,
    "op9_mix": mixing.op9_mix,
    "op10_line_dedup": line_dedup.op10_line_dedup,
    "op11_top_products": top_products.op11_top_products,
    "op12_divergence": divergence.op12_divergence,
    "op13_fill_in_middle": fim.op13_fill_in_middle,
    "url_rules": _columns(url_filter.op4_url_filter, "page_id", "host", "path", "rule"),
    "secret_base": _columns(secrets.op5_secret_scan, "doc_id", "n_assign", "n_access", "n_hex", "base_sha256"),
    "mix_targets": _columns(mixing.op9_mix, "doc_id", "size", "source_size", "target"),
}
URL_SQL = r"""
WITH p AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (
  SELECT page_id, translate(regexp_extract(rest, '(?s)^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '(?s)^[^/?#]*([^?#]*)', 1) AS path FROM p),
r(name, start) AS (VALUES ('net', '/'), ('example.net', '/en/'), ('example.com', '/de/'), ('org', '/fr/'))
SELECT page_id, host, path,
       (SELECT arg_max(name || start, length(name || start)) FROM r
        WHERE (host = name OR ends_with(host, '.' || name)) AND starts_with(path, start)) AS rule
FROM h
"""
SECRET_SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS nr, coalesce(text, '') AS text FROM documents),
a AS (
  SELECT nr, 0 AS kind, regexp_extract_all(text, '(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9+/_.=-]+') AS own,
         [length(p) for p in regexp_split_to_array(text, '(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9+/_.=-]+')] AS gaps FROM d),
b AS (
  SELECT nr, 1 AS kind, regexp_extract_all(text, 'AKIA[A-Z0-9]{16,}') AS own, [length(p) for p in regexp_split_to_array(text, 'AKIA[A-Z0-9]{16,}')] AS gaps FROM d),
c AS (
  SELECT nr, 2 AS kind, regexp_extract_all(text, '[0-9a-f]{24,}') AS own, [length(p) for p in regexp_split_to_array(text, '[0-9a-f]{24,}')] AS gaps FROM d),
cut AS (
  SELECT nr, kind, unnest(own) AS own, unnest(gaps[1:len(own)]) AS gap, generate_subscripts(own, 1) AS nth
  FROM (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c) WHERE len(own) > 0),
placed AS (
  SELECT nr, kind, own, sum(gap + length(own)) OVER (PARTITION BY nr, kind ORDER BY nth) AS stop FROM cut),
kept AS (
  SELECT nr, kind, stop - length(own) AS start, stop FROM placed
  WHERE kind > 0 OR length(regexp_extract(own, '(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 1)) >= 6)
SELECT any_value(d.doc_id) AS doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
       sha256(coalesce(string_agg(['assign', 'access', 'hex'][kind + 1] || ':' || start::BIGINT || ':' || stop::BIGINT, ',' ORDER BY start, kind), '')) AS base_sha256
FROM d LEFT JOIN kept k ON d.nr = k.nr GROUP BY d.nr
"""
MIX_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size, [5.0, 2.0, 1.0][1 + ((row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3)::INT]::DOUBLE AS weight
  FROM d GROUP BY source),
t(step, held, targets) AS (
  SELECT 0, []::VARCHAR[], NULL::DOUBLE
  UNION ALL
  SELECT step + 1, h.held, NULL FROM t, LATERAL (
    SELECT list_distinct(t.held || list(coalesce('+' || source, '-')) FILTER (share > 3.0 * source_size)) AS held
    FROM (SELECT *, ((SELECT sum(source_size) FROM s) - coalesce((SELECT sum(3.0 * source_size) FROM s WHERE list_contains(t.held, coalesce('+' || source, '-'))), 0))
                  * weight / (SELECT sum(weight) FROM s WHERE NOT list_contains(t.held, coalesce('+' || source, '-'))) AS share
          FROM s WHERE NOT list_contains(t.held, coalesce('+' || source, '-')))) h
  WHERE len(h.held) > len(t.held)),
f AS (SELECT held FROM t ORDER BY step DESC LIMIT 1),
g AS (
  SELECT s.*, CASE WHEN list_contains(f.held, coalesce('+' || source, '-')) THEN 3.0 * source_size
    ELSE ((SELECT sum(source_size) FROM s) - coalesce((SELECT sum(3.0 * source_size) FROM s WHERE list_contains(f.held, coalesce('+' || source, '-'))), 0)) * weight
         / (SELECT sum(weight) FROM s WHERE NOT list_contains(f.held, coalesce('+' || source, '-'))) END::DOUBLE AS target
  FROM s, f)
SELECT doc_id, size, source_size, target FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source
"""
SQL = {
    "op6_exact_dedup": exact_dedup.OP6_SQL,
    "op11_top_products": top_products.OP11_SQL,
    "op12_divergence": divergence.OP12_SQL,
    "op13_fill_in_middle": fim.OP13_SQL,
    "url_rules": URL_SQL,
    "secret_base": SECRET_SQL,
    "mix_targets": MIX_SQL,
}
