"""The corpus operators' queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from shelfmark.llm import language_id, license_scan, ngram_join, order_minhash, packing, piece_codec, quality_rules, secret_scan, spelling, suffix_dedup, toxicity, url_filter, vector_codes
from shelfmark.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_join": lambda spark, d: ngram_join.join_components(table(spark, d, "documents")),
    "op2_secret_scan": lambda spark, d: secret_scan.scan_secrets(table(spark, d, "documents")),
    "op3_suffix_dedup": lambda spark, d: suffix_dedup.find_repeats(table(spark, d, "documents")),
    "op4_toxicity": lambda spark, d: toxicity.score_toxicity(table(spark, d, "documents"), table(spark, d, "labels")),
    "op5_piece_codec": lambda spark, d: piece_codec.piece_digests(table(spark, d, "documents")),
    "op6_order_minhash": lambda spark, d: order_minhash.edited_likeness(table(spark, d, "documents")),
    "op7_packing": lambda spark, d: packing.pack(table(spark, d, "documents")),
    "op8_language_id": lambda spark, d: language_id.predict_language(table(spark, d, "documents")),
    "op9_license_scan": lambda spark, d: license_scan.scan_licenses(table(spark, d, "documents")),
    "op10_quality_rules": lambda spark, d: quality_rules.judge(table(spark, d, "documents")),
    "op11_vector_codes": lambda spark, d: vector_codes.code_digests(table(spark, d, "embeddings")),
    "op12_spelling_variants": lambda spark, d: spelling.variants(table(spark, d, "documents")),
    "op13_url_filter": lambda spark, d: url_filter.judge_pages(table(spark, d, "pages")),
}

JOIN_SQL = r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE [array_to_string(w[i:i + 3], ' ') FOR i IN range(1, len(w) - 2)] END) AS sh FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * k >= 85 * (nx.n + ny.n - k)),
b AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
r AS (SELECT x AS node, x AS label FROM b UNION SELECT b.y, r.label FROM r JOIN b ON b.x = r.node WHERE r.label < b.y),
c AS (SELECT node, min(label) AS label FROM r GROUP BY node),
f AS (SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.label, w.doc_id) AS component_id FROM w LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.node = w.doc_id)
SELECT doc_id, CAST(n_shingles AS BIGINT) AS n_shingles, component_id, count(*) OVER (PARTITION BY component_id) AS n_in_component FROM f"""




def _codes_sql(rounds: int = 2) -> str:
    """Codebooks of 16 parts and 64 entries, a step for each round."""
    out = """WITH k AS (SELECT row_number() OVER (ORDER BY vec_id) AS i, vec_id, label, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT i, t.part, v[t.part * (len(v) // 16) + 1 : (t.part + 1) * (len(v) // 16)] AS q FROM k, range(16) t(part)),
c0 AS (SELECT part, i - 1 AS entry, q AS e FROM p WHERE i <= 64)"""
    for n in range(rounds + 1):
        out += f""",
a{n} AS MATERIALIZED (SELECT i, part, any_value(q) AS q, min(list_sum([(z[1] - z[2]) * (z[1] - z[2]) FOR z IN list_zip(q, e)]) * 64 + entry) AS best FROM p JOIN c{n} USING (part) GROUP BY i, part)"""
        if n < rounds:
            out += f""",
s{n} AS (SELECT part, entry, list(CAST((total - (total % n + n) % n) // n AS BIGINT) ORDER BY j) AS e FROM (SELECT part, best % 64 AS entry, j, sum(q[j]) AS total, count(*) AS n FROM a{n}, range(1, 65) t(j) WHERE j <= len(q) GROUP BY part, best % 64, j) GROUP BY part, entry),
c{n + 1} AS (SELECT part, entry, coalesce(s{n}.e, c{n}.e) AS e FROM c{n} LEFT JOIN s{n} USING (part, entry))"""
    return (
        out
        + f""",
r AS (SELECT i, string_agg(lpad(format('{{:x}}', CAST(best % 64 AS BIGINT)), 2, '0'), '' ORDER BY part) AS code, CAST(sum(best // 64) AS BIGINT) AS error FROM a{rounds} GROUP BY i)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, (SELECT sha256(string_agg(array_to_string(e, ','), ',' ORDER BY part, entry)) FROM c{rounds}) AS codebooks_sha256 FROM r JOIN k USING (i)"""
    )


#: crc32 by a table of 256 values that a rule makes; letters from U+00C0 on have two bytes.
SPELLING_SQL = r"""WITH RECURSIVE crc AS (SELECT list(v ORDER BY b) AS t FROM (SELECT b, list_reduce(list_prepend(b, range(8)), lambda c, _: CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END) AS v FROM range(256) x(b))),
raw AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS d, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS w FROM documents),
runs AS (SELECT d, w, count(*) AS n FROM (SELECT d, translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w FROM raw) WHERE length(w) >= 7 GROUP BY d, w),
bytes AS (SELECT w, n, flatten([CASE WHEN ord(c) < 128 THEN [CAST(ord(c) AS BIGINT)] ELSE [CAST(195 AS BIGINT), CAST(ord(c) - 64 AS BIGINT)] END FOR c IN string_split(d || ':' || w, '')]) AS b FROM runs),
hashed AS (SELECT w, n, xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), b), lambda c, x: xor(c // 256, t[xor(c % 256, x) + 1]))) AS h FROM bytes, crc),
v AS MATERIALIZED (SELECT w, CAST(sum(n) AS BIGINT) AS n FROM (SELECT n, CASE WHEN h % 31 = 0 THEN substring(w, 1, CAST(h % length(w) AS INT)) || substring(w, CAST(h % length(w) AS INT) + 2) ELSE w END AS w FROM hashed) WHERE length(w) >= 7 GROUP BY w HAVING sum(n) >= 2),
less AS MATERIALIZED (SELECT w, i, substring(w, 1, i - 1) || substring(w, i + 1) AS s FROM v, range(1, 1000) x(i) WHERE i <= length(w)),
near AS (SELECT a.w, b.w AS x FROM less a JOIN less b ON a.s = b.s AND a.i = b.i AND a.w <> b.w UNION SELECT less.w, v.w FROM less JOIN v ON v.w = less.s UNION SELECT v.w, less.w FROM less JOIN v ON v.w = less.s),
best AS (SELECT near.w, count(*) AS n_near, arg_min(v.w, (-v.n, v.w)) AS x, max(v.n) AS x_n FROM near JOIN v ON v.w = near.x GROUP BY near.w),
f AS MATERIALIZED (SELECT v.w, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN x_n >= 10 * v.n THEN x END AS form, CASE WHEN x_n >= 10 * v.n THEN x_n END AS form_n FROM v LEFT JOIN best USING (w)),
r AS (SELECT w, w AS root FROM f WHERE form IS NULL UNION ALL SELECT f.w, r.root FROM r JOIN f ON f.form = r.w)
SELECT f.w AS word, form, root, n, CAST(n_near AS BIGINT) AS n_near, CAST(form_n AS BIGINT) AS form_n FROM f JOIN r USING (w)"""

URL_SQL = r"""WITH p AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substring(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
rules(rh, rp, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow'))
SELECT page_id, host, path, (SELECT arg_max(rh || rp, length(rh || rp)) FROM rules WHERE (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)) AS rule,
coalesce((SELECT arg_max(v, length(rh || rp)) FROM rules WHERE (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)), 'allow') AS verdict FROM h"""

ORACLES: dict[str, str] = {"op1_ngram_join": JOIN_SQL, "op11_vector_codes": _codes_sql(), "op12_spelling_variants": SPELLING_SQL, "op13_url_filter": URL_SQL}
