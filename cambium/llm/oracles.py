"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), {AZ}), '[^\x20\x09-\x0D]+')"


def near_sql(k: int, table: str = "documents", name: str = "near") -> str:
    """CTEs up to {name}(doc_id, n_shingles, component_id, kept), for a WITH RECURSIVE."""
    return f"""
{name}_words AS (SELECT doc_id, {WORDS} AS w FROM {table}),
{name}_shingles AS (
  SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {k} THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - {k} + 2), lambda i: array_to_string(w[i:i + {k} - 1], ' ')) END)) AS s FROM {name}_words),
{name}_size AS (SELECT doc_id, count(*) AS n FROM {name}_shingles GROUP BY doc_id),
{name}_common AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM {name}_shingles a JOIN {name}_shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
{name}_links AS (
  SELECT x, y FROM {name}_common JOIN {name}_size p ON p.doc_id = x JOIN {name}_size q ON q.doc_id = y WHERE 100 * c >= 80 * (p.n + q.n - c)),
{name}_both AS (SELECT x, y FROM {name}_links UNION ALL SELECT y, x FROM {name}_links),
{name}_reach AS (
  SELECT doc_id, doc_id AS r FROM {table} UNION SELECT e.y, t.r FROM {name}_reach t JOIN {name}_both e ON e.x = t.doc_id WHERE t.r < e.y),
{name}_least AS (SELECT doc_id, min(r) AS component_id FROM {name}_reach GROUP BY doc_id),
{name} AS (
  SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, component_id = d.doc_id AS kept
  FROM {table} d JOIN {name}_least USING (doc_id) LEFT JOIN {name}_size USING (doc_id))"""


REPEATS = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, i, md5(substr(h, 2 * i + 1, 400)) AS m FROM (SELECT doc_id, h, unnest(range(0, CAST(greatest(len(h) / 2 - 199, 0) AS BIGINT))) AS i FROM d)),
twice AS (SELECT m FROM w GROUP BY m HAVING count(*) > 1),
hit AS (SELECT doc_id, i, coalesce(i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 200, true) AS opens FROM w SEMI JOIN twice USING (m)),
runs AS (SELECT doc_id, i, sum(CAST(opens AS INT)) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM hit),
spans AS (SELECT doc_id, min(i) AS a, max(i) + 200 AS b FROM runs GROUP BY doc_id, run),
gaps AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS z FROM spans),
cut AS (SELECT doc_id, sum(b - a) AS n, count(*) AS k, string_agg(substr(h, 2 * z + 1, 2 * (a - z)), '' ORDER BY a) || substr(any_value(h), 2 * max(b) + 1) AS kept FROM gaps JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, CAST(len(h) / 2 AS BIGINT) AS n_bytes, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, CAST(coalesce(k, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM d LEFT JOIN cut USING (doc_id)"""

ORACLES = {"op3_suffix_array_dedup": REPEATS, "op1_minhash_near_dedup": f"WITH RECURSIVE {near_sql(4)}\nSELECT * FROM near"}
