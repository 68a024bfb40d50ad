"""Queries of the operators for skewed keys and broken references."""

from pyspark.sql import functions as F

from cairn.catalog import table
from cairn.operators import references, skew


def p1_found(spark, d):
    return skew.frequent_keys(table(spark, d, "files")).select("hash")


def p1_totals(spark, d):
    return skew.key_totals(table(spark, d, "files"))


def p1_members(spark, d):
    return skew.members(table(spark, d, "files"))


def _three(spark, d):
    return (table(spark, d, t) for t in ("files", "classifications", "operations"))


def p5_found(spark, d):
    return references.broken_references(*_three(spark, d))


def p5_report(spark, d):
    return references.reference_report(*_three(spark, d))


SPARK = {f.__name__: f for f in (p1_found, p1_totals, p1_members, p5_found, p5_report)}

_TOTALS = """
SELECT hash, sum(n)::BIGINT AS n_rows, count(id) AS n_files,
       coalesce(sum(size) FILTER (id IS NOT NULL), 0)::BIGINT AS bytes, min(path) AS first_path, max(path) AS last_path
FROM (SELECT hash, id, count(*) AS n, max(size) AS size, min(path) AS path FROM files WHERE hash IS NOT NULL GROUP BY hash, id)
GROUP BY hash"""

_BROKEN = """
WITH refs AS (
  SELECT 'classifications' AS source_table, id AS row_id, file_id, classified_at AS t FROM classifications
  UNION ALL SELECT 'operations', id, file_id, executed_at FROM operations),
gone AS (SELECT DISTINCT file_id FROM operations WHERE action = 'DELETE' AND executed),
known AS (SELECT id, min(scanned_at) AS scanned_at FROM files GROUP BY id)
SELECT DISTINCT source_table, row_id, coalesce(strftime(t, '%Y-%m'), 'none') AS period,
  CASE WHEN known.id IS NULL AND gone.file_id IS NOT NULL THEN 'deleted' WHEN known.id IS NULL THEN 'missing' ELSE 'late' END AS reason
FROM refs LEFT JOIN known ON refs.file_id = known.id LEFT JOIN gone ON refs.file_id = gone.file_id
WHERE refs.file_id IS NOT NULL AND (known.id IS NULL OR known.scanned_at > t)"""

SQL = {
    "p1_found": "SELECT hash FROM files WHERE hash IS NOT NULL GROUP BY hash HAVING count(*) > 0.01 * (SELECT count(*) FROM files)",
    "p1_totals": _TOTALS,
    "p1_members": f"""
SELECT f.id, f.hash, f.path, f.deliveries, t.n_rows, t.n_files, t.bytes, t.first_path
FROM (SELECT id, hash, path, count(*) AS deliveries FROM files GROUP BY id, hash, path) f LEFT JOIN ({_TOTALS}) t ON f.hash = t.hash""",
    "p5_found": _BROKEN,
    "p5_report": f"SELECT source_table, period, reason, count(*) AS n FROM ({_BROKEN}) GROUP BY ALL",
}
