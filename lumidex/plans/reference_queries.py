"""Queries on orphan references (problem 5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lumidex.operators.references import index_references, reference_report
from lumidex.session import table


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return index_references(table(spark, folder, "files"), table(spark, folder, "chunks"), table(spark, folder, "vec_chunks"))


def p5_report(spark: SparkSession, folder: str) -> DataFrame:
    return reference_report(p5_found(spark, folder))


FOUND_SQL = """
WITH f AS (SELECT id, min(indexed_at) AS arrival, max(struct_pack(t := indexed_at, s := lower(trim(status)))).s AS state
           FROM files WHERE id IS NOT NULL GROUP BY id),
     k AS (SELECT id, min(indexed_at) AS arrival FROM chunks WHERE id IS NOT NULL GROUP BY id),
     r AS (SELECT 'chunks' AS ref_table, c.id AS row_id, c.indexed_at AS happened,
                  CASE WHEN f.id IS NULL THEN 'missing' WHEN f.state = 'orphaned' THEN 'deleted'
                       WHEN f.arrival > c.indexed_at THEN 'late' END AS reason
           FROM chunks c LEFT JOIN f ON c.file_id = f.id WHERE c.file_id IS NOT NULL
           UNION ALL
           SELECT 'vec_chunks', v.chunk_id, v.embedded_at,
                  CASE WHEN k.id IS NULL THEN 'missing' WHEN k.arrival > v.embedded_at THEN 'late' END
           FROM vec_chunks v LEFT JOIN k ON v.chunk_id = k.id WHERE v.chunk_id IS NOT NULL)
SELECT DISTINCT ref_table, row_id, reason, strftime(happened, '%Y-%m') AS period FROM r WHERE reason IS NOT NULL
"""

QUERIES = {"p5_found": p5_found, "p5_report": p5_report}
ORACLES = {
    "p5_found": FOUND_SQL,
    "p5_report": f"SELECT ref_table, period, reason, count(*) AS n_rows FROM ({FOUND_SQL}) GROUP BY ALL",
}
