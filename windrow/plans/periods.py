"""Problem 2 over the project's tables: continuous prophage periods and the gaps between them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from windrow.operators.intervals import prophage_periods


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return prophage_periods(spark.read.parquet(f"{d}/known_prophages.parquet"))


def p2_summary(spark: SparkSession, d: str) -> DataFrame:
    """Covered and uncovered bases per accession number."""
    rows = p2_found(spark, d)
    size = F.col("end") - F.col("start")
    return rows.groupBy("accession_no").agg(
        F.countDistinct("ncbi_id").alias("contigs"), F.count_if(F.col("kind") == "period").alias("periods"), F.count_if(F.col("kind") == "gap").alias("gaps"),
        F.sum(F.when(F.col("kind") == "period", size).otherwise(0)).alias("covered"), F.sum(F.when(F.col("kind") == "gap", size).otherwise(0)).alias("uncovered"),
    )


_FOUND = r"""
WITH named AS (
  SELECT regexp_extract(assembly, '(?:^|[^0-9])([0-9]{9})(?:[^0-9]|$)', 1) AS accession_no,
         upper(regexp_replace(ncbi_id, '^\s+|\s+$', '', 'g')) AS ncbi_id, least(start, "end") AS s, greatest(start, "end") AS e
  FROM known_prophages WHERE assembly IS NOT NULL AND ncbi_id IS NOT NULL AND start IS NOT NULL AND "end" IS NOT NULL
), kept AS (SELECT * FROM named WHERE accession_no <> '' AND ncbi_id <> '' AND s < e),
reach AS (SELECT *, max(e) OVER (PARTITION BY accession_no, ncbi_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM kept),
pieces AS (SELECT *, sum(CASE WHEN before IS NULL OR s > before THEN 1 ELSE 0 END) OVER (PARTITION BY accession_no, ncbi_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS piece FROM reach),
periods AS (SELECT accession_no, ncbi_id, min(s) AS s, max(e) AS e FROM pieces GROUP BY accession_no, ncbi_id, piece),
gaps AS (SELECT accession_no, ncbi_id, e AS s, lead(s) OVER (PARTITION BY accession_no, ncbi_id ORDER BY s) AS e FROM periods),
found AS (
  SELECT 'period' AS kind, accession_no, ncbi_id, s AS start, e AS "end" FROM periods
  UNION ALL SELECT 'gap', accession_no, ncbi_id, s, e FROM gaps WHERE e IS NOT NULL
)
"""

QUERIES = {"p2_found": p2_found, "p2_summary": p2_summary}
SQL = {
    "p2_found": _FOUND + 'SELECT kind, accession_no, ncbi_id, start, "end" FROM found',
    "p2_summary": _FOUND + """SELECT accession_no, count(DISTINCT ncbi_id) AS contigs, count(*) FILTER (kind = 'period') AS periods, count(*) FILTER (kind = 'gap') AS gaps,
  CAST(sum(CASE WHEN kind = 'period' THEN "end" - start ELSE 0 END) AS BIGINT) AS covered, CAST(sum(CASE WHEN kind = 'gap' THEN "end" - start ELSE 0 END) AS BIGINT) AS uncovered
  FROM found GROUP BY accession_no""",
}
