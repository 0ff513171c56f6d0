"""Queries of the reference check over chat_messages and vector_store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.operators.references import Reference, latest_version, orphan_counts, orphan_references
from folioforge.session import table


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    chat = table(spark, sf_dir, "chat_messages")
    store = latest_version(
        table(spark, sf_dir, "vector_store").select("id", "ord", "create_time", F.col("metadata.documentid").alias("doc")),
        "id",
        "ord",
        ["doc", "create_time"],
    )
    return orphan_references(
        [
            Reference("chat_messages", chat, F.col("id"), F.col("document_id"), F.col("create_time")),
            Reference("vector_store", store, F.col("id"), F.col("doc"), F.col("create_time")),
        ],
        table(spark, sf_dir, "documents"),
        "doc_id",
        "create_time",
        table(spark, sf_dir, "deleted_documents"),
        "document_id",
    )


def p5_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphan_counts(p5_found(spark, sf_dir))


P5_SQL = """
WITH vs AS (
  SELECT id, metadata.documentid AS ref, create_time
  FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ord DESC) AS rn FROM vector_store WHERE id IS NOT NULL)
  WHERE rn = 1
), refs AS (
  SELECT 'chat_messages' AS table_name, CAST(id AS VARCHAR) AS row_key, document_id AS ref, create_time FROM chat_messages
  UNION ALL
  SELECT 'vector_store', id, ref, create_time FROM vs
), parents AS (SELECT doc_id, min(create_time) AS held_at FROM documents GROUP BY doc_id)
SELECT DISTINCT table_name, row_key,
  CASE WHEN p.doc_id IS NOT NULL THEN 'late'
       WHEN r.ref IN (SELECT document_id FROM deleted_documents WHERE document_id IS NOT NULL) THEN 'deleted'
       ELSE 'missing' END AS reason,
  strftime(create_time, '%Y-%m') AS period
FROM refs r LEFT JOIN parents p ON r.ref = p.doc_id
WHERE r.ref IS NOT NULL AND (p.doc_id IS NULL OR p.held_at > r.create_time)
"""

QUERIES = {"p5_found": p5_found, "p5_counts": p5_counts}
SQL = {
    "p5_found": P5_SQL,
    "p5_counts": f"SELECT table_name, period, reason, count(*) AS orphans FROM ({P5_SQL}) GROUP BY ALL",
}
