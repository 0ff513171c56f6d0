"""Queries of the operators for training text, and SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.llm.conversations import conversations, dropped_sessions
from folioforge.llm.leakage import leaked_items
from folioforge.llm.messages import BLANKS, PLACEHOLDERS, ROLES
from folioforge.llm.mixing import mixture, mixture_report, sampled_shares
from folioforge.llm.neighbours import nearest_vectors, similar_pairs
from folioforge.llm.pairs import broken_pairs
from folioforge.llm.scanned import page_noise, repaired_pages
from folioforge.llm.sentences import sentences
from folioforge.operators.vectors import current_rows
from folioforge.session import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return broken_pairs(table(spark, sf_dir, "chat_messages"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dropped_sessions(table(spark, sf_dir, "chat_messages"))


def p2_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations(table(spark, sf_dir, "chat_messages"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = table(spark, sf_dir, "vector_store")
    rows = current_rows(store, "id", "ord", {"doc": F.col("metadata.documentid"), "embedding": F.col("embedding")})
    return similar_pairs(nearest_vectors(rows, fit_on=store, expected=store.count()))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_noise(table(spark, sf_dir, "documents")).select("doc_id", "line_no", "defect").distinct()


def p4_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repaired_pages(table(spark, sf_dir, "documents"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaked_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items")).select("doc_id", "item_id")


def p6_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per item how many documents hold it, and the largest share."""
    found = leaked_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))
    return found.groupBy("item_id").agg(F.count("doc_id").alias("documents"), F.round(F.max("share"), 6).alias("largest_share"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = mixture_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))
    return report.filter("short").select("source")


def p7_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


def p7_sampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shares that a drawn mixture holds, against the targets."""
    drawn = sampled_shares(mixture(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets")))
    targets = table(spark, sf_dir, "mix_targets").select("source", "target_share")
    return drawn.join(targets, "source", "left")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences(table(spark, sf_dir, "documents"))


def _listed(values: list[str]) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


_TRIM = f"'{BLANKS}'"
_ROLE = "CASE " + " ".join(
    f"WHEN lower(trim(role, {_TRIM})) IN ({_listed(names)}) THEN '{role}'" for role, names in ROLES.items()
) + " ELSE 'unreadable' END"
_SAYS = (
    r"coalesce(regexp_matches(content, '[\p{L}\p{N}]') AND trim(lower(regexp_replace(content, '[^\p{L}\p{M}\p{N}/ ]+', '', 'g')), "
    + _TRIM + f") NOT IN ({_listed(PLACEHOLDERS)}), false)"
)
P2_VERDICTS = f"""
WITH rows AS (
  SELECT DISTINCT lower(trim(session_id, {_TRIM})) AS session, id, {_ROLE} AS role, content, create_time AS sent, {_SAYS} AS says
  FROM chat_messages WHERE session_id IS NOT NULL
), kept AS (
  SELECT *, lag(role) OVER w AS before, lead(role) OVER w AS after, row_number() OVER w AS pos
  FROM rows WHERE role <> 'system' AND says
  WINDOW w AS (PARTITION BY session ORDER BY sent NULLS FIRST, id NULLS FIRST, role, content)
), facts AS (
  SELECT session, count(*) AS n,
    bool_or(role = 'unreadable' OR (role = 'assistant' AND (pos = 1 OR before = 'assistant'))) AS broken,
    bool_or(role = 'user' AND coalesce(after, '') <> 'assistant') AS missing
  FROM kept GROUP BY session
), verdicts AS (
  SELECT s.session AS session_id,
    CASE WHEN n IS NULL THEN 'empty' WHEN broken THEN 'broken' WHEN missing THEN 'missing_reply' END AS reason
  FROM (SELECT DISTINCT session FROM rows) s LEFT JOIN facts f ON s.session = f.session
)
"""

QUERIES = {
    "p1_found": p1_found,
    "p2_found": p2_found,
    "p2_conversations": p2_conversations,
    "p3_found": p3_found,
    "p4_found": p4_found,
    "p4_repaired": p4_repaired,
    "p6_found": p6_found,
    "p6_leaks": p6_leaks,
    "p7_found": p7_found,
    "p7_report": p7_report,
    "p7_sampled": p7_sampled,
    "p8_found": p8_found,
}
SQL = {
    "p2_found": P2_VERDICTS + "SELECT session_id, reason FROM verdicts WHERE reason IS NOT NULL",
    "p2_conversations": P2_VERDICTS + """SELECT k.session AS session_id, CAST(k.pos - 1 AS INTEGER) AS turn, k.role, k.content, k.id, k.sent AS create_time
        FROM kept k JOIN verdicts v ON k.session = v.session_id WHERE v.reason IS NULL""",
}
