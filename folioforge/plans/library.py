"""Notebooks, documents and their owners: scoped reads, updates, cascades, validation, ingest and questions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.functions.text import is_blank, route_ids
from folioforge.operators import catalog, chunking, models
from folioforge.operators.cleaning import clean
from folioforge.plans.text import INGESTED
from folioforge.session import table

NOTEBOOK, USER = 7, 3


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").withColumnRenamed("doc_id", "id")


def _tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {
        "notebooks": table(spark, sf_dir, "notebooks"),
        "documents": _documents(spark, sf_dir),
        "vectors": table(spark, sf_dir, "vector_store"),
        "messages": table(spark, sf_dir, "chat_messages"),
    }


def notebooks_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.newest_first(table(spark, sf_dir, "notebooks")).select("id", "name")


def notebook_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.newest_first(catalog.owned(_documents(spark, sf_dir), "notebook_id", NOTEBOOK)).select("id", "title")


def owned_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order of the customers of one nation: children reached only through parents that are owned."""
    rows = catalog.children_of_owned(table(spark, sf_dir, "orders"), "o_custkey", table(spark, sf_dir, "customer"), "c_custkey", "c_nationkey", USER)
    return rows.select("o_orderkey", "o_custkey")


def owner_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose notebook exists."""
    documents, notebooks = _documents(spark, sf_dir), table(spark, sf_dir, "notebooks")
    return documents.join(notebooks.select(F.col("id").alias("n")), F.col("notebook_id") == F.col("n"), "left_semi").select("id", "notebook_id")


def usernames_repeated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.repeated_keys(table(spark, sf_dir, "users"), "username")


def cascade_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of each table after all logged deletions."""
    gone = table(spark, sf_dir, "deleted_documents").select(F.col("document_id").alias("id"))
    after = catalog.delete_document(_tables(spark, sf_dir), gone)
    return _keys(after)


def cascade_notebook(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _keys(catalog.delete_notebook(_tables(spark, sf_dir), NOTEBOOK))


def cascade_notebook_web(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _keys(catalog.delete_notebook(_tables(spark, sf_dir), NOTEBOOK, "web"))


def _keys(tables: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, rows in tables.items():
        part = rows.select(F.lit(name).alias("table_name"), F.col("id").cast("string").alias("row_key"))
        out = part if out is None else out.unionByName(part)
    return out


def users_shown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users without what may not be shown."""
    return catalog.without(table(spark, sf_dir, "users"), "password", "email")


def update_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing summaries set from a delta."""
    documents = _documents(spark, sf_dir)
    delta = documents.filter(is_blank(F.col("summary"))).select("id", F.lit(models.GENERATING).alias("summary"))
    return catalog.update_columns(documents.select("id", "title", "summary"), "id", delta, ["summary"])


def validate_notebooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    name, text = F.col("name"), F.col("description")
    rules = {
        "name": [("must not be blank", ~is_blank(name)), ("must have no outer blanks", F.rtrim(name) == name)],
        "description": [("must not be blank", ~is_blank(text)), ("too long", F.length(F.coalesce(text, F.lit(""))) <= 500)],
    }
    return catalog.validation_errors(table(spark, sf_dir, "notebooks"), rules).select("id", "errors")


def routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    route = F.concat(F.lit("#notebook/"), F.coalesce(F.col("notebook_id").cast("string"), F.lit("x")), F.lit("/document/"), F.col("id").cast("string"))
    return _documents(spark, sf_dir).select("id", route_ids(route).alias("r")).select("id", "r.notebook", "r.document")


def session_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "chat_messages").filter(F.col("session_id").isNotNull()).groupBy("session_id").agg(F.count(F.lit(1)).alias("messages"))


def ingest_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uploaded contents cleaned, split and embedded: (id, length, norm) of every chunk."""
    documents = clean(_documents(spark, sf_dir).filter(F.col("content").isNotNull()), "content", "desktop")
    chunks = chunking.semantic_chunks(documents, "id", "content")
    vector = models.embed(F.col("text"))
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x * x))
    return chunks.select("id", F.length("text").alias("length"), F.round(norm, 3).alias("norm"))


def summarise_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summaries by the offline model, or the fixed text where none is made."""
    rows = models.summarised(_documents(spark, sf_dir).drop("summary"), "content")
    return rows.select("id", F.md5("summary").alias("summary"))


_DOCS = "(SELECT doc_id AS id, * EXCLUDE (doc_id) FROM documents)"
_GONE = "(SELECT document_id FROM deleted_documents WHERE document_id IS NOT NULL)"
_IN7 = "(SELECT doc_id FROM documents WHERE notebook_id = 7)"
_BLANK = "trim(coalesce({0}, ''), ' ' || chr(9) || chr(10) || chr(13) || chr(12288)) = ''"

QUERIES = {
    f.__name__: f
    for f in (
        notebooks_newest, notebook_documents, owned_orders, owner_exists, usernames_repeated, cascade_documents, cascade_notebook,
        cascade_notebook_web, users_shown, update_summaries, validate_notebooks, routes, session_counts, ingest_documents, summarise_documents,
    )
}
SQL = {
    "notebooks_newest": "SELECT id, name FROM notebooks ORDER BY create_time DESC, id DESC",
    "notebook_documents": "SELECT doc_id AS id, title FROM documents WHERE notebook_id = 7 ORDER BY create_time DESC, doc_id DESC",
    "owned_orders": f"SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = {USER})",
    "owner_exists": "SELECT doc_id AS id, notebook_id FROM documents WHERE notebook_id IN (SELECT id FROM notebooks)",
    "usernames_repeated": "SELECT username, count(*) AS rows FROM users WHERE username IS NOT NULL GROUP BY 1 HAVING count(*) > 1",
    "cascade_documents": f"""SELECT 'vectors' AS table_name, id AS row_key FROM vector_store WHERE metadata IS NOT NULL AND (metadata.documentid IS NULL OR metadata.documentid NOT IN {_GONE})
        UNION ALL SELECT 'messages', CAST(id AS VARCHAR) FROM chat_messages WHERE document_id IS NULL OR document_id NOT IN {_GONE}
        UNION ALL SELECT 'documents', CAST(doc_id AS VARCHAR) FROM documents WHERE doc_id NOT IN {_GONE}""",
    "cascade_notebook": f"""SELECT 'notebooks' AS table_name, CAST(id AS VARCHAR) AS row_key FROM notebooks WHERE id <> 7
        UNION ALL SELECT 'documents', CAST(doc_id AS VARCHAR) FROM documents WHERE notebook_id IS DISTINCT FROM 7
        UNION ALL SELECT 'vectors', id FROM vector_store WHERE metadata IS NOT NULL AND (metadata.documentid IS NULL OR metadata.documentid NOT IN {_IN7})
        UNION ALL SELECT 'messages', CAST(id AS VARCHAR) FROM chat_messages WHERE (document_id IS NULL OR document_id NOT IN {_IN7}) AND NOT (document_id IS NULL AND notebook_id IS NOT DISTINCT FROM 7)""",
    "cascade_notebook_web": f"""SELECT 'notebooks' AS table_name, CAST(id AS VARCHAR) AS row_key FROM notebooks WHERE id <> 7
        UNION ALL SELECT 'documents', CAST(doc_id AS VARCHAR) FROM documents WHERE notebook_id IS DISTINCT FROM 7
        UNION ALL SELECT 'vectors', id FROM vector_store WHERE metadata IS NOT NULL AND (metadata.documentid IS NULL OR metadata.documentid NOT IN {_IN7})
        UNION ALL SELECT 'messages', CAST(id AS VARCHAR) FROM chat_messages WHERE NOT (document_id IS NULL AND notebook_id IS NOT DISTINCT FROM 7)""",
    "users_shown": "SELECT id, username FROM users",
    "update_summaries": f"SELECT doc_id AS id, title, CASE WHEN {_BLANK.format('summary')} THEN '{models.GENERATING}' ELSE summary END AS summary FROM documents",
    "validate_notebooks": f"""SELECT id, concat_ws('; ', CASE WHEN {_BLANK.format('name')} THEN 'name: must not be blank' END, CASE WHEN rtrim(name) IS DISTINCT FROM name OR name IS NULL THEN 'name: must have no outer blanks' END,
        CASE WHEN {_BLANK.format('description')} THEN 'description: must not be blank' END, CASE WHEN length(coalesce(description, '')) > 500 THEN 'description: too long' END) AS errors FROM notebooks""",
    "routes": "SELECT doc_id AS id, notebook_id AS notebook, CASE WHEN notebook_id IS NOT NULL THEN doc_id END AS document FROM documents",
    "session_counts": "SELECT session_id, count(*) AS messages FROM chat_messages WHERE session_id IS NOT NULL GROUP BY session_id",
    # vectors are normalised: the norm of every chunk is one
    "ingest_documents": f"SELECT 'doc:' || doc_id || ':chunk:' || ordinal AS id, CAST(length(text) AS INTEGER) AS length, 1.0::DOUBLE AS norm FROM ({INGESTED})",
    "summarise_documents": f"""SELECT doc_id AS id, md5(CASE WHEN coalesce(length(content), 0) = 0 THEN '{models.NO_CONTENT}' WHEN length(trim(content, ' ' || chr(9) || chr(10) || chr(13) || chr(7) || chr(12))) < 50 THEN '{models.TOO_SHORT}'
        ELSE left(content, 200) END) AS summary FROM documents""",
}
