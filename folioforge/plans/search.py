"""Vector collection and retrieval queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge import pipeline
from folioforge.functions.text import STRIP_WEB
from folioforge.operators import context, models, retrieval, vectors
from folioforge.plans import sql_text
from folioforge.plans.text import semantic_sql
from folioforge.session import table

WORDS = "检索结果 retriever glossary"
QUERY_ID = "doc:1:chunk:0"
NOTEBOOK = 7


def _current(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Valid chunks: (id, text, document_id, title, embedding, ord)."""
    return vectors.current_rows(
        table(spark, sf_dir, "vector_store"),
        "id",
        "ord",
        {
            "text": F.col("text"),
            "document_id": F.col("metadata.documentid"),
            "title": F.col("metadata.documenttitle"),
            "embedding": F.col("embedding"),
            "ord": F.col("ord"),
        },
    )


def _query_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    rows = table(spark, sf_dir, "vector_store").filter(F.col("id") == QUERY_ID).orderBy(F.desc("ord")).select("embedding").limit(1).collect()
    return list(rows[0][0]) if rows and rows[0][0] else []


def vec_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upserts resolved: the row of highest ord per id."""
    return _current(spark, sf_dir).select("id", "ord", "document_id")


def vec_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = vectors.similarity_search(_current(spark, sf_dir), _query_vector(spark, sf_dir), 5, digits=6)
    return hits.select("id", "score")


def vec_topk_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _current(spark, sf_dir)
    return vectors.similarity_search(rows, _query_vector(spark, sf_dir), 5, F.col("document_id") == 1, digits=6).select("id", "score")


def vec_topk_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Among the documents of one notebook."""
    inside = table(spark, sf_dir, "documents").filter(F.col("notebook_id") == NOTEBOOK)
    hits = vectors.search_in_documents(_current(spark, sf_dir), _query_vector(spark, sf_dir), inside, "doc_id", 8, digits=6)
    return hits.select("id", "score")


def vec_topk_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every hundredth vector the five most similar others."""
    rows = table(spark, sf_dir, "embeddings")
    return vectors.search_many(rows, rows.filter(F.col("vec_id") % 100 == 0), "vec_id", 5, exclude_self=True).select("query", "row", "score", "place")


def vec_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every chunk's similarity to one vector; 0 for missing, zero and odd-length embeddings."""
    q = F.array(*[F.lit(x) for x in _query_vector(spark, sf_dir)])
    return table(spark, sf_dir, "vector_store").select("id", "ord", (F.round(vectors.cosine(F.col("embedding"), q), 6) + 0.0).alias("score")).distinct()


def vec_delete_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = table(spark, sf_dir, "vector_store")
    gone = store.filter(F.col("id").endswith(":chunk:0")).select("id")
    return vectors.delete_ids(store, gone).select("id", "ord").distinct()


def vec_delete_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.delete_document(table(spark, sf_dir, "vector_store"), 1).select("id", "ord").distinct()


def vec_delete_logged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of every deleted document removed at once."""
    store = vectors.delete_documents(table(spark, sf_dir, "vector_store"), table(spark, sf_dir, "deleted_documents"), "document_id")
    return store.select("id", "ord").distinct()


def vec_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each hundredth embedding written again under its id and once more under a new one."""
    rows = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").cast("string").alias("id"), F.col("embedding").cast("array<double>").alias("embedding"), F.col("label").alias("document_id"), F.col("vec_id").alias("ord")
    )
    again = rows.filter(F.col("ord") % 100 == 0)
    batch = again.withColumn("document_id", F.lit(-1)).unionByName(again.withColumn("id", F.concat(F.lit("new:"), "id"))).withColumn("pos", F.col("ord") * 2 + F.col("id").startswith("new").cast("int"))
    return vectors.upsert(rows, batch.drop("ord")).select("id", "document_id", "ord")


def query_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "chat_messages").filter(F.col("content").isNotNull()).select("id", "content").distinct()
    return rows.select("id", F.array_join(retrieval.query_terms(F.col("content")), "|").alias("terms"))


def kw_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.keyword_search(_current(spark, sf_dir), retrieval.terms_of(spark, WORDS), 20, digits=9).select("id", F.round("score", 6).alias("score"))


def kw_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The keyword score of every document."""
    docs = table(spark, sf_dir, "documents").filter(F.length("text") > 0)
    score = retrieval.keyword_score(F.col("text"), retrieval.terms_of(spark, WORDS))
    return docs.select("doc_id", F.round(score, 6).alias("score")).filter("score > 0")


def hybrid_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = retrieval.hybrid_search(_current(spark, sf_dir), _query_vector(spark, sf_dir), WORDS, 8, digits=9)
    return found.select("id", F.round("vector_score", 6).alias("vector_score"), F.round("rrf_score", 9).alias("rrf_score"), "place")


def ctx_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The context of one question: numbered blocks of its hits."""
    rows = _current(spark, sf_dir)
    found = retrieval.hybrid_search(rows, _query_vector(spark, sf_dir), WORDS, 8, digits=9)
    hits = rows.join(F.broadcast(found), "id").withColumn("q", F.lit(1))
    return context.joined_blocks(hits, ["q"], "place", "title", "text").select("context")


def ctx_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("body", F.repeat("text", 10))
    return context.budgeted_context(docs, "notebook_id", "doc_id", "title", "body").select("notebook_id", F.length("context").alias("length"), F.md5("context").alias("context"))


def ctx_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = context.cut_single(F.repeat("text", 10))
    return table(spark, sf_dir, "documents").select("doc_id", F.length(c).alias("length"), F.md5(c).alias("context"))


def hybrid_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document asked with its title and its first chunk: the five best of its chunks by both searches."""
    rows = _current(spark, sf_dir)
    asked = rows.filter(F.col("id").endswith(":chunk:0") & F.col("document_id").isNotNull()).select(
        F.col("id").alias("question_id"), "document_id", F.col("title").alias("question"), "embedding"
    )
    found = retrieval.hybrid_search_many(rows, asked, 5, digits=9)
    return found.select("question_id", "id", F.round("vector_score", 6).alias("vector_score"), F.round("rrf_score", 9).alias("rrf_score"), "place")


def ask_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a model is told and asked about each document, and the fixed answer where there is nothing to ask."""
    use = F.col("doc_id") % 2 == 0
    scope = F.when(F.col("notebook_id").isNull(), "document").otherwise("notebook")
    rows = table(spark, sf_dir, "documents")
    return rows.select(
        "doc_id",
        F.md5(context.system_prompt(scope, use)).alias("system"),
        F.md5(context.several_prompt(F.coalesce("title", F.lit("")), F.col("content"))).alias("prompt"),
        context.answer_or_notice(F.col("content"), F.lit("asked"), use).alias("answer"),
    )


def _unless_question(texts: list[str]) -> list:
    """An embedder that fails for chunks with a question."""
    return [None if "?" in t or "？" in t else [1.0] for t in texts]


models.register_embedder("unless_question", _unless_question)


def _reindexed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = _current(spark, sf_dir).select("id", "document_id", "title", "text", "embedding", "ord")
    inside = table(spark, sf_dir, "documents").filter(F.col("notebook_id") == NOTEBOOK)
    return pipeline.reindexed(rows, inside.select(F.col("doc_id").alias("id"), "title", F.col("text").alias("content")), embedder="unless_question")


def reindex(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The collection after the documents of a notebook were indexed anew; a document that failed keeps nothing."""
    return _reindexed(spark, sf_dir)[0].select("id", "document_id")


def reindex_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of each of these documents, -1 where one of them failed."""
    return _reindexed(spark, sf_dir)[1].select("id", "chunk_count")


def ask_retrieve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document asked with its first chunk: the five chunks of it that are most similar."""
    rows = _current(spark, sf_dir)
    asked = rows.filter(F.col("id").endswith(":chunk:0") & F.col("embedding").isNotNull()).select(F.col("id").alias("question_id"), "document_id", "embedding")
    return pipeline.hits_for(rows, asked, 5, 6).select("question_id", "place", "id", "score")


def ask_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The context each of those questions gets; documents without chunks give their text."""
    rows = _current(spark, sf_dir)
    first = rows.filter(F.col("id").endswith(":chunk:0")).select("document_id", "embedding").filter(F.col("document_id").isNotNull())
    documents = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "title", F.col("text").alias("content"))
    asked = documents.select(F.col("id").alias("document_id")).join(first, "document_id", "left").withColumn("question_id", F.col("document_id"))
    hits = pipeline.hits_for(rows, asked.filter(F.col("embedding").isNotNull()), 5, 6)
    return pipeline.question_contexts(hits, asked, documents).select("question_id", F.md5("context").alias("context"))


CURRENT = """(SELECT id, text, metadata.documentid AS document_id, metadata.documenttitle AS title, embedding, ord FROM (
    SELECT *, row_number() OVER (PARTITION BY id ORDER BY ord DESC) AS rn FROM vector_store WHERE id IS NOT NULL) WHERE rn = 1)"""
_Q = f"(SELECT embedding FROM vector_store WHERE id = '{QUERY_ID}' ORDER BY ord DESC LIMIT 1)"


def _cos(a: str, b: str) -> str:
    norm = lambda x: f"sqrt(list_sum(list_transform({x}, lambda y: y * y)))"
    return f"""coalesce(CASE WHEN len({a}) = len({b}) AND {norm(a)} * {norm(b)} > 0
        THEN list_sum(list_transform(list_zip({a}, {b}), lambda z: z[1] * z[2])) / ({norm(a)} * {norm(b)}) END, 0.0)"""


def _top(where: str, k: int, digits: int = 6) -> str:
    return f"SELECT id, score FROM (SELECT id, ord, round({_cos('embedding', _Q)}, {digits}) AS score FROM {CURRENT} {where}) ORDER BY score DESC, ord LIMIT {k}"


def _count(text: str, term: str) -> str:
    return f"(length({text}) - length(replace({text}, '{term}', ''))) / {len(term)}"


_KW = " + ".join(f"({_count('lower(text)', t)}) / (length(text) / 100.0::DOUBLE)" for t in ("检索结果", "retriever", "glossary"))
_V30 = f"SELECT id, ord, round({_cos('embedding', _Q)}, 9) AS score FROM {CURRENT} ORDER BY score DESC, ord LIMIT 30"
_K30 = f"SELECT * FROM (SELECT id, ord, round({_KW}, 9) AS score FROM {CURRENT} WHERE length(text) > 0) WHERE score > 0 ORDER BY score DESC, ord LIMIT 30"
_FUSED = f"""
  WITH v AS (SELECT id, score AS vector_score, row_number() OVER (ORDER BY score DESC, ord) AS rv FROM ({_V30})),
       k AS (SELECT id, row_number() OVER (ORDER BY score DESC, ord) AS rk FROM ({_K30})),
       f AS (SELECT coalesce(v.id, k.id) AS id, vector_score, rv, rk, coalesce(1.0::DOUBLE / (60 + rv), 0) + coalesce(1.0::DOUBLE / (60 + rk), 0) AS rrf_score
             FROM v FULL JOIN k ON v.id = k.id)
  SELECT id, round(vector_score, 6) AS vector_score, round(rrf_score, 9) AS rrf_score, place FROM (
    SELECT *, CAST(row_number() OVER (ORDER BY rrf_score DESC, rv NULLS LAST, rk) AS INTEGER) AS place FROM f WHERE vector_score IS NULL OR vector_score >= 0.35)
  WHERE place <= 8"""
_TRIM = sql_text("".join(map(chr, range(33))))
_N = "chr(10)"

_ASK = f"""SELECT *, CAST(row_number() OVER (PARTITION BY question_id ORDER BY score DESC, ord) AS INTEGER) AS place FROM (
    SELECT q.id AS question_id, q.document_id AS question, r.id, r.ord, r.title, r.text, round({_cos("r.embedding", "q.embedding")}, 6) AS score
    FROM {CURRENT} q JOIN {CURRENT} r ON q.document_id = r.document_id WHERE q.id LIKE '%:chunk:0' AND q.embedding IS NOT NULL)"""

_HAN, _LATIN = r"'[\x{4e00}-\x{9fff}]{2,}'", "'[a-zA-Z]{3,}'"
_MANY = f"""
  WITH q AS (SELECT *, list_filter(t, lambda x, i: list_position(t, x) = i) AS terms FROM (
      SELECT id AS question_id, document_id, embedding, list_concat(regexp_extract_all(coalesce(title, ''), {_HAN}), list_transform(regexp_extract_all(coalesce(title, ''), {_LATIN}), lambda x: lower(x))) AS t
      FROM {CURRENT} WHERE id LIKE '%:chunk:0' AND document_id IS NOT NULL)),
    v AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, ord) AS rv FROM (
      SELECT q.question_id, r.id, r.ord, round({_cos("r.embedding", "q.embedding")}, 9) AS score FROM q JOIN {CURRENT} r ON q.document_id = r.document_id WHERE q.embedding IS NOT NULL)) WHERE rv <= 30),
    w AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, ord) AS rk FROM (
      SELECT q.question_id, r.id, r.ord, round(list_sum(list_transform(q.terms, lambda x: (length(lower(r.text)) - length(replace(lower(r.text), x, ''))) / length(x) / (length(r.text) / 100.0::DOUBLE))), 9) AS score
      FROM q JOIN {CURRENT} r ON q.document_id = r.document_id WHERE len(q.terms) > 0 AND length(r.text) > 0) WHERE score > 0) WHERE rk <= 30),
    f AS (SELECT coalesce(v.question_id, w.question_id) AS question_id, coalesce(v.id, w.id) AS id, v.score AS vector_score, rv, rk,
      coalesce(1.0::DOUBLE / (60 + rv), 0) + coalesce(1.0::DOUBLE / (60 + rk), 0) AS rrf_score FROM v FULL JOIN w ON v.question_id = w.question_id AND v.id = w.id)
  SELECT question_id, id, round(vector_score, 6) AS vector_score, round(rrf_score, 9) AS rrf_score, place FROM (
    SELECT *, CAST(row_number() OVER (PARTITION BY question_id ORDER BY rrf_score DESC, rv NULLS LAST, rk) AS INTEGER) AS place FROM f WHERE vector_score IS NULL OR vector_score >= 0.35)
  WHERE place <= 5"""
_NEW = semantic_sql(f"SELECT doc_id, text FROM documents WHERE notebook_id = {NOTEBOOK}", 512, 50)
_STATE = f"(SELECT doc_id, count(*) AS n, bool_or(text LIKE '%?%' OR text LIKE '%？%') AS broken FROM ({_NEW}) GROUP BY doc_id)"

QUERIES = {
    f.__name__: f
    for f in (
        vec_current, vec_topk, vec_topk_filtered, vec_topk_in, vec_topk_batch, vec_cosine, vec_delete_ids, vec_delete_doc, vec_delete_logged,
        vec_upsert, query_terms, kw_topk, kw_scores, hybrid_rrf, ctx_blocks, ctx_budget, ctx_truncate,
        ask_retrieve, ask_context, hybrid_many, ask_prompts, reindex, reindex_counts,
    )
}
SQL = {
    "vec_current": f"SELECT id, ord, document_id FROM {CURRENT}",
    "vec_topk": _top("", 5),
    "vec_topk_filtered": _top("WHERE document_id = 1", 5),
    "vec_topk_in": _top(f"WHERE document_id IN (SELECT doc_id FROM documents WHERE notebook_id = {NOTEBOOK})", 8),
    "vec_topk_batch": """SELECT query, row, score, place FROM (
        SELECT *, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, row) AS INTEGER) AS place FROM (
          SELECT q.vec_id AS query, r.vec_id AS row, round(list_cosine_similarity(q.embedding::DOUBLE[], r.embedding::DOUBLE[]), 6) AS score
          FROM embeddings q JOIN embeddings r ON q.vec_id <> r.vec_id WHERE q.vec_id % 100 = 0)) WHERE place <= 5""",
    "vec_cosine": f"SELECT DISTINCT id, ord, round({_cos('embedding', _Q)}, 6) + 0.0 AS score FROM vector_store",
    "vec_delete_ids": "SELECT DISTINCT id, ord FROM vector_store WHERE id NOT LIKE '%:chunk:0'",
    "vec_delete_doc": "SELECT DISTINCT id, ord FROM vector_store WHERE metadata IS NOT NULL AND metadata.documentid IS DISTINCT FROM 1",
    "vec_delete_logged": """SELECT DISTINCT id, ord FROM vector_store WHERE metadata IS NOT NULL
        AND (metadata.documentid IS NULL OR metadata.documentid NOT IN (SELECT document_id FROM deleted_documents WHERE document_id IS NOT NULL))""",
    "vec_upsert": """SELECT CAST(vec_id AS VARCHAR) AS id, CASE WHEN vec_id % 100 = 0 THEN -1 ELSE label END AS document_id, vec_id AS ord FROM embeddings
        UNION ALL SELECT 'new:' || vec_id, label, (SELECT max(vec_id) + 1 FROM embeddings) + vec_id * 2 + 1 FROM embeddings WHERE vec_id % 100 = 0""",
    "query_terms": r"""SELECT id, array_to_string(list_filter(t, lambda x, i: list_position(t, x) = i), '|') AS terms FROM (
        SELECT id, list_concat(regexp_extract_all(content, '[\x{4e00}-\x{9fff}]{2,}'), list_transform(regexp_extract_all(content, '[a-zA-Z]{3,}'), lambda x: lower(x))) AS t
        FROM (SELECT DISTINCT id, content FROM chat_messages WHERE content IS NOT NULL))""",
    "kw_topk": f"""SELECT id, round(score, 6) AS score FROM (
        SELECT id, ord, round({_KW}, 9) AS score FROM {CURRENT} WHERE length(text) > 0) WHERE score > 0 ORDER BY score DESC, ord LIMIT 20""",
    "kw_scores": f"SELECT doc_id, score FROM (SELECT doc_id, round({_KW}, 6) AS score FROM documents WHERE length(text) > 0) WHERE score > 0",
    "hybrid_rrf": _FUSED,
    "ctx_blocks": f"""SELECT string_agg('[' || place || '] 来源：' || coalesce(title, '未知文档') || {_N} || text, {_N} || {_N} || '---' || {_N} || {_N} ORDER BY place) AS context
        FROM ({_FUSED}) f JOIN {CURRENT} c ON f.id = c.id""",
    "ctx_budget": f"""WITH s AS (
        SELECT notebook_id, doc_id, {_N} || '【文档：' || coalesce(title, '') || '】' || {_N} || trim(repeat(text, 10), {_TRIM}) || {_N} AS section
        FROM documents WHERE notebook_id IS NOT NULL AND length(trim(repeat(text, 10), {_TRIM})) > 0),
      c AS (SELECT *, sum(length(section)) OVER (PARTITION BY notebook_id ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS total FROM s),
      p AS (SELECT notebook_id, doc_id, total, CASE WHEN total <= 50000 THEN section
        WHEN total - length(section) <= 50000 AND 50000 - (total - length(section)) > 100 THEN left(section, CAST(50000 - (total - length(section)) AS BIGINT)) || {_N} || '...（内容已截断）' END AS piece FROM c),
      j AS (SELECT notebook_id, string_agg(piece, '' ORDER BY doc_id) || CASE WHEN max(total) > 50000 THEN {_N} || '...（更多文档内容因长度限制未纳入上下文）' ELSE '' END AS context FROM p GROUP BY notebook_id)
      SELECT n.notebook_id, CAST(length(coalesce(context, '该笔记本下的文档内容均为空，无法回答问题。')) AS INTEGER) AS length, md5(coalesce(context, '该笔记本下的文档内容均为空，无法回答问题。')) AS context
      FROM (SELECT DISTINCT notebook_id FROM documents WHERE notebook_id IS NOT NULL) n LEFT JOIN j ON n.notebook_id = j.notebook_id""",
    "hybrid_many": _MANY,
    "ask_prompts": f"""SELECT doc_id, md5(CASE WHEN notebook_id IS NOT NULL THEN '{context.SYSTEM_PROMPTS["notebook"]}' WHEN doc_id % 2 = 0 THEN '{context.SYSTEM_PROMPTS["document"]}' ELSE '{context.SYSTEM_PROMPTS["general"]}' END) AS system,
        md5('{context.CONTEXT_LABEL}' || {_N} || CASE WHEN coalesce(content, '') = '' THEN '{context.NO_HITS}' ELSE content END || {_N} || {_N} || '{context.QUESTION_LABEL}' || {_N} || coalesce(title, '')) AS prompt,
        CASE WHEN doc_id % 2 = 0 AND trim(coalesce(content, ''), {sql_text(STRIP_WEB)}) = '' THEN '{context.EMPTY_DOCUMENT}' ELSE 'asked' END AS answer FROM documents""",
    "reindex": f"""SELECT id, document_id FROM {CURRENT} WHERE document_id IS NULL OR document_id NOT IN (SELECT doc_id FROM documents WHERE notebook_id = {NOTEBOOK})
        UNION ALL SELECT 'doc:' || c.doc_id || ':chunk:' || c.ordinal, c.doc_id FROM ({_NEW}) c JOIN {_STATE} s ON c.doc_id = s.doc_id WHERE NOT s.broken""",
    "reindex_counts": f"SELECT doc_id AS id, CAST(CASE WHEN broken THEN -1 ELSE n END AS INTEGER) AS chunk_count FROM {_STATE}",
    "ask_retrieve": f"SELECT question_id, place, id, score FROM ({_ASK}) WHERE place <= 5",
    "ask_context": f"""WITH c AS (SELECT question AS question_id, string_agg('[' || place || '] 来源：' || coalesce(title, '未知文档') || {_N} || text, {_N} || {_N} || '---' || {_N} || {_N} ORDER BY place) AS context
        FROM ({_ASK}) WHERE place <= 5 AND question IN (SELECT doc_id FROM documents) GROUP BY question)
      SELECT d.doc_id AS question_id, md5(coalesce(c.context, CASE WHEN length(text) > 8000 THEN left(text, 8000) || {_N} || '...（内容已截断）' ELSE coalesce(text, '') END)) AS context
      FROM documents d LEFT JOIN c ON d.doc_id = c.question_id""",
    "ctx_truncate": f"""SELECT doc_id, CAST(length(c) AS INTEGER) AS length, md5(c) AS context FROM (
        SELECT doc_id, CASE WHEN length(repeat(text, 10)) > 8000 THEN left(repeat(text, 10), 8000) || {_N} || '...（内容已截断）' ELSE repeat(text, 10) END AS c FROM documents)""",
}
