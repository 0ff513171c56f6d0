"""The two ways through the engine: documents into the collection, and questions into answers, many at a time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioforge.functions.text import is_blank
from folioforge.operators import models, vectors
from folioforge.operators.chunking import semantic_chunks
from folioforge.operators.context import budgeted_context, cut_single, joined_blocks, message_list, user_prompt

FAILED_COUNT = -1


def chunk_rows(documents: DataFrame, size: int = 512, overlap: int = 50, embedder: str = "hashed") -> DataFrame:
    """(id, document_id, title, text, embedding, pos) of documents (id, title, content); an embedding may be null."""
    chunks = semantic_chunks(documents, "id", "content", size, overlap)
    titles = documents.select(F.col("id").alias("doc"), "title")
    rows = chunks.join(titles, "doc")
    return rows.select("id", F.col("doc").alias("document_id"), "title", "text", models.embed(F.col("text"), embedder).alias("embedding"), F.col("ordinal").cast("long").alias("pos"))


def reindexed(store: DataFrame, documents: DataFrame, **options) -> tuple[DataFrame, DataFrame]:
    """(store, counts): the collection with the documents' old chunks replaced, and chunk_count per document.

    store is (id, document_id, title, text, embedding, ord). A document of which a chunk has no embedding keeps none of
    its new chunks and counts -1; blank documents have no chunks and no count.
    """
    rows = chunk_rows(documents, **options)
    state = rows.groupBy("document_id").agg(F.count(F.lit(1)).cast("int").alias("n"), F.max(F.col("embedding").isNull()).alias("broken"))
    sound = rows.join(state.filter(~F.col("broken")).select("document_id"), "document_id", "left_semi")
    old = store.join(documents.select(F.col("id").alias("document_id")), "document_id", "left_anti").select(store.columns)
    order = [c for c in store.columns if c != "ord"]
    counts = state.select(F.col("document_id").alias("id"), F.when(F.col("broken"), FAILED_COUNT).otherwise(F.col("n")).alias("chunk_count"))
    return vectors.upsert(old.select(*order, "ord"), sound.select(*order, "pos")), counts


def hits_for(store: DataFrame, questions: DataFrame, k: int = 5, digits: int | None = None) -> DataFrame:
    """(question_id, place, id, title, text, score): the k chunks of each question's documents that are most similar.

    questions is (question_id, document_id, embedding), one row per document a question may use. The join is on the
    document; each task keeps k rows per question before the shuffle of the ranking.
    """
    score = vectors.cosine(F.col("embedding"), F.col("_q"))
    asked = questions.select("question_id", "document_id", F.col("embedding").alias("_q"))
    scored = store.join(asked, "document_id").withColumn("score", score if digits is None else F.round(score, digits))
    order = Window.partitionBy("question_id").orderBy(F.desc("score"), "ord")
    return scored.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k).select("question_id", "place", "id", "title", "text", "score")


def question_contexts(hits: DataFrame, questions: DataFrame, documents: DataFrame, use_context: Column | None = None) -> DataFrame:
    """(question_id, context): the hits' blocks; without hits the content of the one document, or of several under a budget.

    questions is (question_id, document_id), documents (id, title, content). With ``use_context`` false the context is empty.
    """
    pairs = questions.select("question_id", "document_id").distinct()
    found = joined_blocks(hits, ["question_id"], "place", "title", "text")
    missing = pairs.join(found.select("question_id"), "question_id", "left_anti")
    bodies = missing.join(documents.select(F.col("id").alias("document_id"), "title", "content"), "document_id")
    size = pairs.groupBy("question_id").agg(F.count(F.lit(1)).alias("_n"))
    single = bodies.join(size.filter("_n = 1"), "question_id").select("question_id", cut_single(F.coalesce("content", F.lit(""))).alias("context"))
    several = budgeted_context(bodies.join(size.filter("_n > 1"), "question_id"), "question_id", "document_id", "title", "content")
    contexts = found.unionByName(single).unionByName(several)
    return contexts if use_context is None else contexts.withColumn("context", F.when(use_context, F.col("context")).otherwise(""))


def answered(questions: DataFrame, contexts: DataFrame, system: str, model: str = "extract") -> DataFrame:
    """(question_id, messages, answer) of questions (question_id, question); blank questions are left out."""
    asked = questions.select("question_id", "question").distinct().filter(~is_blank(F.col("question"))).join(contexts, "question_id", "left")
    prompt = user_prompt(F.col("question"), F.coalesce("context", F.lit("")))
    listed = message_list(F.lit(system), F.lit(None), prompt)
    return asked.select("question_id", listed.alias("messages"), models.complete(prompt, model, failure=models.FAILED).alias("answer"))
