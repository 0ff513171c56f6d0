"""Keyword search by substring term frequency, and its fusion with vector search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioforge.functions.text import occurrences, utf16_length
from folioforge.operators.vectors import cosine, similarity_search

DEPTH, RRF, THRESHOLD = 30, 60, 0.35


def query_terms(question: Column) -> Column:
    """Runs of at least two Chinese characters, then runs of at least three ASCII letters in lower case, each once."""
    han = F.regexp_extract_all(question, F.lit("([\\u4e00-\\u9fff]{2,})"), F.lit(1))
    latin = F.transform(F.regexp_extract_all(question, F.lit("([a-zA-Z]{3,})"), F.lit(1)), F.lower)
    return F.array_distinct(F.concat(han, latin))


def keyword_score(text: Column, terms: list[str]) -> Column:
    """Sum over terms of occurrences per hundred characters, in lower case; substrings count, words need not match."""
    low = F.lower(text)
    n = utf16_length(text)
    total = F.lit(0.0)
    for term in terms:
        total = total + F.when(n > 0, occurrences(low, F.lit(term)) / (n / F.lit(100.0))).otherwise(0.0)
    return total


def terms_of(spark, question: str) -> list[str]:
    return spark.range(1).select(query_terms(F.lit(question)).alias("t")).first()["t"]


def keyword_search(rows: DataFrame, terms: list[str], k: int = 20, only: Column | None = None, digits: int | None = None) -> DataFrame:
    """The k rows of highest score, ties by ord; rows that score 0 never. No terms give no rows."""
    if not terms:
        return rows.limit(0).withColumn("score", F.lit(0.0))
    kept = rows if only is None else rows.filter(only)
    any_term = F.lit(False)
    for term in terms:
        any_term = any_term | F.lower(F.col("text")).contains(term)
    score = keyword_score(F.col("text"), terms)
    scored = kept.filter(any_term).withColumn("score", score if digits is None else F.round(score, digits))
    return scored.filter(F.col("score") > 0).orderBy(F.desc("score"), "ord").limit(k)


def fuse(vector_hits: DataFrame, keyword_hits: DataFrame, k: int = 5, threshold: float = THRESHOLD, rrf: int = RRF) -> DataFrame:
    """(id, vector_score, rrf_score, place): reciprocal rank fusion of two short ranked lists.

    Order is by fused score; ties keep vector hits by rank first, then keyword hits. The threshold drops hits whose
    vector score is present and below it, after ranking and before the cut; keyword-only hits are exempt, and a
    threshold of 0 or less drops nothing.
    """
    order = Window.orderBy(F.desc("score"), "ord")  # the lists hold at most DEPTH rows
    v = vector_hits.select("id", F.col("score").alias("vector_score"), F.row_number().over(order).alias("rv"))
    w = keyword_hits.select("id", F.row_number().over(order).alias("rk"))
    part = lambda c: F.coalesce(F.lit(1.0) / (rrf + F.col(c)), F.lit(0.0))
    fused = v.join(w, "id", "full").withColumn("rrf_score", part("rv") + part("rk"))
    if threshold > 0:
        fused = fused.filter(F.col("vector_score").isNull() | (F.col("vector_score") >= threshold))
    place = F.row_number().over(Window.orderBy(F.desc("rrf_score"), F.asc_nulls_last("rv"), "rk"))
    return fused.withColumn("place", place).filter(F.col("place") <= k).select("id", "vector_score", "rrf_score", "place")


def hybrid_search(
    rows: DataFrame,
    query: list[float],
    question: str,
    k: int = 5,
    only: Column | None = None,
    threshold: float = THRESHOLD,
    depth: int = DEPTH,
    digits: int | None = None,
) -> DataFrame:
    """Both searches cut at depth, fused; columns of fuse with text and metadata of the hits."""
    hits = similarity_search(rows, query, depth, only, digits)
    words = keyword_search(rows, terms_of(rows.sparkSession, question), depth, only, digits)
    return fuse(hits, words, k, threshold)


def terms_score(text: Column, terms: Column) -> Column:
    """keyword_score where the terms are a column: one question per row."""
    low, n = F.lower(text), utf16_length(text)
    one = lambda t: occurrences(low, t) / (n / F.lit(100.0))
    return F.when(n > 0, F.aggregate(terms, F.lit(0.0), lambda s, t: s + one(t))).otherwise(F.lit(0.0))


def hybrid_search_many(
    rows: DataFrame, questions: DataFrame, k: int = 5, threshold: float = THRESHOLD, depth: int = DEPTH, digits: int | None = None, rrf: int = RRF
) -> DataFrame:
    """(question_id, id, vector_score, rrf_score, place): hybrid_search for many questions at once.

    rows is (id, document_id, text, embedding, ord), questions (question_id, document_id, question, embedding) with one row
    per document a question may use. Both searches join on the document and keep ``depth`` rows a question in each task
    before the ranking is shuffled. A null embedding leaves the keyword search only, a question without terms the vectors.
    """
    rounded = (lambda c: c) if digits is None else (lambda c: F.round(c, digits))
    order = Window.partitionBy("question_id").orderBy(F.desc("score"), "ord")

    def best(scored: DataFrame, rank: str) -> DataFrame:
        return scored.withColumn(rank, F.row_number().over(order)).filter(F.col(rank) <= depth)

    asked = questions.filter(F.col("embedding").isNotNull()).select("question_id", "document_id", F.col("embedding").alias("_q"))
    vectors = rows.select("id", "document_id", "embedding", "ord").join(asked, "document_id").withColumn("score", rounded(cosine(F.col("embedding"), F.col("_q"))))
    worded = questions.select("question_id", "document_id", query_terms(F.col("question")).alias("_t")).filter(F.size("_t") > 0)
    words = rows.select("id", "document_id", "text", "ord").join(worded, "document_id").withColumn("score", rounded(terms_score(F.col("text"), F.col("_t"))))
    v = best(vectors, "rv").select("question_id", "id", F.col("score").alias("vector_score"), "rv")
    w = best(words.filter(F.col("score") > 0), "rk").select("question_id", "id", "rk")
    part = lambda c: F.coalesce(F.lit(1.0) / (rrf + F.col(c)), F.lit(0.0))
    fused = v.join(w, ["question_id", "id"], "full").withColumn("rrf_score", part("rv") + part("rk"))
    if threshold > 0:
        fused = fused.filter(F.col("vector_score").isNull() | (F.col("vector_score") >= threshold))
    final = Window.partitionBy("question_id").orderBy(F.desc("rrf_score"), F.asc_nulls_last("rv"), "rk")
    return fused.withColumn("place", F.row_number().over(final)).filter(F.col("place") <= k).select("question_id", "id", "vector_score", "rrf_score", "place")
