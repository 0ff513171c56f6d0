import pandas as pd
from pyspark.sql import functions as F

from folioforge import pipeline
from folioforge.operators import context, models

DOC = "id long, title string, content string"
STORE = "id string, document_id long, title string, text string, embedding array<double>, ord long"


def documents(spark):
    return spark.createDataFrame([(1, "T", "第一段。\n\n第二段。"), (2, None, "second document"), (3, "E", "  "), (4, "N", None)], DOC)


def test_reindex(spark):
    store = spark.createDataFrame([("doc:1:chunk:0", 1, "T", "old", [1.0], 0), ("doc:1:chunk:9", 1, "T", "old", [1.0], 1), ("doc:9:chunk:0", 9, "X", "kept", [1.0], 2)], STORE)
    new, counts = pipeline.reindexed(store, documents(spark))
    rows = {r["id"]: r for r in new.collect()}
    assert set(rows) == {"doc:1:chunk:0", "doc:2:chunk:0", "doc:9:chunk:0"} and rows["doc:1:chunk:0"]["text"] != "old"
    assert {r["id"]: r["chunk_count"] for r in counts.collect()} == {1: 1, 2: 1}
    models.register_embedder("partial", lambda texts: [None if "second" in t else [1.0] for t in texts])
    new, counts = pipeline.reindexed(store, documents(spark), embedder="partial")
    assert {r["id"]: r["chunk_count"] for r in counts.collect()} == {1: 1, 2: -1}
    assert "doc:2:chunk:0" not in {r["id"] for r in new.collect()}


def test_ask(spark):
    docs = documents(spark)
    store, _ = pipeline.reindexed(spark.createDataFrame([], STORE), docs)
    vector = pd.Series(models.hashed_embedding(["second document"])).iloc[0]
    questions = spark.createDataFrame([("q1", "What?", 2, vector), ("q2", "Why?", 3, vector), ("q3", "Both?", 3, vector), ("q3", "Both?", 4, vector), ("q4", " ", 2, vector)], "question_id string, question string, document_id long, embedding array<double>")
    hits = pipeline.hits_for(store, questions, 5)
    assert {r["question_id"] for r in hits.collect()} == {"q1", "q4"}
    contexts = pipeline.question_contexts(hits, questions, docs)
    got = {r["question_id"]: r["context"] for r in contexts.collect()}
    assert got["q1"].startswith("[1] 来源：未知文档\nsecond document")
    assert got["q2"] == "  " and got["q3"] == context.NOTHING
    off = pipeline.question_contexts(hits, questions, docs, F.lit(False))
    assert {r["context"] for r in off.collect()} == {""}
    answers = {r["question_id"]: r for r in pipeline.answered(questions, contexts, "be brief").collect()}
    assert set(answers) == {"q1", "q2", "q3"}
    assert [m["role"] for m in answers["q1"]["messages"]] == ["system", "user"] and "What?" in answers["q1"]["messages"][1]["content"]
