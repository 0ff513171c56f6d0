import random

import numpy as np
from pyspark.sql import functions as F

from folioforge.operators import retrieval, vectors

ROW = "id string, text string, document_id long, embedding array<double>, ord long"


def chunks(spark):
    return spark.createDataFrame(
        [("a", "one", 1, [1.0, 0.0], 0), ("b", "two", 2, [0.8, 0.2], 1), ("c", "three", 1, [0.0, 1.0], 2), ("d", None, None, None, 3), ("e", "", 4, [0.0, 0.0], 4), ("f", "x", 5, [1.0], 5)],
        ROW,
    )


def test_similarity(spark):
    hits = vectors.similarity_search(chunks(spark), [1.0, 0.0], 3).collect()
    assert [(r["id"], round(r["score"], 6)) for r in hits] == [("a", 1.0), ("b", 0.970143), ("c", 0.0)]
    only = vectors.similarity_search(chunks(spark), [1.0, 0.0], 3, F.col("document_id") == 1).collect()
    assert [r["id"] for r in only] == ["a", "c"]
    assert vectors.similarity_search(chunks(spark), [], 3).count() == 0
    none = spark.createDataFrame([], "doc long")
    assert vectors.search_in_documents(chunks(spark), [1.0, 0.0], none, "doc", 3).count() == 0


def test_search_many_against_brute_force(spark):
    rng = np.random.default_rng(0)
    data = rng.normal(size=(300, 8))
    data[7] = data[8]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)] + [(900, None), (901, [0.0] * 8)], "k long, embedding array<double>")
    got = vectors.search_many(df, df.filter("k % 10 = 0 and k < 900"), "k", 5, exclude_self=True, block=7).collect()
    unit = data / np.linalg.norm(data, axis=1)[:, None]
    for q in range(0, 300, 10):
        scores = np.round(unit @ unit[q], 6)
        expected = sorted((-s, i) for i, s in enumerate(scores) if i != q)[:5]
        mine = sorted((r["place"], r["row"]) for r in got if r["query"] == q)
        assert [m[1] for m in mine] == [e[1] for e in expected]


def test_upsert(spark):
    store = spark.createDataFrame([("a", [1.0, 0.0], 0), ("b", [0.0, 1.0], 1)], "id string, embedding array<double>, ord long")
    batch = spark.createDataFrame(
        [("a", [0.5, 0.5], 0), ("a", [0.0, 1.0], 1), ("n", [1.0, 1.0], 2), ("", [1.0], 3), (None, [1.0], 4), ("z", None, 5), ("m", [2.0, 2.0], 6)],
        "id string, embedding array<double>, pos long",
    )
    rows = {r["id"]: (r["embedding"], r["ord"]) for r in vectors.upsert(store, batch).collect()}
    assert rows == {"a": ([0.0, 1.0], 0), "b": ([0.0, 1.0], 1), "n": ([1.0, 1.0], 4), "m": ([2.0, 2.0], 8)}
    assert vectors.upsert(store.limit(0), batch).count() == 3


def test_deletes(spark):
    schema = "id string, metadata struct<documentid:bigint,documenttitle:string>"
    rows = spark.createDataFrame([("a", (1, "t")), ("b", None), ("c", (None, "t")), ("d", (2, "t"))], schema)
    assert sorted(r["id"] for r in vectors.delete_document(rows, 1).collect()) == ["c", "d"]
    gone = spark.createDataFrame([(1,), (1,), (None,)], "id long")
    assert sorted(r["id"] for r in vectors.delete_documents(rows, gone).collect()) == ["c", "d"]
    ids = spark.createDataFrame([("a",), ("x",)], "id string")
    assert sorted(r["id"] for r in vectors.delete_ids(rows, ids).collect()) == ["b", "c", "d"]


def test_current_rows(spark):
    rows = [("a", 1, "old"), ("a", 3, "new"), ("a", 2, "mid"), ("b", 1, "only"), ("b", 1, "only"), (None, 1, "x"), ("c", None, "y")]
    df = spark.createDataFrame(rows, "id string, ord long, v string")
    got = sorted((r["id"], r["v"]) for r in vectors.current_rows(df, "id", "ord", {"v": F.col("v")}).collect())
    assert got == [("a", "new"), ("b", "only"), ("c", "y")]
    assert vectors.current_rows(df.limit(0), "id", "ord", {"v": F.col("v")}).count() == 0


def test_query_terms(spark):
    assert retrieval.terms_of(spark, "什么是RAG检索 how To use it") == ["什么是", "检索", "rag", "how", "use"]
    assert retrieval.terms_of(spark, "a 1 中") == []


def test_keyword(spark):
    rows = spark.createDataFrame(
        [("a", "Python 自动化测试 Python", 1, 0), ("b", "Database testing guide", 2, 1), ("c", None, 3, 2), ("d", "", 4, 3)], "id string, text string, document_id long, ord long"
    )
    hit = retrieval.keyword_search(rows, ["python"]).collect()
    assert [r["id"] for r in hit] == ["a"] and round(hit[0]["score"], 6) == 10.526316
    assert retrieval.keyword_search(rows, ["testing"], only=F.col("document_id") == 1).count() == 0
    assert retrieval.keyword_search(rows, []).count() == 0


def test_fusion(spark):
    v = spark.createDataFrame([("a", 0.9, 0), ("b", 0.3, 1), ("c", 0.36, 2)], "id string, score double, ord long")
    k = spark.createDataFrame([("c", 5.0, 2), ("d", 4.0, 3)], "id string, score double, ord long")
    v = v.withColumn("ord", F.col("ord")).withColumn("score", F.col("score"))
    every = retrieval.fuse(v, k, 5, 0).orderBy("place").collect()
    # by vector rank: a, c, b
    assert [r["id"] for r in every] == ["c", "a", "d", "b"]
    assert [r["id"] for r in retrieval.fuse(v, k, 5).orderBy("place").collect()] == ["c", "a", "d"]
    ranked = {r["id"]: r["rrf_score"] for r in every}
    assert abs(ranked["c"] - (1 / 62 + 1 / 61)) < 1e-12


def test_fusion_keyword_only_regime(spark):
    rng = random.Random(2)
    rows = [(f"r{i:03d}", "needle " * (i % 3 == 0) + "hay", i, [rng.random() - 0.5, rng.random() - 0.5], i) for i in range(100)]
    df = spark.createDataFrame(rows, ROW)
    got = retrieval.hybrid_search(df, [1.0, 0.0], "needle", 100, digits=9).orderBy("place").collect()
    score = lambda v: round(v[0] / (v[0] ** 2 + v[1] ** 2) ** 0.5, 9)
    vec = sorted(rows, key=lambda r: (-score(r[3]), r[4]))[:30]
    kw = sorted((r for r in rows if "needle" in r[1]), key=lambda r: (-round(1 / (len(r[1]) / 100), 9), r[4]))[:30]
    fused = {}
    for rank, r in enumerate(vec):
        fused[r[0]] = [1 / (61 + rank), score(r[3])]
    for rank, r in enumerate(kw):
        fused.setdefault(r[0], [0, None])[0] += 1 / (61 + rank)
    order = [(i, s) for i, s in fused.items()]
    order.sort(key=lambda x: -x[1][0])
    expected = [i for i, (s, vs) in order if vs is None or vs >= 0.35]
    assert [r["id"] for r in got] == expected


def test_many_questions_as_one_by_one(spark):
    rng = random.Random(4)
    rows = [(f"r{i:03d}", " ".join(rng.choice(["needle", "hay", "straw", "检索"]) for _ in range(6)), i % 2, [rng.random() - 0.3, rng.random() - 0.5], i) for i in range(120)]
    df = spark.createDataFrame(rows, ROW)
    asked = [("a", 0, "needle", [1.0, 0.1]), ("b", 1, "检索 straw", [0.2, 1.0]), ("c", 0, None, [0.5, 0.5]), ("d", 1, "needle", None), ("e", 0, "hay", [1.0, 0.0]), ("e", 1, "hay", [1.0, 0.0])]
    questions = spark.createDataFrame(asked, "question_id string, document_id long, question string, embedding array<double>")
    got = {}
    for r in retrieval.hybrid_search_many(df, questions, 6, digits=9).orderBy("question_id", "place").collect():
        got.setdefault(r["question_id"], []).append(r["id"])
    for name, documents in {"a": [0], "b": [1], "c": [0], "d": [1], "e": [0, 1]}.items():
        question, vector = next((q, v) for i, _, q, v in asked if i == name)
        one = retrieval.hybrid_search(df, vector, question or "", 6, F.col("document_id").isin(documents), digits=9).orderBy("place").collect()
        assert got[name] == [r["id"] for r in one], name
