import datetime as dt
import random

from pyspark.sql import functions as F

from folioforge.operators.bloom import bits_for, bloom_filter, might_contain
from folioforge.operators.references import Reference, latest_version, orphan_counts, orphan_references

T = dt.datetime(2026, 3, 5)


def day(n):
    return T + dt.timedelta(days=n)


def test_bloom_has_no_false_negatives(spark):
    keys = spark.range(5000).select((F.col("id") * 7).alias("k"))
    row = bloom_filter(keys, F.col("k"), 5000)
    passed = spark.range(70000).filter(might_contain(row, F.col("id")))
    assert passed.filter("id % 7 = 0 and id < 35000").count() == 5000
    assert passed.filter("id % 7 <> 0 or id >= 35000").count() < 3000
    empty = bloom_filter(keys.limit(0), F.col("k"), 0)
    assert spark.range(10).filter(might_contain(empty, F.col("id"))).count() == 0
    assert bits_for(10**12) == 1 << 26


def find(spark, refs, parents, deleted):
    r = spark.createDataFrame(refs, "id string, doc long, at timestamp_ntz, doc_id string")
    p = spark.createDataFrame(parents, "doc_id long, create_time timestamp_ntz, ref string")
    d = spark.createDataFrame(deleted, "document_id long")
    got = orphan_references([Reference("t", r, F.col("id"), F.col("doc"), F.col("at"))], p, "doc_id", "create_time", d, "document_id")
    assert sum(x["orphans"] for x in orphan_counts(got).collect()) == got.count()
    return sorted((x["row_key"], x["reason"], x["period"] or "") for x in got.collect())


def test_reasons(spark):
    refs = [
        ("held", 1, day(0), "clash"), ("late", 2, day(0), None), ("gone", 3, day(0), None), ("none", 4, day(40), None), ("none", 4, day(40), None),
        ("null", None, day(0), None), ("restored", 5, day(0), None), ("untimed", 2, None, None), ("orphan untimed", 9, None, None), ("early parent", 6, day(0), None),
    ]
    parents = [(1, day(-1), "x"), (2, day(1), None), (5, day(-9), None), (6, None, None), (None, day(0), None), (7, day(9), None), (7, day(-9), None)]
    got = find(spark, refs, parents, [(3,), (3,), (5,), (None,)])
    assert got == [("gone", "deleted", "2026-03"), ("late", "late", "2026-03"), ("none", "missing", "2026-04"), ("orphan untimed", "missing", "")]


def test_empty_tables(spark):
    assert find(spark, [("a", 1, day(0), None)], [], []) == [("a", "missing", "2026-03")]
    assert find(spark, [], [(1, day(0), None)], [(1,)]) == []


def test_against_brute_force(spark):
    rng = random.Random(3)
    parents = [(i, day(rng.randint(-20, 20)), None) for i in range(300) if rng.random() < 0.8]
    deleted = [(i,) for i in range(320) if rng.random() < 0.2]
    # one key holds a third of all rows
    refs = [(str(i), 17 if i % 3 == 0 else rng.randint(0, 330), day(rng.randint(-20, 20)), None) for i in range(3000)]
    held, gone = {p[0]: p[1] for p in parents}, {d[0] for d in deleted}
    expected = []
    for key, doc, at, _ in refs:
        if doc not in held:
            expected.append((key, "deleted" if doc in gone else "missing", at.strftime("%Y-%m")))
        elif held[doc] > at:
            expected.append((key, "late", at.strftime("%Y-%m")))
    assert find(spark, refs, parents, deleted) == sorted(expected)


def test_latest_version(spark):
    df = spark.createDataFrame([("a", 1, 5), ("a", 2, 6), ("b", None, 7), (None, 1, 8)], "id string, ord long, v int")
    assert sorted(map(tuple, latest_version(df, "id", "ord", ["v"]).collect())) == [("a", 6), ("b", 7)]
