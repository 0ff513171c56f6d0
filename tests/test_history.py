import datetime as dt

from pyspark.sql import functions as F

from folioforge.operators import citations, context, history
from folioforge.streaming import answers

SCHEMA = "id long, session_id string, role string, content string, document_id long, notebook_id long, user_id long, create_time timestamp_ntz"
T0 = dt.datetime(2026, 1, 1)


def rows(spark, n=6, session="doc:1:1", same=False):
    return spark.createDataFrame(
        [(i, session, "user" if i % 2 == 0 else "assistant", f"m{i}", 1, None, 1, T0 + dt.timedelta(minutes=0 if same else i // 2)) for i in range(n)], SCHEMA
    )


def test_keys(spark):
    one = spark.range(1)
    assert one.select(history.session_key("doc", F.lit(10), F.lit(2))).first()[0] == "doc:10:2"
    assert one.select(history.session_key("notebook", F.lit(20))).first()[0] == "notebook:20"


def test_truncate_and_order(spark):
    assert sorted(r["id"] for r in history.truncated(rows(spark), 2).collect()) == [2, 3, 4, 5]
    ordered = history.ordered(rows(spark, same=True)).orderBy("position").collect()
    assert [r["id"] for r in ordered] == list(range(6))
    assert history.truncated(rows(spark, 2002), 1000).agg(F.min("id")).first()[0] == 2


def test_expiry_is_strict(spark):
    kept = history.expired(rows(spark), "2026-01-08 00:01:00", 7).collect()
    assert sorted(r["id"] for r in kept) == [2, 3, 4, 5]


def test_clear_keeps_nulls(spark):
    both = rows(spark).unionByName(rows(spark, 2, None).withColumn("id", F.col("id") + 100).withColumn("document_id", F.lit(None).cast("long")))
    assert history.cleared(both, document_id=1, user_id=1).count() == 2


def test_append_turn(spark):
    turn = spark.createDataFrame([("doc:1:1", 50, 1, None, 1, T0, "q", "a"), ("doc:1:1", 60, 1, None, 1, T0, "q", "")], "session_id string, id long, document_id long, notebook_id long, user_id long, create_time timestamp_ntz, question string, answer string")
    got = history.append_turn(rows(spark, 2), turn).orderBy("id").collect()
    assert [(r["id"], r["role"], r["content"]) for r in got[2:]] == [(50, "user", "q"), (51, "assistant", "a")]
    assert got[2]["create_time"] == got[3]["create_time"]


def test_compress(spark):
    got = history.compressed(rows(spark, 8), lambda t: t, 1, 4).orderBy("position").collect()
    assert [r["content"] for r in got] == [history.SUMMARY_PREFIX + "用户: m0\n\nAI: m1\n\n用户: m2\n\nAI: m3\n\n", "m4", "m5", "m6", "m7"]
    assert got[0]["role"] == "assistant"
    assert history.compressed(rows(spark, 4), lambda t: t, 1, 4).count() == 4
    assert history.compressed(rows(spark, 0), lambda t: t, 1, 4).count() == 0


def test_budget(spark):
    title, body = "t", lambda n: "x" * n
    frame = len("\n【文档：t】\n\n")
    df = spark.createDataFrame([(1, i, title, body(300 - frame)) for i in range(3)] + [(2, 1, title, " "), (2, 2, title, None)], "g int, o int, title string, c string")
    got = {r["g"]: r["context"] for r in context.budgeted_context(df, "g", "o", "title", "c", 500).collect()}
    section = f"\n【文档：t】\n{body(300 - frame)}\n"
    assert got[1] == section + section[:200] + context.CUT_NOTE + context.CUT_NOTE_ALL
    assert got[2] == context.NOTHING
    tight = {r["g"]: r["context"] for r in context.budgeted_context(df, "g", "o", "title", "c", 390).collect()}
    assert tight[1] == section + context.CUT_NOTE_ALL


def test_blocks_and_prompts(spark):
    hits = spark.createDataFrame([(1, 2, None, "second"), (1, 1, "T", "first")], "q int, place int, title string, text string")
    got = context.joined_blocks(hits, ["q"], "place", "title", "text").first()["context"]
    assert got == "[1] 来源：T\nfirst\n\n---\n\n[2] 来源：未知文档\nsecond"
    one = spark.range(1)
    listed = one.select(context.message_list(F.lit("s"), F.lit(None), F.lit("u"))).first()[0]
    assert [(m["role"], m["content"]) for m in listed] == [("system", "s"), ("user", "u")]
    cut = one.select(context.cut_single(F.lit("y" * 8001)), context.cut_single(F.lit("y" * 8000))).first()
    assert cut[0] == "y" * 8000 + context.CUT_NOTE and cut[1] == "y" * 8000


def test_citations(spark):
    cases = {
        1: ("ans --- [1] 【文档：标题】原文片段", [(1, "标题", "原文片段")]),
        2: ("x --- [1] 文xyz", [(1, "xy", "z")]),
        3: ("ans --- c1 --- [2] 【文档：b】c2", []),
        4: ("see [2] and [2]", [(2, "未知来源", ""), (2, "未知来源", "")]),
        5: ("a --- [3] plain", [(3, "参考来源", "plain")]),
        6: ("", []),
        7: (None, None),
    }
    df = spark.createDataFrame([(k, v[0]) for k, v in cases.items()], "id int, raw string")
    got = {}
    for r in citations.citations(df, "id", "raw").orderBy("message_id", "place").collect():
        got.setdefault(r["message_id"], []).append((r["id"], r["title"], r["snippet"]))
    assert got == {k: v[1] for k, v in cases.items() if v[1]}


def test_events(spark):
    raw = "data:he\n\ndata: llo\r\n\r\nevent: token-usage\ndata:{\"prompt\":1,\"completion\":2,\"total\":3}\n\nevent: x\n\ndata:lost"
    events = answers.decode_events(spark.createDataFrame([(1, raw), (2, None), (3, "")], "id int, raw string"), "id", "raw")
    assert [(r["event"], r["data"]) for r in events.orderBy("seq").collect()][:2] == [("message", "he"), ("message", " llo")]
    row = answers.answers(events, "id").first()
    assert row["answer"] == "he llo" and row["usage"]["total"] == 3


def test_long_sessions_are_ordered_in_slices(spark):
    both = rows(spark, 300).unionByName(rows(spark, 7, "doc:2:1").withColumn("id", F.col("id") + 1000))
    for long in (200_000, 20):
        got = {r["id"]: r["position"] for r in history.ordered(both, long=long).collect()}
        assert all(got[i] == i + 1 for i in range(300)) and all(got[1000 + i] == i + 1 for i in range(7))
        before = {r["id"]: r["before"] for r in history.tokens_before(both, F.lit(2), long=long).collect()}
        assert all(before[i] == 2 * i for i in range(300)) and before[1006] == 12


def test_long_sessions_stay_whole(spark):
    n = 2 * history.ROUNDS + 101
    both = rows(spark, n).unionByName(rows(spark, 5, "doc:2:1"))
    line = lambda i: f"{'AI: ' if i % 2 else '用户: '}m{i}\n\n"
    for long in (history.LONG, 50):
        got = {r["session_id"]: r["transcript"] for r in history.transcripts(both, long=long).collect()}
        assert got == {"doc:1:1": "".join(map(line, range(n))), "doc:2:1": "".join(map(line, range(5)))}
        kept = history.compressed(both, lambda t: t, 1, 10, long=long).filter("session_id = 'doc:1:1'").orderBy("position").collect()
        assert kept[0]["content"] == history.SUMMARY_PREFIX + "".join(map(line, range(n - 10)))
        assert [(r["position"], r["content"]) for r in kept[1:]] == [(i + 2, f"m{n - 10 + i}") for i in range(10)]
    assert history.transcripts(rows(spark, 8), rounds=1).first()["transcript"] == line(6) + line(7)


def test_citations_with_long_numbers(spark):
    df = spark.createDataFrame([(1, "see\n---\n[12345678901] far too long\n[2] 【文档：T】here")], "id long, raw string")
    got = [(r["id"], r["title"], r["snippet"]) for r in citations.citations(df, "id", "raw").orderBy("place").collect()]
    assert got == [(None, "参考来源", "far too long"), (2, "T", "here")]


def test_notices_and_system_prompts(spark):
    df = spark.createDataFrame([(1, " ", True), (2, None, False), (3, "text", True)], "id int, content string, use boolean")
    got = df.select("id", context.answer_or_notice(F.col("content"), F.lit("asked"), F.col("use")).alias("a"), context.several_prompt(F.lit("q"), F.col("content")).alias("p")).orderBy("id").collect()
    assert [r["a"] for r in got] == [context.EMPTY_DOCUMENT, "asked", "asked"]
    assert context.NO_HITS in got[1]["p"] and "\ntext\n" in got[2]["p"]
    said = df.select(context.system_prompt(F.lit("document"), F.col("use"), {"general": "own"}).alias("s"), context.system_prompt(F.lit("notebook"), F.col("use")).alias("n")).collect()
    assert {r["n"] for r in said} == {context.SYSTEM_PROMPTS["notebook"]} and "own" in {r["s"] for r in said}
