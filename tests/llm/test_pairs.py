import datetime as dt

import pytest

from folioforge.llm import pairs
from folioforge.llm.conversations import conversations, dropped_sessions, resolve_paths
from folioforge.llm.languages import language_of
from folioforge.llm.messages import in_sessions, sliced

SCHEMA = "id long, session_id string, role string, content string, create_time timestamp_ntz, session string"
T0 = dt.datetime(2026, 1, 1)
LONG = "The index is rebuilt every night. The collection is part of the index."


def chat(spark, rows):
    """rows of (session, role, content), one minute apart; ``session`` is an extra column with a clashing name."""
    return spark.createDataFrame([(i, s, r, c, T0 + dt.timedelta(minutes=i), "x") for i, (s, r, c) in enumerate(rows)], SCHEMA)


def found(spark, rows):
    base = [("base", "user", "What is the index of the collection about?"), ("base", "assistant", LONG)] * 30
    got = pairs.broken_pairs(chat(spark, rows + base)).collect()
    assert len({r["message_id"] for r in got}) == len(got)
    return {r["message_id"]: r["defect"] for r in got if r["message_id"] < len(rows)}


QUESTION = "What does the document say about the index of the collection?"


def test_defects(spark):
    answers = [
        None, "", "N/A", "（无）", "—", "​",
        "I'm sorry, but I can't help with that request.", "很遗憾，我无法回答关于模板的问题。",
        QUESTION.lower(), "> " + QUESTION, "You asked: " + QUESTION,
        "Das Verzeichnis der Sammlung wird jede Nacht neu erstellt und geprüft.",
        "The index is rebuilt every night. The collection is re", "The index (see", "The index is rebuilt. The collection is the",
        LONG, "Sorry for the delay: the index is rebuilt every night.", "The index", QUESTION + "\nThe index is rebuilt every night, and the collection too.",
    ]
    rows = [x for i, a in enumerate(answers) for x in ((f"s{i}", "user", QUESTION), (f"s{i}", "AI ", a))]
    got = found(spark, rows)
    kinds = [got.get(2 * i + 1) for i in range(len(answers))]
    assert kinds == ["empty"] * 6 + ["refusal"] * 2 + ["copy"] * 3 + ["wrong_language"] + ["truncated"] * 3 + [None] * 4


def test_adjacency(spark):
    rows = [
        ("a", "user", QUESTION), ("a", "system", "note"), ("A ", "assistant", None),  # a system row does not part them
        ("b", "user", QUESTION), ("b", "tool", "x"), ("b", "assistant", None),  # an unreadable one does
        ("c", "user", "N/A"), ("c", "assistant", None),  # not a question
        (None, "user", QUESTION), (None, "assistant", None),
        ("d", "user", QUESTION), ("d", "assistant", LONG), ("d", "assistant", None),
    ]
    assert found(spark, rows) == {2: "empty"}


def test_translation_may_change_language(spark):
    rows = [("a", "user", "请翻译成德文：目录每天更新"), ("a", "assistant", "Das Verzeichnis wird jeden Tag neu erstellt und geprüft."),
            ("b", "user", "请翻译成法文：目录每天更新"), ("b", "assistant", "Das Verzeichnis wird jeden Tag neu erstellt und geprüft.")]
    assert found(spark, rows) == {3: "wrong_language"}


def test_empty_table(spark):
    assert pairs.broken_pairs(chat(spark, [])).count() == 0
    assert dropped_sessions(chat(spark, [])).count() == 0
    assert conversations(chat(spark, [])).count() == 0


@pytest.mark.parametrize("text,language", [("Le carnet de la chaire est rangé dans la salle", "fr"), ("Die Vorlage wird geprüft und sortiert", "de"),
    ("La minuta del archivo está en la sala", "es"), ("The index and the collection were merged", "en"), ("目录已更新", "zh"), ("索引を更新した。", "ja"), ("ดัชนี", "th"), ("सूचकांक", "hi"), ("42", "")])
def test_languages(text, language):
    assert language_of(text)[0] == language


def test_shortened_versions_across_partitions(spark):
    texts = [f"{c}{i} alpha beta" for c in "abcdefgh" for i in range(40)]
    texts += ["h39 alpha", "a0 alpha be", "c7 alp", "zz", "zzz"]
    df = spark.createDataFrame([(t, True) for t in texts + texts], "answer string, says boolean")
    got = {r["answer"]: r["inside_word"] for r in pairs.shortened_versions(df).collect()}
    assert got == {"h39 alpha": False, "a0 alpha be": True, "c7 alp": True, "zz": True}


def test_length_limit(spark):
    rows = [(i, None, "ask", "w", "x", 150 + i % 40) for i in range(200)] + [(1000 + i, None, "ask", "w", "x", 170) for i in range(100)]
    df = spark.createDataFrame(rows, "message_id long, defect string, state string, unit string, answer string, length int")
    assert [r["length"] for r in pairs.length_limits(df).collect()] == [170]


def reasons(rows):
    """Brute force over one session's (role, says) in order."""
    kept = [r for r, says in rows if r != "system" and says]
    if not kept:
        return "empty"
    if "unreadable" in kept or kept[0] == "assistant" or any(a == b == "assistant" for a, b in zip(kept, kept[1:])):
        return "broken"
    if any(a == "user" and b != "assistant" for a, b in zip(kept, kept[1:] + [None])):
        return "missing_reply"
    return None


def test_sessions_against_brute_force(spark):
    import random

    rng = random.Random(5)
    spelt = {"user": ["user", "USER ", "用户"], "assistant": ["assistant", "bot"], "system": ["system"], "unreadable": ["tool", None, ""]}
    rows, expected = [], {}
    for s in range(150):
        own = []
        for _ in range(rng.randint(1, 40)):
            last = own[-1][0] if own else "assistant"
            role = ("assistant" if last == "user" else "user") if rng.random() < 0.97 else rng.choice(list(spelt))
            own.append((role, rng.random() < 0.97))
        expected[f"s{s}"] = reasons(own)
        rows += [(rng.choice([f"s{s}", f" S{s}"]), rng.choice(spelt[r]), "text" if says else rng.choice([None, "null", "..."])) for r, says in own]
    df = chat(spark, rows)
    df = df.unionByName(df.filter("id % 7 = 0"))  # exact repeats
    want = {k: v for k, v in expected.items() if v}
    for limit in (200_000, 10):  # also with sessions cut into slices
        got = {r["session_id"]: r["reason"] for r in dropped_sessions(df, limit).collect()}
        assert got == want
    kept = conversations(df).collect()
    assert {r["session_id"] for r in kept} == {k for k, v in expected.items() if v is None}
    one = sorted((r["turn"], r["role"]) for r in kept if r["session_id"] == kept[0]["session_id"])
    assert [t for t, _ in one] == list(range(len(one))) and one[0][1] == "user"


def test_slices_keep_neighbours(spark):
    rows = [("long", "user" if i % 2 == 0 else "assistant", None if i % 50 == 1 else LONG if i % 2 else QUESTION) for i in range(400)] + [("s", "user", QUESTION), ("s", "assistant", LONG)]
    df = chat(spark, rows)
    cut = sliced(in_sessions(df), df, 50)
    assert cut.filter("session = 'long'").select("slice").distinct().count() > 4
    whole = {tuple(r) for r in pairs.broken_pairs(df).collect()}
    assert {tuple(r) for r in pairs.broken_pairs(df, 50).collect()} == whole and len(whole) == 8


def test_paths(spark):
    links = [(1, None), (2, 1), (3, 2), (4, 99), (5, 4), (10, 11), (11, 12), (12, 10), (13, 10), (20, 20)] + [(i, i - 1) for i in range(101, 140)] + [(100, None)]
    got = {r["node"]: (r["root"], r["depth"], r["fate"]) for r in resolve_paths(spark.createDataFrame(links, "node long, parent long")).collect()}
    assert got[3] == (1, 2, "rooted") and got[1] == (1, 0, "rooted")
    assert got[4] == (4, 0, "orphan") and got[5] == (4, 1, "orphan")
    assert all(got[i] == (None, None, "cycle") for i in (10, 11, 12, 13, 20))
    assert got[139] == (100, 39, "rooted")
    assert resolve_paths(spark.createDataFrame([], "node long, parent long")).count() == 0


def test_long_texts_and_missing_ids(spark):
    import time

    began = time.time()
    huge = "ich kann es sehen und je ne sais I can't say " * 20_000
    assert not pairs.is_refusal(huge) and pairs.is_copy(huge, huge + "x") and not pairs.is_wrong_language(huge, huge)
    pairs.ending_of("(" * 100_000 + "word")
    assert time.time() - began < 20
    df = spark.createDataFrame([(1, "s", "user", QUESTION, T0, "x"), (None, "s", "assistant", None, T0 + dt.timedelta(1), "x"), (None, None, None, None, None, None)], SCHEMA)
    assert pairs.broken_pairs(df).count() == 0
    assert {tuple(r) for r in dropped_sessions(df).collect()} == {("s", "missing_reply")}


def test_rules_hold_at_every_length(spark):
    from pyspark.sql import functions as F

    from folioforge.llm import messages, pairs

    words = [f"w{i % 700}x{i % 11}" for i in range(3000)]
    question = " ".join(words)
    assert pairs.is_copy(question, " ".join(w for i, w in enumerate(words) if i % 8))  # 87 % of the words
    assert not pairs.is_copy(question, " ".join(words[1500:] + words[:1500]))
    assert not pairs.is_copy(question, " ".join(words[::-1]))
    assert pairs.is_copy("What is the plan?", " ".join(["What is the plan?"] * 12))
    assert not pairs.is_copy("What is the plan?", "The plan is to move all books. " * 40)
    refusal = "I'm sorry. I cannot help with that request. " * 60
    assert pairs.is_refusal(refusal) and not pairs.is_refusal(refusal + "The books are on the second floor of the house.")
    assert pairs.in_order(list("abcbdab"), list("bdcaba")) == 4

    rows = [("null" + " " * 60,), ("-" * 50 + " N/A " + "." * 50,), ("a long content that says something, and goes on",), ("ok" + "." * 60,), ("-" * 60,)]
    got = [r[0] for r in spark.createDataFrame(rows, "c string").coalesce(1).select(messages.says_something(F.col("c"))).collect()]
    assert got == [False, False, True, True, False]


def test_truncation_by_evidence(spark):
    whole = "The index of the collection lists every book of the archive and where it stands"
    answers = [whole[:30], whole + ".", whole[:27] + "...", "The index (see the second", LONG + " The collection is the"]
    rows = [x for i, a in enumerate(answers) for x in ((f"s{i}", "user", QUESTION), (f"s{i}", "assistant", a))]
    rows += [("t", "user", QUESTION), ("t", "assistant", "The index of the collection")]  # a short answer, for all we know
    base = [("base", "user", "What is the index of the collection about?"), ("base", "assistant", LONG)] * 30
    paired, judged = pairs.judged_pairs(chat(spark, rows + base))
    got = {r["message_id"]: r["evidence"] for r in pairs.truncations(paired, judged).collect()}
    assert got == {1: "prefix", 7: "ending", 9: "ending"}


def test_copies_are_no_limit(spark):
    text = "the register of the reading room is kept by the librarian of the house and nobody else"
    rows = [x for i in range(120) for x in ((f"s{i}", "user", QUESTION), (f"s{i}", "assistant", text))]
    limited = [x for i in range(120) for x in ((f"r{i}", "user", QUESTION), (f"r{i}", "assistant", f"{i:03d} books and {i * 7919 % 100003:06d} maps of the archive are the"))]
    paired, judged = pairs.judged_pairs(chat(spark, rows + limited))
    got = {r["message_id"]: r["evidence"] for r in pairs.truncations(paired, judged).collect()}
    assert {k for k, e in got.items() if e == "limit"} == {2 * len(rows) // 2 + 2 * i + 1 for i in range(120)}
