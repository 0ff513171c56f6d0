import random

import pytest
from pyspark.sql import functions as F

from folioforge.functions import text as fn
from folioforge.operators import chunking, cleaning

CASES = [
    ("web", "  \x00标题\x07  \n\n\n\n  正文内容  ", "标题\n\n正文内容"),
    ("web", "公司内部资料\n正文一\n公司内部资料\n正文二\n公司内部资料\n正文三", "正文一\n正文二\n正文三"),
    ("web", "S e c r e t L e v e l\n这是需要保留的正文", "这是需要保留的正文"),
    ("web", "# 项目说明", "# 项目说明"),
    ("desktop", "  第一行\x00\x07  \n\t第二行\t  ", "第一行\n第二行"),
    ("desktop", "课程讲义\n第一部分\n课程讲义\n第二部分\n课程讲义\n第三部分", "第一部分\n第二部分\n第三部分"),
    ("desktop", "开头\n水 印 文 字 水 印 文 字\n结尾", "开头\n结尾"),
    ("desktop", "第一段\n\n\n\n第二段", "第一段\n\n第二段"),
    ("desktop", None, ""),
    ("desktop", "", ""),
    ("web", "a\n \n \nb", "a\n\n\nb"),
    ("desktop", "a\n \n \nb", "a\n\nb"),
    ("web", "H\nx\n\nH\n\ny\nH\nz", "x\n\n\ny\nz"),
    ("desktop", "H\nx\n\nH\n\ny\nH\nz", "x\n\ny\nz"),
    ("web", "constructor", "constructor"),
]


@pytest.mark.parametrize("variant,raw,expected", CASES)
def test_clean(spark, variant, raw, expected):
    df = spark.createDataFrame([(raw,)], "t string")
    assert df.select(cleaning.clean_text(F.col("t"), variant)).first()[0] == expected


def literal_clean(text, variant):
    import re

    web = variant == "web"
    chars = fn.STRIP_WEB if web else fn.STRIP_DESKTOP
    text = re.sub(r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "", text or "")
    if web:
        text = re.sub("\n{3,}", "\n\n", text)
    lines = text.split("\n")
    lines = [x for x in lines if not (len(x.strip(chars)) >= 12 and x.strip(chars).count(" ") / len(x.strip(chars)) > 0.4)]
    counts = {}
    for x in lines:
        counts[x.strip(chars)] = counts.get(x.strip(chars), 0) + 1
    lines = [x.strip(chars) for x in lines if not x.strip(chars) or counts[x.strip(chars)] < 3]
    text = "\n".join(lines)
    if not web:
        text = re.sub("\n{3,}", "\n\n", text)
    return text.strip(fn.TRIM_WEB if web else fn.TRIM_DESKTOP)


def test_clean_random(spark):
    rng = random.Random(4)
    words = ["a", " b ", "\n", "\n\n", "H", "w a t e r m a r k x", "\x07", "　", " ", "正文", "\r\n", "\t"]
    texts = ["".join(rng.choices(words, k=rng.randint(0, 40))) for _ in range(300)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for variant in ("web", "desktop"):
        rows = df.select("i", cleaning.clean_text(F.col("t"), variant).alias("c")).collect()
        for r in rows:
            assert r["c"] == literal_clean(texts[r["i"]], variant), texts[r["i"]]


def test_semantic_splitter_cases():
    split = lambda t, size: chunking.split_semantic(t, size, 2, list)
    assert split("abcd\n\nefgh\n\nijklmnop", 10) == ["abcd\n\nefgh\n\n", "\n\nijklmnop"]
    assert split("甲乙丙。丁戊。己庚辛壬癸子丑。", 6) == ["甲乙丙。", "丙。丁戊。", "戊。己庚辛壬癸子丑。"]
    assert split("甲乙丙丁戊。己。\n\n庚辛", 6) == ["甲乙丙丁戊。", "戊。己。庚辛\n\n"]
    assert split("", 6) == [] and split("  \n ", 6) == []


def test_chunks(spark):
    docs = spark.createDataFrame([(10, "short text"), (11, None), (12, "   "), (13, "x " * 700)], "id long, t string")
    rows = chunking.sliding_chunks(docs, "id", "t", 128, 16).orderBy("doc", "ordinal").collect()
    assert rows[0]["id"] == "doc:10:chunk:0" and rows[0]["text"] == "short text"
    assert {r["doc"] for r in rows} == {10, 13}
    tokens = chunking.simple_tokens("x " * 700)
    expected, start = [], 0
    while True:
        expected.append("".join(tokens[start : start + 128]))
        if start + 128 >= len(tokens):
            break
        start += 112
    assert [r["text"] for r in rows if r["doc"] == 13] == expected
    semantic = chunking.semantic_chunks(docs, "id", "t").collect()
    assert {r["doc"] for r in semantic} == {10, 13}
    counted = chunking.chunk_counts(chunking.sliding_chunks(docs, "id", "t", 128, 16), docs.withColumn("chunk_count", F.lit(-1)), "id")
    assert {r["id"]: r["chunk_count"] for r in counted.collect()} == {10: 1, 11: -1, 12: -1, 13: len(expected)}


def test_tokenizer_is_lossless():
    rng = random.Random(1)
    for _ in range(200):
        t = "".join(rng.choice("ab é中文\n\t　0_-。𝒳") for _ in range(30))
        assert "".join(chunking.simple_tokens(t)) == t


def test_small_functions(spark):
    df = spark.createDataFrame([("a😀b", 1536, "x.tar.GZ", "#notebook/3/document/9")], "s string, n long, f string, r string")
    row = df.select(
        fn.utf16_length(F.col("s")), fn.size_label(F.col("n")), fn.extension(F.col("f")), fn.stem(F.col("f")), fn.route_ids(F.col("r")),
        fn.token_estimate(F.lit("1234567"), "web"), fn.token_estimate(F.lit("1234567"), "desktop"), fn.usage_cost(F.lit(12345)),
        fn.merged_content(F.lit("补充说明"), F.lit("提取出的正文")), fn.merged_content(F.lit("  "), F.lit("x")),
        fn.occurrences(F.lit("aaaa"), F.lit("aa")), fn.date_label(F.lit(None).cast("timestamp")), fn.html_escape(F.lit("<a & 'b'>")),
    ).first()
    assert list(row[:4]) == [4, "1.5 KB", "gz", "x.tar"] and tuple(row[4]) == (3, 9)
    assert list(row[5:]) == [9, 10, "0.0185", "补充说明\n\n---\n\n提取出的正文", "x", 2, "未知时间", "&lt;a &amp; &#39;b&#39;&gt;"]


def test_lengths_in_utf16_units(spark):
    rows = [("a😀b" * 4, 6), ("plain text", 5), ("😀😀", 3), ("😀😀", 4), ("中文字", 2), ("", 3), (None, 3)]
    for text, n in rows:
        df = spark.createDataFrame([(text,)], "c string").select(fn.utf16_length(F.col("c")), fn.utf16_prefix(F.col("c"), n))
        length, prefix = df.first()
        if text is None:
            assert length is None and prefix is None
            continue
        units = text.encode("utf-16-be")
        assert length == len(units) // 2 and prefix == units[: 2 * n].decode("utf-16-be", "ignore"), (text, n)


def test_routes_with_long_numbers(spark):
    df = spark.createDataFrame([("#notebook/99999999999999999999/document/3",), ("#notebook/4/document/5",), ("x",)], "r string")
    got = [tuple(r[0]) for r in df.coalesce(1).select(fn.route_ids(F.col("r"))).collect()]
    assert got == [(None, 3), (4, 5), (None, None)]
