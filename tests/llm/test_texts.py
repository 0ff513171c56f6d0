import re

import numpy as np
import pytest

from folioforge.llm import leakage, mixing, sentences
from folioforge.llm.boosting import boost

ITEM = (
    "The missing curriculum summarises the transcribed laboratory whenever a reader asks for it. The tokenizer that replaces the shared handbook "
    "also duplicates the connector. In the meantime, the uploaded splitter complements the shared curriculum near the eastern entrance."
)
ZH = "如果链接表引用了合并的组织架构，那么重复的版本说明也要重新检查。目前，归档的采购清单比较了日常的流程图。已发布的版本说明遗漏了新建的复习提纲，同时拆分了版本说明。"
NOISE = "Completely different words stand here to make the text a good deal longer than the passage itself would be on its own. "


def leaks(spark, docs, items, **options):
    d = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(docs)], "doc_id long, text string, item_id string")
    e = spark.createDataFrame([(i, t) for i, t in enumerate(items)], "item_id long, text string")
    return {(r["doc_id"], r["item_id"]) for r in leakage.leaked_items(d, e, **options).collect()}


def test_leaks(spark):
    words = ITEM.split()
    altered = " ".join("xyzzy" if i % 9 == 8 else w for i, w in enumerate(words))
    sentence = re.split(r"(?<=\.) ", ITEM)
    docs = [
        NOISE + ITEM + NOISE, NOISE * 3, None, "", ITEM.upper().replace(".", " !\n"), NOISE + " ".join(words[: len(words) * 2 // 3]) + NOISE,
        " ".join(words[:9]) + NOISE, altered, " ".join(sorted(words)), ITEM.replace("a", "а").replace("e", "е"), "开头。" + ZH + "结尾。",
        ZH.replace("，", "").replace("。", "\n"), ZH[: len(ZH) // 4], NOISE * 5000 + ITEM, " ".join([*sentence[1:], NOISE, sentence[0]]),
    ]
    got = leaks(spark, docs, [ITEM, ZH, None, "", "short one"])
    assert got == {(0, 0), (4, 0), (5, 0), (7, 0), (9, 0), (10, 1), (11, 1), (13, 0), (14, 0)}
    assert leaks(spark, docs, [ITEM, ZH]) == got
    assert leaks(spark, [], [ITEM]) == set() and leaks(spark, docs, []) == set()


def test_short_and_many_items(spark):
    docs = [NOISE + "the short one. " + ITEM, "short, ONE", "one short", "开头目录更新结尾", None]
    many = [f"item number {i} of many others that are in no document at all {i * 7919}" for i in range(3000)]
    got = leaks(spark, docs, ["short one", "目录更新", ITEM, "", "...", *many])
    assert got == {(0, 0), (1, 0), (3, 1), (0, 2)}


def test_winnowing_keeps_the_guarantee():
    rng = np.random.default_rng(0)
    k, w = 5, 4
    for _ in range(200):
        shared = rng.integers(0, 50, k + w - 1).astype(np.uint64)
        a = np.r_[rng.integers(0, 50, 20), shared, rng.integers(0, 50, 20)].astype(np.uint64)
        b = np.r_[rng.integers(0, 50, 7), shared, rng.integers(0, 50, 3)].astype(np.uint64)
        ha, hb = leakage.gram_hashes(a, k), leakage.gram_hashes(b, k)
        assert set(ha[leakage.winnow(ha, w)]) & set(hb[leakage.winnow(hb, w)])


def test_raking():
    cells = [("a", "en", 0, 600), ("a", "de", 1, 300), ("b", "en", 0, 80), ("b", "de", 1, 20), ("c", "en", 1, 1000), ("x", "en", 0, 500)]
    plan = mixing.rake(cells, [("a", 0.5, 3), ("b", 0.2, 2), ("c", 0.3, 1), ("d", 0.0, 1)])
    report = {r[0]: r for r in plan.report}
    total = 2000
    assert report["b"][6] and abs(report["b"][4] - 200) < 1e-3  # two copies stay below a fifth
    assert not report["a"][6] and abs(report["a"][4] - 0.5 * total) < 1 and abs(report["c"][4] - 0.3 * total) < 1
    assert all(0 <= w <= {"a": 3, "b": 2, "c": 1}[s] + 1e-9 for s, _, _, w in plan.weights)
    assert abs(sum(r[5] for r in plan.report) - 1) < 1e-9
    assert mixing.rake([], [("a", 1.0, 1)]).report[0][5] == 0.0


def test_mixture(spark):
    pytest.importorskip("public_tokenizers")
    docs = [(i, "word " * 20, "en", "big", i % 7) for i in range(300)] + [(1000 + i, "word " * 20, None, "small", None) for i in range(20)]
    docs += [(2000, None, "en", "big", 1), (2001, "word", "en", None, 1), (2002, "word", "en", "other", 1)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, notebook_id long")
    targets = spark.createDataFrame([("big", 0.7, 1), ("small", 0.3, 3), ("absent", 0.1, 1), (None, 0.5, 1)], "source string, target_share double, max_repeat int")
    report = {r["source"]: r for r in mixing.mixture_report(df, targets).collect()}
    assert set(report) == {"big", "small", "absent"} and report["small"]["short"] and report["absent"]["short"] and not report["big"]["short"]
    drawn = mixing.mixture(df, targets)
    assert drawn.filter("source = 'small'").agg({"copies": "min"}).first()[0] == 3
    assert 0.6 < drawn.filter("source = 'big'").count() / 300 < 0.8
    again = mixing.mixture(df.repartition(7), targets)
    assert sorted(map(tuple, drawn.collect())) == sorted(map(tuple, again.collect()))
    assert mixing.mixture_report(df.limit(0), targets).filter("reached_share > 0").count() == 0


def test_long_text_is_counted_whole():
    pytest.importorskip("public_tokenizers")
    encoder = mixing.Vocabulary().encoder()
    text = "some words here " * 20_000
    assert abs(mixing._size(encoder, text) - len(encoder.encode_ordinary(text))) < 10


MODEL = sentences.Model(starters=frozenset({"The", "When"}), openers=frozenset({"mdpack"}), inner=frozenset({"Mai", "Quartal", "or", "the", "หน้า", "ขนาด"}))
SENTENCES = [
    ["The first one, e.g. this.", "The second at 5.52 a.m. in the hall!", "Dr. Menkiri came.", "mdpack runs."],
    ["It cost 5,557.66 units, i.e. 53.85 each.", "He asked: “Is it ready?”", "“Yes.”", "The end..."],
    ['"Is the pipeline ready?" asked Prof. Menkiri.', '"Stop! The handbook is lost," wrote Ms. Ruvesta.', "The rest ... or so it seems."],
    ["Am 27. Mai beginnt es, z. B. heute.", "„Der Anhang fehlt!“, schrieb Dr. Faldane.", "Im 2. Quartal waren es 7.102 Seiten, vgl. Abb. 9.", "Ende usw.", "Die Vorlage folgt."],
    ["« Où est le mémento ? » demanda Mme Velmora.", "M. Sorvick cite env. 25,7 % des pages, cf. fig. 5.", "Il écrit : « Le plan est prêt. »", "La fin."],
    ["¿Está listo?", "«¿Está listo el anexo?», preguntó el Dr. Quivarn.", "¡Por fin!", "La Sra. Hastorin anotó aprox. 2.395 páginas (véase pág. 73)."],
]
WIDE = [
    ["“索引准备好了吗？”佴主任又一次问道。", "所谓“笔记本……”其实说明了模板。", "（按照新的规定，段落更新了。）", "佴主任说：“目录更新了。”", "自v3.5起，附录更新了（见config.yaml）……", "真的吗？！"],
    ["「担当者の依頼で、更新した。」と担当者が述べた。", "索引は5.2倍になり、更新した……。", "なぜか？"],
    ["पुराना अभिलेख बदलता है।", "क्या सूचकांक तैयार है?", "लगभग 82.61 प्रतिशत।"],
]


def pieces(text):
    return [text[a:b] for a, b in sentences.split_sentences(text, MODEL)]


@pytest.mark.parametrize("parts", SENTENCES)
def test_sentences_latin(parts):
    assert pieces(" ".join(parts)) == parts


@pytest.mark.parametrize("parts", WIDE)
def test_sentences_wide(parts):
    glue = " " if parts[0][0] == "प" else ""
    assert pieces(glue.join(parts)) == parts


def test_lines():
    text = "# Heading\n\nSome heading line\nThe text runs on and is wrapped at the end of a line of this\nlength. The next.\n1. an item of a list\n2. another one. With two.\n- third\n\nLast paragraph without end"
    assert pieces(text) == [
        "# Heading", "Some heading line", "The text runs on and is wrapped at the end of a line of this\nlength.", "The next.",
        "1. an item of a list", "2. another one. With two.", "- third", "Last paragraph without end",
    ]
    thai = "คู่มือใช้ draft.docx ขนาด 9.88 MB ดัชนีฉบับใหม่สรุป 36 หน้า คลังข้อมูลใหม่"
    assert pieces(thai)[-1] == "คลังข้อมูลใหม่"


def test_sentences_cover_everything(spark):
    rng = np.random.default_rng(1)
    parts = ["The end.", " ", "\n", "\n\n", "“", "”", "。", "问？", "Dr.", "a.m.", "  x  ", "(", ")", "...", "1. ", "# h", "ไทย", "　", "Zu", "«", "»", '"', "3.5"]
    texts = ["".join(rng.choice(parts, rng.integers(0, 40))) for _ in range(500)]
    for t in texts:
        spans = sentences.split_sentences(t, MODEL)
        assert re.sub(r"\s", "", "".join(t[a:b] for a, b in spans)) == re.sub(r"\s", "", t)
        assert all(t[a:b] == t[a:b].strip() and a < b for a, b in spans)
        assert all(x[1] <= y[0] for x, y in zip(spans, spans[1:]))
    df = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, "  ", 0), (4, "One. Two.", 0), (5, "word. " * 50_000, 0)], "doc_id long, text string, start_pos int")
    counts = {r["doc_id"]: r["count"] for r in sentences.sentences(df).groupBy("doc_id").count().collect()}
    assert counts[4] == 2 and set(counts) == {4, 5}
    assert sentences.sentences(df.limit(0)).count() == 0


def test_boosting():
    rng = np.random.default_rng(0)
    x = rng.random((2000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(int)
    model = boost(x[:1500], y[:1500])
    assert ((model.probability(x[1500:]) > 0.5) == y[1500:]).mean() > 0.97


def test_sentences_over_many_candidates():
    import random

    from folioforge.llm import sentences as se

    wrapped = "\n".join(["the report goes on with another line of the same long sentence"] * 30) + " and ends here."
    assert se.split_sentences(wrapped, se.Model()) == [(0, len(wrapped))]
    initials = "It was written by " + " ".join(f"{c}." for c in "ABCDEFGHIJKLMNOPQ") + " Smith in the end."
    assert se.split_sentences(initials, se.Model()) == [(0, len(initials))]

    def total(found, begin, depths, back):
        value, j = 0.0, len(found)
        while j:
            i = back[j]
            value += found[j - 1][0] + se._length(found[j - 1][1] - (found[i - 1][2] if i else begin)) - 4 * bool(depths and depths[i] != depths[j])
            j = i
        return value

    rng = random.Random(2)
    for n in range(1, 200):
        at, found = 0, []
        for _ in range(n):
            left = at + rng.choice([1, 2, 5, 40, 150, 450])
            at = left + rng.randint(0, 2)
            found.append((rng.choice([-6.0, -4.0, -3.0, -0.5, 1.5, 2.0, 3.0]), left, at))
        found.append((0.0, at + 30, at + 30))
        for depths in (None, [0, *(rng.choice([0, 0, 1, 2]) for _ in found)]):
            want = total(found, 0, depths, se._every_span(found, 0, depths))
            assert abs(total(found, 0, depths, se._many_spans(found, 0, depths)) - want) < 1e-6


def test_wrapped_lines_without_spaces():
    text = "背景说明\n目前归档的采购清单比较了日常的流程\n图并且遗漏了新建的复习提纲同时拆分了\n版本说明。之后的一句话很短。\n\n下一个标题\n再来一句。"
    assert pieces(text) == ["背景说明", "目前归档的采购清单比较了日常的流程\n图并且遗漏了新建的复习提纲同时拆分了\n版本说明。", "之后的一句话很短。", "下一个标题", "再来一句。"]


def test_sentences_take_linear_time():
    import time

    for piece in ('He said "no." Then (he went.) On ', "“Yes.” ", "a.) ", "他说”。", "z. B. « oui. » "):
        began = time.time()
        sentences.split_sentences(piece * 20_000, MODEL)
        assert time.time() - began < 30, piece


def test_topics_are_raked_themselves(spark):
    cells = [("a", "en", f"t{i}", 100 + i) for i in range(200)] + [("b", "en", f"t{i}", 50) for i in range(200)]
    plan = mixing.rake(cells, [("a", 0.5, 2), ("b", 0.5, 3)])
    assert max(plan.residuals) < 1e-3 and len({w[2] for w in plan.weights}) == 200
    capped = mixing.rake([("a", "en", "x", 100), ("b", "de", "y", 100)], [("a", 0.9, 9), ("b", 0.1, 1)])
    assert capped.residuals[0] > 0.3
