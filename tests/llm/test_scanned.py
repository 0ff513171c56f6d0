import numpy as np
import pytest

from folioforge.llm import scanned as sc

WORDS = "index collection reading library catalogue document translation inventory specification department repository conversation archive semester building provisional temporary".split()
COMPOUNDS = ["read-only", "follow-up", "step-by-step", "cross-reference"]


def corpus(spark, pages):
    rng = np.random.default_rng(0)
    texts = [" ".join(rng.choice(WORDS, 60)) + ". " + " ".join(f"a {c} note" for c in COMPOUNDS) for _ in range(60)]
    texts += ["文档标签更新了会议记录。检查文档标签和会议记录，说明文档标签。会议记录说明了文档标签的更新。"] * 30
    rows = [(1000 + i, None, t, "A plain title") for i, t in enumerate(texts)] + [(i, p, None, "Some title of a page") for i, p in enumerate(pages)]
    return spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, content string, text string, title string, defect string")


BODY = ["the index of the collection is in the reading", "library and the catalogue of the document is a", "translation of the inventory for the archive."] * 4
PAGED = "\n".join(
    ["Yearly Catalogue Review", *BODY, "- 1 -", "YEARLY CATALOGUE REVIEW", *BODY, "- 2 -", "Yearly Cata1ogue Review", *BODY, "- 3 -"]
)
SPLIT = "the index of the collec-\ntion is kept and the follow-\nup note of the repo­\nsitory ends."
MISREAD = "the inclex of the c0llection is\nhere and the librarv too."
ZH = "会议记绿说明了文档标签的更\n新。会议记绿说明了文挡标签。会议记绿"


def test_noise(spark):
    df = corpus(spark, [PAGED, SPLIT, MISREAD, ZH, None, "", "plain text of the library", "2001\n489.1\n17 %"])
    got = {}
    for r in sc.page_noise(df).collect():
        got.setdefault(r["doc_id"], set()).add((r["line_no"], r["defect"]))
    n = len(BODY)
    heads = {1, n + 3, 2 * n + 5}
    assert got[0] == {(i, "header") for i in heads} | {(n + 2, "page_number"), (2 * n + 4, "page_number"), (3 * n + 6, "page_number")}
    assert got[1] == {(1, "split_word"), (3, "split_word")}
    assert {(1, "misread")} <= got[2] <= {(1, "misread"), (2, "misread")}
    assert {x for x in got[3] if x[1] == "misread"} == {(1, "misread"), (2, "misread")}
    assert set(got) == {0, 1, 2, 3}
    fixed = {r["doc_id"]: r["repaired"] for r in sc.repaired_pages(df).collect()}
    assert "the index of the collection is kept and the follow-up note of the repository ends." == fixed[1]
    assert "index of the collection" in fixed[2] and "Review" not in fixed[0] and "- 2 -" not in fixed[0]
    assert "会议记录说明了文档标签的更新。" in fixed[3]
    assert 4 not in fixed and fixed[6] == "plain text of the library"


def test_empty_corpus(spark):
    df = corpus(spark, []).limit(0)
    assert sc.page_noise(df).count() == 0


@pytest.mark.parametrize(
    "lines,want",
    [
        (["a", "b", "c", "1", "a", "b", "c", "2"], {3: 1, 7: 2}),
        (["x", "y", "z", "2001", "489.1", "17 %", "x", "y", "2009", "12.5"], {}),
        (["x", "y", "z", "第 1 页", "x", "y", "z", "第 2 页"], {3: 1, 7: 2}),
        (["x", "y", "z", "i", "x", "y", "z", "ii", "x", "y", "z", "iii"], {3: 1, 7: 2, 11: 3}),
        (["x", "y", "z", "[l34]", "x", "y", "z", "[135]"], {3: 134, 7: 135}),
        (["x", "y", "Page 1 of 9"], {2: 1}),
    ],
)
def test_page_numbers(lines, want):
    assert sc.page_numbers(lines) == want


def test_classifiers_on_held_out_examples():
    rng = np.random.default_rng(7)
    ranker = sc.train_words([(w, 100) for w in WORDS])
    right = []
    for w in WORDS:
        bad = sc._damaged_word(w, rng)
        if bad != w:
            shared = len(set(sc.grams(bad)) & set(sc.grams(w)))
            right.append(ranker.probability(np.array([sc.word_features(bad, w, 1, 100, shared)]))[0] > 0.5)
        other = WORDS[(WORDS.index(w) + 1) % len(WORDS)]
        right.append(ranker.probability(np.array([sc.word_features(w, other, 50, 100, len(set(sc.grams(w)) & set(sc.grams(other))))]))[0] < 0.5)
    assert np.mean(right) > 0.9
    joins = sc.train_joins([(w, 100) for w in WORDS], [(c, 50) for c in COMPOUNDS])
    assert joins.probability(np.array([sc.join_features(80, 0, 0, 0, "seme", "ster", "-")]))[0] > 0.5
    assert joins.probability(np.array([sc.join_features(0, 60, 60, 60, "read", "only", "-")]))[0] < 0.5


def test_confusion_distance():
    assert sc.confusion_distance("inclex", "index") < 0.5 and sc.confusion_distance("index", "index") == 0
    assert sc.confusion_distance("inbex", "index") >= 0.9 and sc.confusion_distance("abc", "abcdef") == 2.0


def test_long_contents_stay_linear():
    import time

    model = sc.train_furniture(["A title"], ["a line of text"])
    began = time.time()
    for line in (lambda i: f"item {i} of a list", lambda i: str(i % 50), lambda i: f"Copy - Title {i}"):
        sc.find_furniture([line(i) for i in range(20_000)], model)
    assert time.time() - began < 30


def test_hits_of_the_filter_are_settled(spark):
    df = corpus(spark, [MISREAD, ZH, "会议\n记绿\n说明", "plain text of the library"])
    reader = sc.learn_reader(df)
    want = sorted(sc.page_noise(df, reader=reader).collect())
    assert {r["doc_id"] for r in want if r["defect"] == "misread"} >= {0, 1}
    reader.known = sc.KnownUnits(np.full(1 << 10, 2**64 - 1, np.uint64), 1 << 16)  # holds everything
    assert sorted(sc.page_noise(df, reader=reader).collect()) == want


def test_copies_and_rare_words(spark):
    one = corpus(spark, [MISREAD])
    extra = [(2000 + i, None, "the quadrangle of the library", "A plain title", "clash") for i in range(sc.KNOWN)]
    rare = [(3000, "here the quadrang1e of the library is\na reading", None, "Some title", "clash")]
    copies = [(4000 + i, MISREAD, None, "Some title", "clash") for i in range(300)]
    df = one.unionByName(spark.createDataFrame(extra + rare + copies, one.schema))
    got = {(r["doc_id"], r["a"], r["b"]) for r in sc.page_noise(df).collect() if r["defect"] == "misread"}
    single = {(a, b) for d, a, b in got if d == 0}
    assert ("inclex", "index") in single
    assert all({(a, b) for d, a, b in got if d == 4000 + i} == single for i in range(300))
    assert (3000, "quadrang1e", "quadrangle") in got


def test_titles_are_found_among_all():
    many = sc.TitleIndex()
    many.add("section of the catalogue", "header")
    for i in range(200):
        many.add(f"sect{i * 7919 % 100_003:011d}{chr(97 + i % 26) * 5}ogue")
    assert many.find("section of the cata1ogue") == "header"
    short = sc.TitleIndex()
    short.add("标注过问答记录")
    assert short.find("标注过.答记录") is True

    rng = np.random.default_rng(4)
    for size in (5, 60):
        titles = ["".join(rng.choice(list("abc"), rng.integers(1, 24))) for _ in range(size)]
        index = sc.TitleIndex()
        for i, title in enumerate(titles):
            index.add(title, i)
        for _ in range(400):
            bad = list(titles[rng.integers(size)])
            for _ in range(rng.integers(1, 5)):
                at, kind = int(rng.integers(len(bad) + 1)), rng.integers(3)
                bad[at : at + int(kind > 0)] = list("abcd"[rng.integers(4)]) if kind < 2 else []
            read = "".join(bad)
            want = any(sc.similarity(read, t) >= 0.8 for t in titles)
            assert (index.find(read) is not None) == want, (read, titles)


def test_many_alike_titles_compared_at_once():
    index = sc.TitleIndex()
    titles = [f"chapter {i:03d} " + "".join(np.random.default_rng(i).choice(list("abcdefgh"), 12)) for i in range(300)]
    for title in titles:
        index.add(title, title)
    for title in titles[:60]:
        assert index.find(title[:12] + "0" + title[13:]) is not None
        assert index.find(title + "x") is not None


def test_only_the_character_in_its_context_is_corrected():
    noise = [{"line_no": 1, "defect": "misread", "a": "末", "b": "未", "at": 2}]
    assert sc._repair("周末末来", noise) == "周末未来"


def test_paragraphs_come_out_whole():
    raw = "Title of it\nThe cata-\nlogue is wcll\nkept.\n\n  Next one\nends.\n- 1 -\nTITLE OF IT\nSo it\ngoes on."
    noise = [
        {"line_no": 1, "defect": "header", "a": None, "b": None, "at": -1},
        {"line_no": 8, "defect": "page_number", "a": None, "b": None, "at": -1},
        {"line_no": 9, "defect": "header", "a": None, "b": None, "at": -1},
        {"line_no": 2, "defect": "split_word", "a": "cata", "b": "logue", "at": -1},
        {"line_no": 3, "defect": "misread", "a": "wcll", "b": "well", "at": -1},
    ]
    assert sc._repair(raw, noise) == "The catalogue is well kept.\n\nNext one ends. So it goes on."


def test_headers_are_decided_by_the_classifiers():
    from folioforge.llm import furniture as fu
    from folioforge.llm.boosting import Boosted

    rng = np.random.default_rng(2)
    titles = [" ".join(rng.choice(WORDS, 3)).capitalize() for _ in range(40)]
    texts = ["\n".join(" ".join(rng.choice(WORDS, 40)) + "." for _ in range(12)) for _ in range(60)]
    model = fu.train_furniture(titles, texts)
    held = [fu.laid_out(titles[rng.integers(40)], texts[rng.integers(60)], titles, rng) for _ in range(80)]
    found = model.of([lines for lines, _ in held])
    want = {(k, i) for k, (_, kinds) in enumerate(held) for i, kind in kinds.items() if kind == "header"}
    got = {(k, i) for k, (kinds, _) in enumerate(found) for i, kind in kinds.items() if kind == "header"}
    assert len(want & got) > 0.9 * len(want) and len(got - want) < 0.1 * len(want)
    never = Boosted(-9.0, np.zeros((1, 1), int), np.full((1, 1), np.inf), np.zeros((1, 2)))
    assert not any("header" in kinds.values() for kinds, _ in fu.Furniture(never, never).of([lines for lines, _ in held]))
