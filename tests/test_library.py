import datetime as dt
import io
import json
import zipfile

from pyspark.sql import functions as F

from folioforge.operators import catalog, models
from folioforge.sources import files, store
from folioforge.streaming.ingest import ingest

DOCX = '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:r><w:t>第一段</w:t></w:r></w:p><w:p><w:r><w:t>第二</w:t></w:r><w:r><w:t>段</w:t></w:r></w:p></w:body></w:document>'


def docx() -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", DOCX)
    return out.getvalue()


def test_files(spark):
    df = spark.createDataFrame(
        [("README.MD", "# 项目说明".encode()), ("a.docx", docx()), ("bad.docx", b"no"), ("x.pdf", b"%PDF"), ("program.exe", b""), (None, b""), ("  ", b""), ("n.txt", None)],
        "name string, content binary",
    )
    got = {r["name"]: (r["text"], r["error"]) for r in files.extracted(df).collect()}
    assert got["README.MD"] == ("# 项目说明", None)
    assert got["a.docx"] == ("第一段\n第二段", None)
    assert got["bad.docx"][0].startswith("[文档解析失败: ")
    assert got["x.pdf"][0].startswith("[PDF解析失败: ")
    assert got["program.exe"] == (None, "不支持的文件格式: program.exe")
    assert got[None] == (None, "文件名不能为空") and got["  "] == (None, "文件名不能为空")
    files.register_pdf_reader("blank", lambda data: " ")
    assert files.extracted(df.filter("name = 'x.pdf'"), pdf_reader="blank").first()["text"].startswith("[PDF文本提取为空")


def test_read_files_and_pages(spark, tmp_path):
    (tmp_path / "a.txt").write_text("eins\n\n\n\nzwei", "utf-8")
    assert files.read_files(spark, str(tmp_path)).first()["text"] == "eins\n\nzwei"
    df = spark.createDataFrame([([("m", "t"), (None, "t2"), (None, None)],)], "p array<struct<md:string,text:string>>")
    assert df.select(files.joined_pages(F.col("p"))).first()[0] == "m\n\nt2\n\n"


def test_collection(spark, tmp_path):
    path = tmp_path / "v.json"
    assert store.read_collection(spark, str(path)).count() == 0
    path.write_text(json.dumps([{"id": "a", "text": "t", "metadata": {"documentId": 1, "documentTitle": "x"}, "embedding": [1, 0]}, {"id": "b", "text": "u", "metadata": None, "embedding": [0.5]}]))
    rows = store.read_collection(spark, str(path)).orderBy("ord").collect()
    assert [r["id"] for r in rows] == ["a", "b"] and rows[0]["metadata"]["documentId"] == 1 and rows[1]["metadata"] is None
    again = json.loads(store.to_json_array(store.read_collection(spark, str(path))))
    assert again[0]["embedding"] == [1.0, 0.0]
    for broken in ("", "  ", "{nonsense"):
        path.write_text(broken)
        assert store.read_collection(spark, str(path)).count() == 0


def tables(spark):
    t = dt.datetime(2026, 1, 1)
    return {
        "notebooks": spark.createDataFrame([(1, "n"), (2, "m")], "id long, name string"),
        "documents": spark.createDataFrame([(10, 1), (11, 2), (12, None)], "id long, notebook_id long"),
        "vectors": spark.createDataFrame([("a", (10, "t")), ("b", (11, "t")), ("c", (None, None))], "id string, metadata struct<documentid:bigint,documenttitle:string>"),
        "messages": spark.createDataFrame([(1, 10, None, 1, t), (2, 10, None, 2, t), (3, None, 1, 1, t), (4, 11, None, 1, t)], "id long, document_id long, notebook_id long, user_id long, create_time timestamp"),
    }


def left(tables):
    return {k: sorted(r["id"] for r in v.collect()) for k, v in tables.items()}


def test_cascades(spark):
    full = left(catalog.delete_notebook(tables(spark), 1))
    assert full == {"notebooks": [2], "documents": [11, 12], "vectors": ["b", "c"], "messages": [4]}
    assert left(catalog.delete_notebook(tables(spark), 1, "web"))["messages"] == [1, 2, 4]
    one = spark.createDataFrame([(10,)], "id long")
    assert left(catalog.delete_document(tables(spark), one, user=1))["messages"] == [2, 3, 4]


def test_scope(spark):
    t = tables(spark)
    assert catalog.exists(t["documents"], F.col("id") == 10) and not catalog.exists(t["documents"], F.col("id") == 99)
    owners = spark.createDataFrame([(1, 5), (2, 6)], "id long, user_id long")
    assert left({"d": catalog.children_of_owned(t["documents"], "notebook_id", owners, "id", "user_id", 5)}) == {"d": [10]}
    assert catalog.owned_row(owners, "id", 1, "user_id", 6).count() == 0
    changed = catalog.update_columns(t["notebooks"], "id", spark.createDataFrame([(2, None)], "id long, name string"), ["name"])
    assert {r["id"]: r["name"] for r in changed.collect()} == {1: "n", 2: None}
    rules = {"name": [("must not be blank", F.length(F.trim("name")) > 0), ("too long", F.length("name") <= 100)]}
    bad = catalog.validation_errors(spark.createDataFrame([(None,), ("",), ("ok",)], "name string"), rules).collect()
    assert [r["errors"] for r in bad] == ["name: must not be blank; name: too long", "name: must not be blank", ""]
    added = catalog.append_rows(owners, spark.createDataFrame([(9,)], "id long"), user_id=4)
    assert sorted(map(tuple, added.collect())) == [(1, 5), (2, 6), (9, 4)]


def test_models(spark):
    df = spark.createDataFrame([(1, "hello world"), (2, None), (3, "hello world")], "id int, t string")
    rows = df.select("id", models.embed(F.col("t")).alias("v")).orderBy("id").collect()
    assert rows[1]["v"] is None and rows[0]["v"] == rows[2]["v"] and abs(sum(x * x for x in rows[0]["v"]) - 1) < 1e-9

    calls = []

    def flaky(x):
        calls.append(x)
        if len(calls) < 3:
            raise ConnectionError
        return x

    assert models.retried(flaky, 1, delay=0) == 1 and len(calls) == 3

    def broken(texts):
        raise ValueError("no")

    models.register_llm("broken", broken)
    docs = spark.createDataFrame([(1, "x" * 60), (2, "short"), (3, ""), (4, None)], "id int, content string")
    assert {r["id"]: r["summary"] for r in models.summarised(docs, "content", "broken").collect()} == {1: models.FAILED, 2: models.TOO_SHORT, 3: models.NO_CONTENT, 4: models.NO_CONTENT}
    status = docs.select(models.summary_status(F.lit(models.GENERATING)), models.summary_status(F.lit("fine")), models.summary_status(F.lit(None).cast("string"))).first()
    assert list(status) == ["generating", "ready", "none"]


def test_streaming_ingest(spark, tmp_path):
    source, out = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    (source / "1.json").write_text(json.dumps({"id": 1, "title": "t", "content": "第一段\n\n第二段"}) + "\n" + json.dumps({"id": 2, "title": "u", "content": None}) + "\n")
    ingest(spark, str(source), str(out), str(tmp_path / "check")).awaitTermination(120)
    (source / "2.json").write_text(json.dumps({"id": 3, "title": "t", "content": "dritte"}) + "\n")
    ingest(spark, str(source), str(out), str(tmp_path / "check")).awaitTermination(120)
    rows = spark.read.parquet(str(out)).collect()
    assert sorted(r["id"] for r in rows) == ["doc:1:chunk:0", "doc:3:chunk:0"] and len(rows[0]["embedding"]) == 64


def test_tables_and_statements(spark, tmp_path):
    names = ["users", "notebooks", "documents", "chat_messages", "vector_store"]
    try:
        store.create_tables(spark, str(tmp_path), buckets=4)
        store.create_tables(spark, str(tmp_path), buckets=4)
        spark.sql("INSERT INTO users VALUES (1, 'a', NULL), (2, 'b', 'x')")
        assert store.first(spark, "SELECT username FROM users WHERE id = ?", [2]) == {"username": "b"}
        assert store.first(spark, "SELECT username FROM users WHERE id = ?", [9]) is None
        assert store.run(spark, "SELECT count(*) AS n FROM chat_messages").first()["n"] == 0
        store.append(spark.table("users").filter("id = 1"), str(tmp_path / "copy"))
        assert store.read_table(spark, str(tmp_path / "copy"), "users").count() == 1
    finally:
        for name in names:
            spark.sql(f"DROP TABLE IF EXISTS {name}")


def test_write_collection(spark, tmp_path):
    rows = spark.createDataFrame([("a", "t", (1, "x"), [1.0], 0), ("b", "u", None, None, 1)], "id string, text string, metadata struct<documentid:bigint,documenttitle:string>, embedding array<double>, ord long")
    store.write_collection(rows, str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).count() == 2
    store.export_collection(rows, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2


def test_documents_that_come_again(spark, tmp_path):
    from folioforge.streaming.ingest import current_chunks

    source, out = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    row = {"id": 1, "title": "t", "create_time": "2026-01-02T03:04:05"}
    (source / "1.json").write_text(json.dumps({**row, "content": "word word。" * 900}) + "\n" + json.dumps({"id": 2, "title": "u", "content": "stays"}) + "\n")
    ingest(spark, str(source), str(out), str(tmp_path / "check")).awaitTermination(120)
    (source / "2.json").write_text(json.dumps({**row, "title": "new", "content": "short now"}) + "\n")
    ingest(spark, str(source), str(out), str(tmp_path / "check")).awaitTermination(120)
    every, arrived = spark.read.parquet(str(out)), spark.read.parquet(f"{out}_arrived")
    assert every.count() > 3
    got = {r["id"]: r for r in current_chunks(every, arrived).collect()}
    assert set(got) == {"doc:1:chunk:0", "doc:2:chunk:0"} and got["doc:1:chunk:0"]["text"].strip() == "short now"
    assert got["doc:1:chunk:0"]["metadata"]["documenttitle"] == "new" and str(got["doc:1:chunk:0"]["create_time"]) == "2026-01-02 03:04:05"
    assert got["doc:2:chunk:0"]["create_time"] is None


def test_retry_may_be_constant(monkeypatch):
    waits, tries = [], []
    monkeypatch.setattr(models.time, "sleep", waits.append)

    def flaky(x):
        tries.append(x)
        if len(tries) < 3:
            raise ConnectionError
        return x

    assert models.retried(flaky, 7, factor=1.0) == 7 and waits == [1.5, 1.5]


def test_columns_left_out(spark):
    df = spark.createDataFrame([(1, "a", "secret")], "id long, username string, password string")
    assert catalog.without(df, "password", "email").columns == ["id", "username"]
