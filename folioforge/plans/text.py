"""Cleaning, splitting and small string functions over documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.functions import text as fn
from folioforge.operators import chunking, cleaning, models
from folioforge.plans import sql_text
from folioforge.session import table
from folioforge.sources import files

SIZE, OVERLAP = 128, 16


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def clean_control(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("content")
    return _docs(spark, sf_dir).filter(c.isNotNull()).select("doc_id", F.md5(cleaning.strip_control(c)).alias("cleaned"))


def clean_watermark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every other line spaced out, so that there are lines to drop."""
    spaced = F.regexp_replace("text", "(?m)^(.{1,20})$", "S e c r e t   c o p y\n$1")
    kept = F.array_join(cleaning.drop_watermarks(F.split(spaced, "\n")), "\n")
    return _docs(spark, sf_dir).filter(F.col("text").isNotNull()).select("doc_id", F.md5(kept).alias("kept"))


def clean_repeated(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = F.array_join(cleaning.drop_repeated(F.split("content", "\n")), "\n")
    return _docs(spark, sf_dir).filter(F.col("content").isNotNull()).select("doc_id", F.md5(kept).alias("kept"))


def clean_full_web(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.md5(cleaning.clean_text(F.col("content"), "web")).alias("cleaned"))


def clean_full_desktop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.md5(cleaning.clean_text(F.col("content"), "desktop")).alias("cleaned"))


def paragraph_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _docs(spark, sf_dir).filter(F.col("text").isNotNull())
    return rows.select("doc_id", F.posexplode(chunking.paragraphs(F.col("text"))).alias("pos", "paragraph"))


def sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _docs(spark, sf_dir).filter(F.col("text").isNotNull())
    return rows.select("doc_id", F.posexplode(chunking.sentences(F.col("text"))).alias("pos", "sentence"))


def chunk_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = chunking.sliding_chunks(_docs(spark, sf_dir), "doc_id", "text", SIZE, OVERLAP)
    return chunks.select("doc", "ordinal", "id", "text")


def chunk_semantic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.semantic_chunks(_docs(spark, sf_dir), "doc_id", "text", SIZE, OVERLAP)


def chunk_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    chunks = chunking.sliding_chunks(docs, "doc_id", "text", SIZE, OVERLAP)
    return chunking.chunk_counts(chunks, docs.select("doc_id", "chunk_count"), "doc_id")


def extract_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uploaded files of several kinds read and cleaned; unknown kinds and missing names come out as errors."""
    rows = _docs(spark, sf_dir).filter(F.col("content").isNotNull())
    kind = F.get(F.array(*[F.lit(x) for x in ("txt", "MD", "xyz")]), (F.col("doc_id") % 4).cast("int"))
    name = F.when(kind.isNotNull(), F.concat(F.lit("file "), F.col("doc_id").cast("string"), F.lit("."), kind))
    read = files.extracted(rows.select(name.alias("name"), F.encode("content", "UTF-8").alias("content")))
    return read.select("name", F.md5("text").alias("text"), "error")


def page_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as a remote parser gives them, joined: markdown first, else text, else nothing."""
    page = lambda md, text: F.struct(md.alias("md"), text.alias("text"))
    pages = F.array(page(F.col("summary"), F.col("title")), page(F.col("source"), F.col("lang")))
    return _docs(spark, sf_dir).select("doc_id", files.joined_pages(pages).alias("joined"))


def doc_summary_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).groupBy(models.summary_status(F.col("summary")).alias("status")).agg(F.count(F.lit(1)).alias("documents"))


def summary_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What goes to a model for a summary: gate and cut."""
    made = models.summary_input(F.repeat("text", 3))
    return _docs(spark, sf_dir).select("doc_id", F.length(made).alias("length"), F.md5(made).alias("input"))


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size, cost, preview, date and length labels of every document."""
    n = F.col("n_chars")
    return _docs(spark, sf_dir).select(
        "doc_id",
        fn.size_label(n * 997).alias("size_label"),
        fn.usage_cost(n).alias("cost"),
        fn.preview(F.col("text")).alias("preview"),
        fn.date_label(F.col("create_time")).alias("date_label"),
        fn.token_estimate(F.col("text"), "web").alias("tokens_web"),
        fn.token_estimate(F.col("text"), "desktop").alias("tokens_desktop"),
        fn.utf16_length(F.col("title")).alias("title_units"),
        fn.html_escape(F.concat(F.lit("<b>'\""), F.coalesce("title", F.lit("")), F.lit("&</b>"))).alias("escaped"),
        fn.extension(F.concat_ws(".", "title", F.lit("DOCX"))).alias("extension"),
    )


def merged_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.md5(fn.merged_content(F.coalesce("summary", F.lit("")), F.coalesce("text", F.lit("")))).alias("merged"))


_WEB, _TRIM_WEB = sql_text(fn.STRIP_WEB), sql_text(fn.TRIM_WEB)
_DESK = sql_text(fn.STRIP_DESKTOP)
_CONTROL = r"'[\x00-\x08\x0B\x0C\x0E-\x1F]'"
_TOKENS = r"'[\x{4e00}-\x{9fff}]|[A-Za-z0-9_\x{c0}-\x{24f}]+|[ \t\n\r\f]+|[^ \t\n\r\f]'"


def _watermarks(lines: str, chars: str) -> str:
    t = f"trim(l, {chars})"
    return f"list_filter({lines}, lambda l: NOT (length({t}) >= 12 AND (length({t}) - length(replace({t}, ' ', ''))) / greatest(length({t}), 1) > 0.4))"


def _repeats(table_sql: str, chars: str) -> str:
    """Lines by position with the repeated ones gone: table_sql gives (doc_id, lines)."""
    return f"""
      SELECT doc_id, list(line ORDER BY pos) AS lines FROM (
        SELECT *, count(*) OVER (PARTITION BY doc_id, trim(line, {chars})) AS n FROM (
          SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM ({table_sql})))
      WHERE trim(line, {chars}) = '' OR n < 3 GROUP BY doc_id"""


def _clean_sql(variant: str, shown: str = "md5(coalesce(c.cleaned, ''))") -> str:
    chars = _WEB if variant == "web" else _DESK
    outer = _TRIM_WEB if variant == "web" else _DESK
    text = f"regexp_replace(coalesce(content, ''), {_CONTROL}, '', 'g')"
    if variant == "web":
        text = f"regexp_replace({text}, '\\n{{3,}}', chr(10) || chr(10), 'g')"
    joined = f"array_to_string(list_transform(lines, lambda l: trim(l, {chars})), chr(10))"
    if variant == "desktop":
        joined = f"regexp_replace({joined}, '\\n{{3,}}', chr(10) || chr(10), 'g')"
    lines = f"SELECT doc_id, {_watermarks(f'string_split({text}, chr(10))', chars)} AS lines FROM documents"
    return f"""SELECT d.doc_id, {shown} AS cleaned FROM documents d LEFT JOIN (
      SELECT doc_id, trim({joined}, {outer}) AS cleaned FROM ({_repeats(lines, chars)})) c ON d.doc_id = c.doc_id"""


_CHUNKS = f"""
  SELECT doc_id AS doc, CAST(i AS INTEGER) AS ordinal, 'doc:' || doc_id || ':chunk:' || i AS id,
    array_to_string(toks[i * {SIZE - OVERLAP} + 1 : i * {SIZE - OVERLAP} + {SIZE}], '') AS text
  FROM (SELECT doc_id, toks, unnest(range(0, greatest(1, CAST(ceil((len(toks) - {OVERLAP}) / {SIZE - OVERLAP}.0) AS BIGINT)))) AS i
    FROM (SELECT doc_id, regexp_extract_all(text, {_TOKENS}) AS toks FROM documents WHERE length(trim(text)) > 0))"""
def semantic_sql(texts: str, size: int, overlap: int) -> str:
    """(doc_id, ordinal, text) of the semantic splitter over a query (doc_id, text): a recursion over pieces, in counts only."""
    return f"""
      WITH RECURSIVE para AS (
        SELECT doc_id, unnest(ps) AS p, generate_subscripts(ps, 1) AS idx FROM (
          SELECT doc_id, regexp_split_to_array(text, '\\n\\n+') AS ps FROM ({texts}) WHERE length(trim(text)) > 0)),
      tok AS (SELECT doc_id, idx, p, regexp_extract_all(p, {_TOKENS}) AS t FROM para),
      sent AS (
        SELECT doc_id, idx, unnest(ss) AS s, generate_subscripts(ss, 1) AS sub FROM (
          SELECT doc_id, idx, list_filter(string_split(regexp_replace(p, '([。？！；\\n])', '\\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') AS ss FROM tok WHERE len(t) > {size})),
      part AS (
        SELECT doc_id, idx, 0 AS sub, t, 1 AS gap, FALSE AS fresh FROM tok WHERE len(t) <= {size}
        UNION ALL SELECT doc_id, idx, sub, regexp_extract_all(s, {_TOKENS}), 0, sub = 1 FROM sent),
      piece AS (SELECT doc_id, t, CAST(len(t) AS BIGINT) AS n, gap, fresh, row_number() OVER (PARTITION BY doc_id ORDER BY idx, sub) AS i FROM part),
      fold AS (
        SELECT doc_id, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS a, CAST(0 AS BIGINT) AS e, CAST(0 AS BIGINT) AS c, FALSE AS over_, FALSE AS closes, CAST(0 AS BIGINT) AS ca, CAST(0 AS BIGINT) AS ce
        FROM piece WHERE i = 1
        UNION ALL
        SELECT doc_id, i, na, e + n + CASE WHEN over_ THEN 0 ELSE gap END,
          CASE WHEN over_ THEN e + n - na ELSE fc + n + 2 * gap END, over_, (fresh OR over_) AND a < e, a, e FROM (
            SELECT *, CASE WHEN over_ THEN greatest(fa, e - {overlap}) ELSE fa END AS na FROM (
              SELECT p.doc_id, p.i, p.n, p.gap, p.fresh, f.a, f.e, CASE WHEN p.fresh THEN 0 ELSE f.c END AS fc, CASE WHEN p.fresh THEN f.e ELSE f.a END AS fa,
                CASE WHEN p.fresh THEN 0 ELSE f.c END + p.n > {size} AS over_
              FROM fold f JOIN piece p ON p.doc_id = f.doc_id AND p.i = f.i + 1))),
      stream AS (
        SELECT f.doc_id, flatten(list(CASE WHEN over_ OR gap = 0 THEN t ELSE list_append(t, chr(10) || chr(10)) END ORDER BY f.i)) AS s
        FROM fold f JOIN piece p ON p.doc_id = f.doc_id AND p.i = f.i GROUP BY f.doc_id),
      cuts AS (
        SELECT doc_id, i, ca AS a, ce AS e FROM fold WHERE closes
        UNION ALL SELECT doc_id, i + 1, a, e FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i DESC) AS r FROM fold) WHERE r = 1 AND a < e),
      chunk AS (SELECT c.doc_id, c.i, array_to_string(s[c.a + 1 : c.e], '') AS text FROM cuts c JOIN stream s ON s.doc_id = c.doc_id)
      SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INTEGER) AS ordinal, text FROM chunk WHERE NOT regexp_full_match(text, '[\\s\\x{{3000}}\\x{{a0}}]*')"""


INGESTED = semantic_sql(_clean_sql("desktop", "c.cleaned").replace("AS cleaned FROM documents d", "AS text FROM documents d") + " WHERE d.content IS NOT NULL", 512, 50)
_SUMMARY_INPUT = f"CASE WHEN length(trim(t, {_TRIM_WEB})) >= 50 THEN CASE WHEN length(t) > 8000 THEN left(t, 8000) || chr(10) || '...（内容已截断）' ELSE t END END"

QUERIES = {
    f.__name__: f
    for f in (
        clean_control, clean_watermark, clean_repeated, clean_full_web, clean_full_desktop, paragraph_split, sentence_split,
        extract_files, page_join, chunk_sliding, chunk_semantic, chunk_count, doc_summary_status, summary_inputs, labels, merged_text,
    )
}
SQL = {
    "clean_control": f"SELECT doc_id, md5(regexp_replace(content, {_CONTROL}, '', 'g')) AS cleaned FROM documents WHERE content IS NOT NULL",
    "clean_watermark": f"""SELECT doc_id, md5(array_to_string({_watermarks("string_split(regexp_replace(text, '(?m)^(.{1,20})$', 'S e c r e t   c o p y' || chr(10) || '\\1', 'g'), chr(10))", _WEB)}, chr(10))) AS kept
        FROM documents WHERE text IS NOT NULL""",
    "clean_repeated": f"""SELECT d.doc_id, md5(coalesce(k.kept, '')) AS kept FROM documents d LEFT JOIN (SELECT doc_id, array_to_string(lines, chr(10)) AS kept FROM (
        {_repeats("SELECT doc_id, string_split(content, chr(10)) AS lines FROM documents WHERE content IS NOT NULL", _WEB)})) k ON d.doc_id = k.doc_id WHERE d.content IS NOT NULL""",
    "clean_full_web": _clean_sql("web"),
    "clean_full_desktop": _clean_sql("desktop"),
    "paragraph_split": """SELECT doc_id, CAST(generate_subscripts(p, 1) - 1 AS INTEGER) AS pos, unnest(p) AS paragraph
        FROM (SELECT doc_id, regexp_split_to_array(text, '\\n\\n+') AS p FROM documents WHERE text IS NOT NULL)""",
    "sentence_split": r"""SELECT doc_id, CAST(generate_subscripts(p, 1) - 1 AS INTEGER) AS pos, unnest(p) AS sentence FROM (
        SELECT doc_id, list_filter(string_split(regexp_replace(text, '([。？！；\n])', '\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') AS p
        FROM documents WHERE text IS NOT NULL)""",
    "chunk_sliding": _CHUNKS,
    "extract_files": f"""SELECT CASE doc_id % 4 WHEN 0 THEN 'file ' || doc_id || '.txt' WHEN 1 THEN 'file ' || doc_id || '.MD' WHEN 2 THEN 'file ' || doc_id || '.xyz' END AS name,
        CASE WHEN doc_id % 4 < 2 THEN cleaned END AS text,
        CASE doc_id % 4 WHEN 2 THEN '{files.UNSUPPORTED}' || 'file ' || doc_id || '.xyz' WHEN 3 THEN '{files.NO_NAME}' END AS error
        FROM (SELECT * FROM ({_clean_sql("web")}) WHERE doc_id IN (SELECT doc_id FROM documents WHERE content IS NOT NULL))""",
    "page_join": "SELECT doc_id, coalesce(summary, title, '') || chr(10) || chr(10) || coalesce(source, lang, '') AS joined FROM documents",
    "chunk_semantic": f"""SELECT doc_id AS doc, ordinal, 'doc:' || doc_id || ':chunk:' || ordinal AS id, text
        FROM ({semantic_sql("SELECT doc_id, text FROM documents", SIZE, OVERLAP)})""",
    "chunk_count": f"""SELECT d.doc_id, coalesce(CAST(c.n AS INTEGER), d.chunk_count) AS chunk_count FROM documents d
        LEFT JOIN (SELECT doc, count(*) AS n FROM ({_CHUNKS}) GROUP BY doc) c ON d.doc_id = c.doc""",
    "doc_summary_status": f"""SELECT CASE WHEN summary = '{models.GENERATING}' THEN 'generating' WHEN summary = '{models.FAILED}' THEN 'failed'
        WHEN summary = '{models.TOO_SHORT}' THEN 'too_short' WHEN summary IS NULL OR trim(summary, {_TRIM_WEB}) = '' OR summary = '{models.NO_CONTENT}' THEN 'none'
        ELSE 'ready' END AS status, count(*) AS documents FROM documents GROUP BY 1""",
    "summary_inputs": f"SELECT doc_id, CAST(length(i) AS INTEGER) AS length, md5(i) AS input FROM (SELECT doc_id, {_SUMMARY_INPUT} AS i FROM (SELECT doc_id, repeat(text, 3) AS t FROM documents))",
    "labels": """SELECT doc_id,
        CASE WHEN n_chars * 997 < 1024 THEN (n_chars * 997) || ' B' WHEN n_chars * 997 < 1048576 THEN printf('%.1f KB', floor(n_chars * 997 / 1024.0::DOUBLE * 10 + 0.5) / 10)
          ELSE printf('%.1f MB', floor(n_chars * 997 / 1048576.0::DOUBLE * 10 + 0.5) / 10) END AS size_label,
        printf('%.4f', ((n_chars * 15 + 500) // 1000) / 10000.0::DOUBLE) AS cost,
        replace(left(text, 50), chr(10), ' ') AS preview,
        coalesce(strftime(create_time, '%Y/%m/%d %H:%M'), '未知时间') AS date_label,
        coalesce(CAST(floor(length(text) * 1.3::DOUBLE) AS INTEGER), 0) AS tokens_web,
        coalesce(CAST(ceil(length(text) * 1.3::DOUBLE) AS INTEGER), 0) AS tokens_desktop,
        CAST(length(title) AS INTEGER) AS title_units,
        replace(replace(replace(replace(replace('<b>''"' || coalesce(title, '') || '&</b>', '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;') AS escaped,
        'docx' AS extension
        FROM documents""",
    "merged_text": f"""SELECT doc_id, md5(CASE WHEN trim(coalesce(summary, ''), {_TRIM_WEB}) <> '' THEN trim(summary, {_TRIM_WEB}) || chr(10) || chr(10) || '---' || chr(10) || chr(10) || coalesce(text, '')
        ELSE coalesce(text, '') END) AS merged FROM documents""",
}
