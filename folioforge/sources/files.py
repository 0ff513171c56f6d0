"""Uploaded files as text: text and Markdown, DOCX by its XML, PDF through a registered reader, one row per file."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.functions.text import extension, is_blank
from folioforge.operators.cleaning import clean_text

#: What stands for text that could not be read.
DOCX_FAILED = {"web": "[文档解析失败: {error}]\n文件名: {name}", "desktop": "[Word文档解析失败: {error}]\n文件名: {name}"}
PDF_FAILED = "[PDF解析失败: {error}]\n文件名: {name}"
PDF_EMPTY = "[PDF文本提取为空，该文件可能是扫描版/图片型PDF，暂无法提取文本内容]\n文件名: {name}"
UNSUPPORTED, NO_NAME = "不支持的文件格式: ", "文件名不能为空"
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"

PdfReader = Callable[[bytes], str]
_pdf_readers: dict[str, PdfReader] = {}


def register_pdf_reader(name: str, read: PdfReader) -> None:
    """PDF needs a library that may be absent; without a reader PDFs give the text for failure."""
    _pdf_readers[name] = read


def docx_text(data: bytes) -> str:
    """The text of each paragraph of the body and a line end; tables are not visited."""
    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        body = ElementTree.fromstring(archive.read("word/document.xml")).find(f"{_W}body")
    lines = []
    for paragraph in body.findall(f"{_W}p") if body is not None else []:
        parts = []
        for node in paragraph.iter():
            if node.tag == f"{_W}t":
                parts.append(node.text or "")
            elif node.tag == f"{_W}tab":
                parts.append("\t")
            elif node.tag in (f"{_W}br", f"{_W}cr"):
                parts.append("\n")
        lines.append("".join(parts) + "\n")
    return "".join(lines)


def _read(name: str, data: bytes, variant: str, pdf: PdfReader | None) -> str:
    if name.lower().endswith(".docx"):
        try:
            return docx_text(data)
        except Exception as error:
            return DOCX_FAILED[variant].format(error=error, name=name)
    try:
        if pdf is None:
            raise RuntimeError("no PDF reader is registered")
        text = pdf(data)
    except Exception as error:
        return PDF_FAILED.format(error=error, name=name)
    return text if text and text.strip() else PDF_EMPTY.format(name=name)


def joined_pages(pages: Column) -> Column:
    """One text of pages with md and text, as a remote parser returns them."""
    return F.array_join(F.transform(pages, lambda p: F.coalesce(p["md"], p["text"], F.lit(""))), "\n\n")


def extracted(files: DataFrame, variant: str = "web", pdf_reader: str | None = None) -> DataFrame:
    """(name, text, error) of rows (name, content binary); error is set instead of text for bad names and formats.

    Plain text is decoded in the JVM; only DOCX and PDF rows go to Python.
    """
    name, data = F.col("name"), F.col("content")
    kind = extension(name)
    pdf = _pdf_readers.get(pdf_reader) if pdf_reader else None

    @F.pandas_udf("string")
    def parse(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for names, contents in parts:
            yield pd.Series([_read(n, c, variant, pdf) if n is not None and c is not None else None for n, c in zip(names, contents)], dtype=object)

    plain = files.filter(kind.isin("txt", "md")).select("name", F.decode(data, "UTF-8").alias("text"), F.lit(None).cast("string").alias("error"))
    parsed = files.filter(kind.isin("docx", "pdf")).select("name", parse(name, data).alias("text"), F.lit(None).cast("string").alias("error"))
    bad = files.filter(name.isNull() | ~kind.isin("txt", "md", "docx", "pdf")).select(
        "name", F.lit(None).cast("string").alias("text"), F.when(is_blank(name), NO_NAME).otherwise(F.concat(F.lit(UNSUPPORTED), name)).alias("error")
    )
    return plain.unionByName(parsed).unionByName(bad).withColumn("text", F.when(F.col("error").isNull(), clean_text(F.col("text"), variant)))


def read_files(spark: SparkSession, path: str, variant: str = "web", pdf_reader: str | None = None) -> DataFrame:
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return extracted(raw.select(F.regexp_extract("path", r"([^/]*)$", 1).alias("name"), "content"), variant, pdf_reader)


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of whole text files."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def safe_name(name: str) -> str:
    return re.sub(r"[^\w.\-]+", "_", name)
