"""Citations parsed out of answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Default titles, and the two forms of an entry.
SIMPLE_TITLE, INLINE_TITLE = "参考来源", "未知来源"
TITLED = r"\[(\d+)\]\s*【?文档?：?([^】]+)】?\s*(.+)"
SIMPLE = r"\[(\d+)\]\s*(.+)"
_JS_SPACES = "\t\n\x0b\x0c\r    　﻿"


def _trim(c: Column) -> Column:
    return F.btrim(c, F.lit(_JS_SPACES))


def answer_text(raw: Column) -> Column:
    return _trim(F.get(F.split(raw, "---"), F.lit(0)))


def citation_list(raw: Column) -> Column:
    """array<struct<id, title, snippet>> of the part after the first rule; else the [n] in the answer, repeats kept.

    A number that is no 32-bit integer gives an entry with a null id."""
    listed = F.get(F.split(raw, "---"), F.lit(1))
    entries = F.filter(F.transform(F.split(listed, r"(?=\[\d+\])"), _trim), lambda x: x != "")

    def parse(x: Column) -> Column:
        titled = F.regexp_extract(x, TITLED, 1) != ""
        simple = F.regexp_extract(x, SIMPLE, 1) != ""
        full = F.struct(
            F.regexp_extract(x, TITLED, 1).try_cast("int").alias("id"),
            _trim(F.regexp_extract(x, TITLED, 2)).alias("title"),
            _trim(F.regexp_extract(x, TITLED, 3)).alias("snippet"),
        )
        bare = F.struct(
            F.regexp_extract(x, SIMPLE, 1).try_cast("int").alias("id"),
            F.lit(SIMPLE_TITLE).alias("title"),
            _trim(F.regexp_extract(x, SIMPLE, 2)).alias("snippet"),
        )
        return F.when(titled, full).when(simple, bare)

    parsed = F.coalesce(F.filter(F.transform(entries, parse), lambda x: x.isNotNull()), F.array().cast("array<struct<id:int,title:string,snippet:string>>"))
    inline = F.transform(
        F.regexp_extract_all(answer_text(raw), F.lit(r"\[(\d{1,9})\]"), F.lit(1)),
        lambda n: F.struct(n.cast("int").alias("id"), F.lit(INLINE_TITLE).alias("title"), F.lit("").alias("snippet")),
    )
    return F.when(F.size(parsed) > 0, parsed).otherwise(inline)


def citations(answers: DataFrame, key: str, raw: str) -> DataFrame:
    """(key, place, id, title, snippet), one row per citation; null answers give none."""
    rows = answers.filter(F.col(raw).isNotNull()).select(F.col(key), F.posexplode(citation_list(F.col(raw))).alias("place", "c"))
    return rows.select(key, "place", "c.id", "c.title", "c.snippet") if key != "id" else rows.select(
        F.col(key).alias("message_id"), "place", F.col("c.id").alias("id"), "c.title", "c.snippet"
    )
