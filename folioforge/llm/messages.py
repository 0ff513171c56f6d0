"""What the chat operators share: roles, blank content, and sessions cut into slices of bounded size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioforge.operators.slices import LONG, long_groups, with_slices

#: Spellings of the three roles, compared in lower case without outer blanks.
ROLES = {
    "user": ["user", "human", "用户", "customer", "usuario", "utilisateur", "benutzer", "nutzer", "提问者", "ユーザー"],
    "assistant": ["assistant", "ai", "bot", "助手", "机器人", "model", "chatbot", "asistente", "assistent", "アシスタント"],
    "system": ["system", "系统", "sys", "sistema", "système", "システム"],
}

#: Contents that only hold the place of an absent value, without punctuation and in lower case.
PLACEHOLDERS = [
    "null", "none", "nil", "nan", "na", "n/a", "undefined", "void", "empty", "tbd", "暂无", "无", "空", "未填写", "暂缺",
    "leer", "keine", "vide", "néant", "vacío", "ninguno", "なし", "ไม่มี", "कोई नहीं",
]

#: What counts as an outer blank.
BLANKS = " \t\r\n\x0b\x0c\u00a0\u3000\u200b\ufeff"
#: More letters and digits than any placeholder has; contents that have so many need no closer look.
MORE_THAN_PLACEHOLDERS = max(map(len, PLACEHOLDERS)) + 1


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANKS))


def role_of(role: Column) -> Column:
    """user, assistant, system, or unreadable for null and anything else."""
    spelt = F.lower(strip(role))
    known = F.lit("unreadable")
    for name, spellings in ROLES.items():
        known = F.when(spelt.isin(spellings), name).otherwise(known)
    return known


def says_something(content: Column) -> Column:
    """False if content is null, holds no letter or digit of any script, or only stands for an absent value."""
    bare = F.lower(F.regexp_replace(content, r"[^\p{L}\p{M}\p{N}/ ]+", ""))
    much = content.rlike(rf"(?:[\p{{L}}\p{{N}}][^\p{{L}}\p{{N}}]*+){{{MORE_THAN_PLACEHOLDERS}}}")
    real = much | ~strip(bare).isin(PLACEHOLDERS)
    return F.coalesce(content.rlike(r"[\p{L}\p{N}]") & real, F.lit(False))


def in_sessions(chat: DataFrame) -> DataFrame:
    """(session, id, role, content, at) of the rows that belong to a session, roles read."""
    return chat.filter(F.col("session_id").isNotNull()).select(
        F.lower(strip(F.col("session_id"))).alias("session"),
        F.col("id").cast("long").alias("id"),
        role_of(F.col("role")).alias("role"),
        F.col("content").cast("string").alias("content"),
        F.col("create_time").cast("timestamp_ntz").alias("at"),
    )


#: A session with more rows than this (and than a thousandth of all rows) is cut into slices by time.
LONG_SESSION = LONG


def sliced(rows: DataFrame, chat: DataFrame, long_session: int = LONG_SESSION) -> DataFrame:
    """Adds ``slice`` and ``context``: order within a session may then be worked out per (session, slice).

    Sessions of usual length form one slice. The last row of each slice of a long one is repeated with context = true at
    the head of the next, so that every row still finds its predecessor.
    """
    spans = long_groups(chat, F.lower(strip(F.col("session_id"))), F.col("create_time"), long_session)
    cut = with_slices(rows, spans, "session", "at").withColumn("context", F.lit(False))
    if not spans:
        return cut
    body = [c for c in rows.columns if c not in ("session", "at", "id")]
    tails = (
        cut.filter(F.col("session").isin([s.group for s in spans]))
        .groupBy("session", "slice")
        .agg(F.max(F.struct("at", "id", *body)).alias("row"))
        .withColumn("next", F.lead("slice").over(Window.partitionBy("session").orderBy("slice")))
        .filter(F.col("next").isNotNull())
        .select("session", F.col("next").alias("slice"), F.lit(True).alias("context"), *[F.col(f"row.{c}").alias(c) for c in ("at", "id", *body)])
    )
    return cut.unionByName(tails)
