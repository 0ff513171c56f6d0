"""Conversation history: order, truncation, expiry, clearing, token totals, compression."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioforge.functions.text import token_estimate
from folioforge.operators.slices import LONG, long_groups, running, with_slices

ROUNDS, TOKEN_LIMIT, KEEP, DAYS = 1000, 300_000, 200, 7
#: How speakers are named in a transcript, and what precedes a summary.
SPEAKERS = {"user": "用户: ", "assistant": "AI: "}
SUMMARY_PREFIX = "【对话摘要】以下是之前对话的概要：\n"


def session_key(kind: str, resource: Column, user: Column | None = None) -> Column:
    """doc:{id}:{user} or notebook:{id}:{user}; without the user in the single-user variant."""
    return F.concat_ws(":", F.lit(kind), resource.cast("string"), *([] if user is None else [user.cast("string")]))


def distinct_rows(messages: DataFrame) -> DataFrame:
    return messages.dropDuplicates(["id"])


def speaker(role: Column) -> Column:
    return F.when(role == "user", "user").otherwise("assistant")


def _newest(session: str) -> Window:
    return Window.partitionBy(session).orderBy(F.desc("create_time"), F.desc("id"))


def ordered(messages: DataFrame, session: str = "session_id", long: int = LONG, counted: DataFrame | None = None) -> DataFrame:
    """Adds ``position``, from 1, oldest first, ties by id. Very long sessions are numbered slice by slice."""
    order = [F.col("create_time"), F.col("id")]
    rows = running(messages, session, "create_time", order, long, counted, position=F.lit(1))
    return rows.withColumn("position", (F.col("position") + 1).cast("int"))


def tokens_before(
    messages: DataFrame, tokens: Column, session: str = "session_id", long: int = LONG, counted: DataFrame | None = None
) -> DataFrame:
    """Adds ``before``: the tokens of the session's earlier messages."""
    return running(messages, session, "create_time", [F.col("create_time"), F.col("id")], long, counted, before=tokens.cast("long"))


def append_turn(messages: DataFrame, turn: DataFrame) -> DataFrame:
    """The history with the two rows of each turn of ``turn``: same columns, with question and answer for content.

    Both rows share the time; the answer's id follows the question's. A turn whose answer is empty is not saved.
    """
    said = turn.filter(F.length("answer") > 0)
    shared = [c for c in messages.columns if c not in ("id", "role", "content")]
    row = lambda role, content, shift: said.select(
        *[(F.col("id") + shift).alias("id"), F.lit(role).alias("role"), F.col(content).alias("content"), *shared]
    )
    return messages.unionByName(row("user", "question", 0)).unionByName(row("assistant", "answer", 1))


def truncated(messages: DataFrame, rounds: int = ROUNDS, session: str = "session_id") -> DataFrame:
    """The newest 2 x rounds rows of each session; a partial limit per task comes before the shuffle."""
    return messages.withColumn("_r", F.row_number().over(_newest(session))).filter(F.col("_r") <= 2 * rounds).drop("_r")


def expired(messages: DataFrame, now: str, days: int = DAYS) -> DataFrame:
    """What is left after rows strictly older than ``now`` less ``days`` are removed; rows without time stay."""
    cutoff = F.to_timestamp_ntz(F.lit(now)) - F.expr(f"INTERVAL {int(days)} DAYS")
    return messages.filter(F.col("create_time").isNull() | (F.col("create_time") >= cutoff))


def cleared(messages: DataFrame, **where: int | str) -> DataFrame:
    """Without the rows that match all of ``where``; a null matches nothing."""
    if not where:
        raise ValueError("nothing to clear by")
    match = F.lit(True)
    for column, value in where.items():
        match = match & F.col(column).eqNullSafe(F.lit(value))
    return messages.filter(~match)


def session_tokens(messages: DataFrame, variant: str = "web", session: str = "session_id") -> DataFrame:
    return messages.groupBy(session).agg(
        F.count(F.lit(1)).alias("messages"), F.sum(token_estimate(F.col("content"), variant).cast("long")).alias("tokens")
    )


def to_compress(messages: DataFrame, limit: int = TOKEN_LIMIT, keep: int = KEEP, variant: str = "web", session: str = "session_id") -> DataFrame:
    """Sessions over both limits."""
    return session_tokens(messages, variant, session).filter((F.col("tokens") > limit) & (F.col("messages") > keep))


def transcript_line(role: Column, content: Column) -> Column:
    name = F.when(role == "user", SPEAKERS["user"]).otherwise(SPEAKERS["assistant"])
    return F.concat(name, F.coalesce(content, F.lit("")), F.lit("\n\n"))


def transcripts(
    messages: DataFrame, session: str = "session_id", rounds: int | None = None, long: int = LONG, counted: DataFrame | None = None
) -> DataFrame:
    """(session, transcript) of all rows, or of the newest 2 x rounds; very long sessions are put together slice by slice."""
    rows = messages if rounds is None else truncated(messages, rounds, session)
    spans = long_groups(rows if counted is None else counted, F.col(session), F.col("create_time"), long)
    lines = F.array_sort(F.collect_list(F.struct("create_time", "id", transcript_line(F.col("role"), F.col("content")).alias("line"))))
    joined = lambda parts, field: F.array_join(F.transform(parts, lambda x: x[field]), "")
    if not spans:
        return rows.groupBy(session).agg(joined(lines, "line").alias("transcript"))
    parts = with_slices(rows, spans, session, "create_time").groupBy(session, "slice").agg(joined(lines, "line").alias("part"))
    return parts.groupBy(session).agg(joined(F.array_sort(F.collect_list(F.struct("slice", "part"))), "part").alias("transcript"))


def compressed(
    messages: DataFrame,
    summarise,
    limit: int = TOKEN_LIMIT,
    keep: int = KEEP,
    variant: str = "web",
    session: str = "session_id",
    rounds: int | None = None,
    long: int = LONG,
    counted: DataFrame | None = None,
) -> DataFrame:
    """(session, position, role, content): histories as they go to a model.

    Sessions over the limits keep their newest ``keep`` rows after one assistant message with the summary of the rest;
    ``summarise`` maps a column of transcripts to a column of summaries. Other sessions stay as they are. ``rounds``
    first truncates every session to its newest 2 x rounds rows.
    """
    rows = messages if rounds is None else truncated(messages, rounds, session)
    large = to_compress(rows, limit, keep, variant, session).select(session, (F.col("messages") - keep).alias("_old"))
    placed = ordered(rows, session, long, counted).join(large, session, "left").withColumn("_old", F.coalesce("_old", F.lit(0)))
    old = F.col("position") <= F.col("_old")
    summary = transcripts(placed.filter(old), session, long=long, counted=counted).select(
        session,
        F.lit(1).alias("position"),
        F.lit("assistant").alias("role"),
        F.concat(F.lit(SUMMARY_PREFIX), summarise(F.col("transcript"))).alias("content"),
    )
    place = F.when(F.col("_old") > 0, F.col("position") - F.col("_old") + 1).otherwise(F.col("position")).cast("int")
    recent = placed.filter(~old).select(session, place.alias("position"), "role", "content")
    return recent.unionByName(summary)


def turn_usage(prompt_tokens: Column, history_tokens: Column, answer_tokens: Column) -> Column:
    """struct(prompt, completion, total)."""
    prompt = prompt_tokens + history_tokens
    return F.struct(prompt.cast("int").alias("prompt"), answer_tokens.cast("int").alias("completion"), (prompt + answer_tokens).cast("int").alias("total"))
