"""Conversation history, citations and answer streams over chat_messages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.functions.text import token_estimate
from folioforge.operators import citations as cite
from folioforge.operators import history
from folioforge.operators.context import CONTEXT_LABEL, QUESTION_LABEL, message_list, user_prompt
from folioforge.plans import sql_text
from folioforge.session import table
from folioforge.streaming import answers as stream

NOW = "2026-06-01 00:00:00"
ROUNDS, KEEP, LIMIT = 3, 8, 500


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a session, exact repeats once."""
    rows = table(spark, sf_dir, "chat_messages").filter(F.col("session_id").isNotNull())
    return rows.distinct()


def hist_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.ordered(_messages(spark, sf_dir), counted=table(spark, sf_dir, "chat_messages")).select("session_id", "id", "position")


def hist_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.truncated(_messages(spark, sf_dir), ROUNDS).select("session_id", "id")


def hist_expire(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.expired(_messages(spark, sf_dir), NOW, 60).select("session_id", "id")


def hist_clear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.cleared(_messages(spark, sf_dir), notebook_id=7).select("session_id", "id", "role")


def hist_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.session_tokens(_messages(spark, sf_dir), "desktop")


def hist_over_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.to_compress(_messages(spark, sf_dir), LIMIT, KEEP)


def hist_transcript(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = history.transcripts(_messages(spark, sf_dir), counted=table(spark, sf_dir, "chat_messages"))
    return rows.select("session_id", F.md5("transcript").alias("transcript"))


def hist_compress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long sessions as one summary (here the beginning of the transcript) and their newest messages."""
    counted = table(spark, sf_dir, "chat_messages")
    rows = history.compressed(_messages(spark, sf_dir), lambda t: F.substring(t, 1, 100), LIMIT, KEEP, counted=counted)
    return rows.select("session_id", "position", "role", F.md5("content").alias("content"))


def hist_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A turn saved for every session that has none of the last 60 days."""
    rows = _messages(spark, sf_dir)
    newest = rows.groupBy("session_id").agg(
        F.max("id").alias("last"), F.max("create_time").alias("at"), F.max_by("document_id", "id").alias("document_id"),
        F.max_by("notebook_id", "id").alias("notebook_id"), F.max_by("user_id", "id").alias("user_id"),
    )
    turn = newest.select(
        "session_id", (F.col("last") + 10_000_000).alias("id"), "document_id", "notebook_id", "user_id", F.col("at").alias("create_time"),
        F.lit("q").alias("question"), F.when(F.pmod("last", F.lit(2)) == 0, "a").otherwise("").alias("answer"),
    )
    return history.append_turn(rows, turn).select("session_id", "id", "role", "document_id", F.md5("content").alias("content"))


def hist_speakers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _messages(spark, sf_dir).groupBy(history.speaker(F.col("role")).alias("speaker")).agg(F.count(F.lit(1)).alias("messages"))


def turn_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Estimated tokens of each answer as a turn: its session so far as prompt, itself as completion."""
    tokens = token_estimate(F.col("content"))
    rows = history.tokens_before(_messages(spark, sf_dir), tokens, counted=table(spark, sf_dir, "chat_messages"))
    usage = history.turn_usage(F.lit(50), F.col("before"), tokens)
    return rows.filter(F.col("role") == "assistant").select("id", usage.alias("u")).select("id", "u.prompt", "u.completion", "u.total")


def prompt_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _messages(spark, sf_dir).filter(F.col("role") == "user")
    listed = message_list(F.lit("system"), F.lit(None), user_prompt(F.coalesce("content", F.lit("")), F.lit("context")))
    return rows.select("id", F.md5(F.array_join(F.transform(listed, lambda m: F.concat_ws("=", m["role"], m["content"])), ";")).alias("messages"))


def citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _messages(spark, sf_dir).filter(F.col("role") == "assistant")
    return cite.citations(rows, "id", "content")


def answer_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _messages(spark, sf_dir).filter((F.col("role") == "assistant") & F.col("content").isNotNull())
    return rows.select("id", F.md5(cite.answer_text(F.col("content"))).alias("answer"))


def _streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every answer as the events it was sent in: one fragment a line, its usage, and an unfinished block."""
    rows = _messages(spark, sf_dir).filter((F.col("role") == "assistant") & F.col("content").isNotNull())
    lines = F.transform(F.split("content", "\n"), lambda x: stream.fragment_event(x))
    n = F.length("content")
    usage = stream.usage_event(F.struct(n.alias("prompt"), (n * 2).alias("completion"), (n * 3).alias("total")))
    return rows.select("id", F.concat(F.array_join(lines, ""), usage, F.lit("data:lost")).alias("raw"))


def sse_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = stream.decode_events(_streams(spark, sf_dir), "id", "raw")
    return events.select("id", "seq", "event", F.md5("data").alias("data"))


def sse_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = stream.answers(stream.decode_events(_streams(spark, sf_dir), "id", "raw"), "id")
    return got.select("id", F.md5("answer").alias("answer"), F.col("usage.total").alias("total"))


_M = "(SELECT DISTINCT * FROM chat_messages WHERE session_id IS NOT NULL)"
_TOKENS = "coalesce(CAST(floor(length(content) * 1.3::DOUBLE) AS BIGINT), 0)"
_LINE = "CASE WHEN role = 'user' THEN '用户: ' ELSE 'AI: ' END || coalesce(content, '') || chr(10) || chr(10)"
_JS = sql_text(cite._JS_SPACES)
_A = f"(SELECT * FROM {_M} WHERE role = 'assistant' AND content IS NOT NULL)"

QUERIES = {
    f.__name__: f
    for f in (
        hist_order, hist_truncate, hist_expire, hist_clear, hist_tokens, hist_over_limit, hist_transcript, hist_compress, hist_append,
        hist_speakers, turn_usage, prompt_messages, citations, answer_parts, sse_decode, sse_answers,
    )
}
SQL = {
    "hist_order": f"SELECT session_id, id, CAST(row_number() OVER (PARTITION BY session_id ORDER BY create_time, id) AS INTEGER) AS position FROM {_M}",
    "hist_truncate": f"SELECT session_id, id FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY create_time DESC, id DESC) AS r FROM {_M}) WHERE r <= {2 * ROUNDS}",
    "hist_expire": f"SELECT session_id, id FROM {_M} WHERE create_time IS NULL OR create_time >= TIMESTAMP '{NOW}' - INTERVAL 60 DAY",
    "hist_clear": f"SELECT session_id, id, role FROM {_M} WHERE notebook_id IS DISTINCT FROM 7",
    "hist_tokens": f"""SELECT session_id, count(*) AS messages, CAST(sum(coalesce(CAST(ceil(length(content) * 1.3::DOUBLE) AS BIGINT), 0)) AS BIGINT) AS tokens
        FROM {_M} GROUP BY session_id""",
    "hist_over_limit": f"""SELECT * FROM (SELECT session_id, count(*) AS messages, CAST(sum({_TOKENS}) AS BIGINT) AS tokens FROM {_M} GROUP BY session_id)
        WHERE tokens > {LIMIT} AND messages > {KEEP}""",
    "hist_transcript": f"SELECT session_id, md5(string_agg({_LINE}, '' ORDER BY create_time, id)) AS transcript FROM {_M} GROUP BY session_id",
    "hist_compress": f"""WITH m AS (SELECT * FROM {_M}),
      l AS (SELECT session_id FROM m GROUP BY session_id HAVING sum({_TOKENS}) > {LIMIT} AND count(*) > {KEEP}),
      r AS (SELECT m.*, l.session_id IS NOT NULL AS large, row_number() OVER (PARTITION BY m.session_id ORDER BY create_time DESC, id DESC) AS r FROM m LEFT JOIN l ON m.session_id = l.session_id),
      a AS (SELECT session_id, create_time, id, role, content FROM r WHERE NOT (large AND r > {KEEP})
        UNION ALL SELECT session_id, NULL, NULL, 'assistant', '【对话摘要】以下是之前对话的概要：' || chr(10) || left(string_agg({_LINE}, '' ORDER BY create_time, id), 100)
        FROM r WHERE large AND r > {KEEP} GROUP BY session_id)
      SELECT session_id, CAST(row_number() OVER (PARTITION BY session_id ORDER BY create_time NULLS FIRST, id NULLS FIRST) AS INTEGER) AS position, role, md5(content) AS content FROM a""",
    "hist_append": f"""WITH m AS (SELECT * FROM {_M}), t AS (SELECT session_id, max(id) AS last, arg_max_null(document_id, id) AS document_id FROM m GROUP BY session_id HAVING max(id) % 2 = 0)
        SELECT session_id, id, role, document_id, md5(content) AS content FROM m
        UNION ALL SELECT session_id, last + 10000000, 'user', document_id, md5('q') FROM t
        UNION ALL SELECT session_id, last + 10000001, 'assistant', document_id, md5('a') FROM t""",
    "hist_speakers": f"SELECT CASE WHEN role = 'user' THEN 'user' ELSE 'assistant' END AS speaker, count(*) AS messages FROM {_M} GROUP BY 1",
    "turn_usage": f"""SELECT id, CAST(50 + before AS INTEGER) AS prompt, CAST(own AS INTEGER) AS completion, CAST(50 + before + own AS INTEGER) AS total FROM (
        SELECT id, role, {_TOKENS} AS own, coalesce(sum({_TOKENS}) OVER (PARTITION BY session_id ORDER BY create_time, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
        FROM {_M}) WHERE role = 'assistant'""",
    "prompt_messages": f"""SELECT id, md5('system=system;user=' || '{CONTEXT_LABEL}' || chr(10) || 'context' || chr(10) || chr(10) || '{QUESTION_LABEL}' || chr(10) || coalesce(content, '')) AS messages
        FROM {_M} WHERE role = 'user'""",
    "citations": rf"""WITH a AS (SELECT id AS message_id, trim(string_split(content, '---')[1], {_JS}) AS answer, string_split(content, '---')[2] AS listed FROM {_A}),
      e AS (SELECT message_id, list_filter(list_transform(string_split(regexp_replace(coalesce(listed, ''), '(\[\d+\])', chr(1) || '\1', 'g'), chr(1)), lambda x: trim(x, {_JS})), lambda x: x <> '') AS entries, answer FROM a),
      p AS (SELECT message_id, answer, list_filter(list_transform(entries, lambda x:
          CASE WHEN regexp_matches(x, '{cite.TITLED}') THEN
            {{'id': TRY_CAST(regexp_extract(x, '{cite.TITLED}', 1) AS INTEGER), 'title': trim(regexp_extract(x, '{cite.TITLED}', 2), {_JS}),
              'snippet': trim(regexp_extract(x, '{cite.TITLED}', 3), {_JS})}}
          WHEN regexp_matches(x, '{cite.SIMPLE}') THEN {{'id': TRY_CAST(regexp_extract(x, '{cite.SIMPLE}', 1) AS INTEGER), 'title': '{cite.SIMPLE_TITLE}', 'snippet': trim(regexp_extract(x, '{cite.SIMPLE}', 2), {_JS})}} END),
          lambda x: x IS NOT NULL) AS parsed FROM e),
      f AS (SELECT message_id, CASE WHEN len(parsed) > 0 THEN parsed ELSE
          list_transform(regexp_extract_all(answer, '\[(\d{{1,9}})\]', 1), lambda n: {{'id': CAST(n AS INTEGER), 'title': '{cite.INLINE_TITLE}', 'snippet': ''}}) END AS c FROM p)
      SELECT message_id, CAST(place AS INTEGER) AS place, c.id AS id, c.title AS title, c.snippet AS snippet FROM (
        SELECT message_id, unnest(c) AS c, generate_subscripts(c, 1) - 1 AS place FROM f)""",
    "answer_parts": f"SELECT id, md5(trim(string_split(content, '---')[1], {_JS})) AS answer FROM {_A}",
    "sse_decode": f"""WITH l AS (SELECT id, length(content) AS n, string_split(content, chr(10)) AS lines FROM {_A})
      SELECT id, CAST(generate_subscripts(lines, 1) - 1 AS INTEGER) AS seq, 'message' AS event, md5(unnest(lines)) AS data FROM l
      UNION ALL SELECT id, CAST(len(lines) AS INTEGER), 'token-usage', md5('{{"prompt":' || n || ',"completion":' || (n * 2) || ',"total":' || (n * 3) || '}}') FROM l""",
    "sse_answers": f"SELECT id, md5(replace(content, chr(10), '')) AS answer, CAST(length(content) * 3 AS INTEGER) AS total FROM {_A}",
}
