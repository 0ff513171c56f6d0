"""Answer streams: server-sent events decoded, fragments joined, the last usage kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FAILURE = "AI 服务暂时不可用，请稍后再试"
USAGE = "struct<prompt:int,completion:int,total:int>"


def blocks(raw: Column) -> Column:
    """The complete blocks of a stream: what follows the last blank line is unfinished and left out."""
    parts = F.split(raw, "\r?\n\r?\n")
    return F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))


def decode_events(streams: DataFrame, key: str, raw: str) -> DataFrame:
    """(key, seq, event, data): event is 'message' where none is named; blocks without data are skipped.

    The data lines of a block are joined without a line end, a blank after the colon is kept.
    """
    lines = F.split("block", "\r?\n")
    data = F.filter(lines, lambda x: x.startswith("data:"))
    names = F.transform(F.filter(lines, lambda x: x.startswith("event:")), lambda x: F.trim(F.substring(x, 7, 1_000_000)))
    return (
        streams.filter(F.col(raw).isNotNull())
        .select(key, F.posexplode(blocks(F.col(raw))).alias("seq", "block"))
        .withColumn("_data", data)
        .filter(F.size("_data") > 0)
        .select(
            key,
            "seq",
            F.coalesce(F.try_element_at(names, F.lit(-1)), F.lit("message")).alias("event"),
            F.array_join(F.transform("_data", lambda x: F.substring(x, 6, 1_000_000_000)), "").alias("data"),
        )
    )


def answers(events: DataFrame, key: str) -> DataFrame:
    """(key, answer, usage): text events joined in order, and the last usage that could be read."""
    text = F.when((F.col("event") != "token-usage") & (F.length("data") > 0), F.struct("seq", "data"))
    usage = F.when(F.col("event") == "token-usage", F.from_json("data", USAGE))
    return events.groupBy(key).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(text)), lambda x: x["data"]), "").alias("answer"),
        F.max_by(usage, F.when(usage.isNotNull(), F.col("seq"))).alias("usage"),
    )


def usage_event(usage: Column) -> Column:
    return F.concat(F.lit("event: token-usage\ndata:"), F.to_json(usage), F.lit("\n\n"))


def fragment_event(text: Column) -> Column:
    return F.concat(F.lit("data:"), text, F.lit("\n\n"))
