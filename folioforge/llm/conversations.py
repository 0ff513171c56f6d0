"""Conversations from message rows: parent pointers resolved by pointer jumping, broken conversations dropped.

``resolve_paths`` takes any rows with parent pointers; ``conversations`` derives the pointers of a session from its
order (each message answers the one before it) and resolves them the same way, from the first pointer to the root.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioforge.llm.messages import LONG_SESSION, in_sessions, says_something, sliced
from folioforge.session import cut


def resolve_paths(nodes: DataFrame, node: str = "node", parent: str = "parent", within: str | None = None) -> DataFrame:
    """For each node (root, depth, fate), fate being ``rooted``, ``orphan`` or ``cycle``; with ``within``, that column too.

    A null parent makes a root; a parent that is no node makes an orphan root, and all below it are orphans; nodes on a
    cycle, or that lead into one, are cycles with null root and depth. In each round every open node jumps to the
    ancestor its ancestor has reached, so a chain of n nodes takes log2(n) joins, on ids and a counter per row. Only the
    nodes that are open move and are written. Rows without progress in a round can make none later. Repeated nodes (same
    id) must be removed before. ``within`` names a column of groups that no pointer leaves; ids need be unique inside one
    only.
    """
    group = F.col(within) if within else F.lit(0)
    links = nodes.select(group.alias("within"), F.col(node).alias("node"), F.col(parent).alias("parent")).filter(F.col("node").isNotNull())
    held = links.select("within", F.col("node").alias("parent"), F.lit(True).alias("held"))
    start = links.join(held, ["within", "parent"], "left").select(
        "within",
        "node",
        F.when(F.col("held"), F.col("parent")).otherwise(F.col("node")).alias("ancestor"),
        F.when(F.col("held"), 1).otherwise(0).cast("long").alias("hops"),
        F.coalesce("held", F.lit(False)).alias("open"),
        (F.col("parent").isNotNull() & F.col("held").isNull()).alias("orphan"),
    )
    settled = _jump(cut(start))
    closed = ~F.col("open")
    return settled.select(
        *([F.col("within").alias(within)] if within else []),
        "node",
        F.when(closed, F.col("ancestor")).alias("root"),
        F.when(closed, F.col("hops")).alias("depth"),
        F.when(~closed, "cycle").when(F.col("orphan"), "orphan").otherwise("rooted").alias("fate"),
    )


def _jump(latest: DataFrame) -> DataFrame:
    """Rounds of jumps until no node is open or none of them gets further: the last state of every node."""
    settled = latest.filter(~F.col("open"))
    left = latest.filter("open").count()
    while left:
        moving = latest.filter("open")
        reached = settled.unionByName(moving).select(
            "within",
            F.col("node").alias("ancestor"),
            F.col("ancestor").alias("next"),
            F.col("hops").alias("more"),
            F.col("open").alias("still"),
            F.col("orphan").alias("lost"),
        )
        jumped = moving.join(reached, ["within", "ancestor"]).select(
            "within",
            "node",
            F.col("next").alias("ancestor"),
            (F.col("hops") + F.col("more")).alias("hops"),
            F.col("still").alias("open"),
            F.col("lost").alias("orphan"),
        )
        latest = cut(jumped)
        settled = settled.unionByName(latest.filter(~F.col("open")))
        now = latest.filter("open").count()
        if now == left:
            break
        left = now
    return settled.unionByName(latest.filter("open"))


def linked_messages(chat: DataFrame, long_session: int = LONG_SESSION) -> DataFrame:
    """Messages that say something, system rows left out, each with a pointer to the one before it in its session.

    (session, node, parent, id, role, content, at); node is unique inside a session. Exact repeats (same id, time, role
    and content) count once; order is time, then id, nulls first; rows that differ but share an id stay apart.
    """
    rows = in_sessions(chat).filter((F.col("role") != "system") & says_something(F.col("content")))
    rows = sliced(rows, chat, long_session)
    order = Window.partitionBy("session", "slice").orderBy(F.col("at"), F.col("id"), F.col("context").desc(), F.col("role"), F.col("content"))
    same = F.lit(True)
    for c in ("at", "id", "role", "content"):
        same = same & F.lag(c).over(order).eqNullSafe(F.col(c))
    first = F.row_number().over(order) == 1
    rows = rows.withColumn("again", F.when(first, False).otherwise(same)).filter(~F.col("again") | F.col("context"))
    # ids are unique in sound data; rows that share one are told apart by the rest
    node = F.xxhash64("id", F.col("at").cast("string"), "role", "content")
    rows = rows.drop("again").withColumn("node", node).withColumn("parent", F.lag("node").over(order))
    return rows.filter(~F.col("context")).select("session", "node", "parent", "id", "role", "content", "at")


def _drop_reason(messages: Column, unreadable: Column, first_assistant: Column, twice: Column, users: Column, answered: Column) -> Column:
    return (
        F.when(F.coalesce(messages, F.lit(0)) == 0, "empty")
        .when((unreadable > 0) | (first_assistant > 0) | (twice > 0), "broken")
        .when(users > answered, "missing_reply")
    )


def _count(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


def session_verdicts(chat: DataFrame, linked: DataFrame | None = None, paths: DataFrame | None = None, long_session: int = LONG_SESSION) -> DataFrame:
    """(session, reason): reason is null for the conversations that are kept, else why one is dropped.

    ``empty``: no message that says something is left; ``broken``: an unreadable role, an assistant first, two assistant
    messages in a row, or a path that is an orphan or a cycle; ``missing_reply``: a user message that is not the parent
    of an assistant message. Rows with null session_id belong to no session. An empty table gives no rows.
    """
    if linked is None:
        linked = cut(linked_messages(chat, long_session).select("session", "node", "parent", "role"))
    if paths is None:
        paths = resolve_paths(linked, within="session")
    above = linked.select("session", F.col("node").alias("parent"), F.col("role").alias("parent_role"))
    is_assistant = F.col("role") == "assistant"
    pairs = linked.join(above, ["session", "parent"], "left").groupBy("session").agg(
        F.count(F.lit(1)).alias("messages"),
        _count(F.col("role") == "unreadable").alias("unreadable"),
        _count(is_assistant & F.col("parent_role").isNull()).alias("first_assistant"),
        _count(is_assistant & (F.col("parent_role") == "assistant")).alias("twice"),
        _count(F.col("role") == "user").alias("users"),
        _count(is_assistant & (F.col("parent_role") == "user")).alias("answered"),
    )
    fates = paths.groupBy("session").agg(_count(F.col("fate") != "rooted").alias("lost"), _count(F.col("depth") == 0).alias("roots"))
    sessions = in_sessions(chat).select("session").distinct()
    return sessions.join(pairs, "session", "left").join(fates, "session", "left").select(
        "session",
        _drop_reason(
            F.col("messages"), F.col("unreadable") + F.col("lost") + F.greatest(F.col("roots") - 1, F.lit(0)), *[F.col(c) for c in ("first_assistant", "twice", "users", "answered")]
        ).alias("reason"),
    )


def conversations(chat: DataFrame, long_session: int = LONG_SESSION) -> DataFrame:
    """The conversations that are kept, one row per message: (session_id, turn, role, content, id, create_time).

    turn counts from 0 along the path from the root. The rows of a conversation are not gathered into one value, so a
    session of any length is fine.
    """
    linked = cut(linked_messages(chat, long_session))
    paths = resolve_paths(linked, within="session")
    kept = session_verdicts(chat, linked, paths).filter(F.col("reason").isNull()).select("session")
    return linked.join(kept, "session").join(paths.select("session", "node", "depth"), ["session", "node"]).select(
        F.col("session").alias("session_id"),
        F.col("depth").cast("int").alias("turn"),
        "role",
        "content",
        "id",
        F.col("at").alias("create_time"),
    )


def dropped_sessions(chat: DataFrame, long_session: int = LONG_SESSION) -> DataFrame:
    """(session_id, reason) of the conversations that cannot be used."""
    verdicts = session_verdicts(chat, long_session=long_session)
    return verdicts.filter(F.col("reason").isNotNull()).select(F.col("session").alias("session_id"), "reason")
