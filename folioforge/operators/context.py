"""Context for an answer: numbered blocks, fallbacks under a budget, prompts and message lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioforge.functions.text import is_blank, trim, utf16_length, utf16_prefix

#: Separators, labels and notes of the assembled texts.
SEPARATOR = "\n\n---\n\n"
UNKNOWN_TITLE = "未知文档"
CUT_NOTE = "\n...（内容已截断）"
CUT_NOTE_ALL = "\n...（更多文档内容因长度限制未纳入上下文）"
NOTHING = "该笔记本下的文档内容均为空，无法回答问题。"
EMPTY_DOCUMENT = "文档内容为空，无法回答问题。"
NO_HITS = "（文档内容为空，无法提供背景上下文）"
CONTEXT_LABEL, QUESTION_LABEL = "【文档内容】", "【用户问题】"
SINGLE_LIMIT, TOTAL_LIMIT, LEAST_PART = 8000, 50_000, 100


def citation_block(rank: Column, title: Column, text: Column) -> Column:
    return F.concat(F.lit("["), rank.cast("string"), F.lit("] 来源："), F.coalesce(title, F.lit(UNKNOWN_TITLE)), F.lit("\n"), text)


def joined_blocks(hits: DataFrame, group: list[str], rank: str, title: str, text: str) -> DataFrame:
    """One context per group from its ranked hits (at most a top-k of them)."""
    block = citation_block(F.col(rank), F.col(title), F.col(text))
    ordered = F.array_sort(F.collect_list(F.struct(F.col(rank).alias("r"), block.alias("b"))))
    return hits.groupBy(*group).agg(F.array_join(F.transform(ordered, lambda x: x["b"]), SEPARATOR).alias("context"))


def cut_single(content: Column, limit: int = SINGLE_LIMIT) -> Column:
    """Lengths are UTF-16 units."""
    return F.when(utf16_length(content) > limit, F.concat(utf16_prefix(content, limit), F.lit(CUT_NOTE))).otherwise(content)


def budgeted_context(
    docs: DataFrame, group: str, order: str, title: str, content: str, budget: int = TOTAL_LIMIT, least: int = LEAST_PART
) -> DataFrame:
    """(group, context): the documents of each group in order, as sections, until the budget is used up.

    Blank documents are skipped. The first section that does not fit is cut to what is left if that is more than
    ``least``, and nothing follows; a note tells that something was cut. Groups whose documents are all blank get a
    fixed text. Since a section has a least length, only so many documents of a group can matter; the rest are dropped
    by rank before the running sum, which keeps a hot group's window small.
    """
    body = trim(F.col(content))
    section = F.concat(F.lit("\n【文档："), F.coalesce(F.col(title), F.lit("")), F.lit("】\n"), body, F.lit("\n"))
    # of a section only what the budget can hold travels; its whole length stands beside it
    kept = docs.select(group, F.col(order).alias("_o"), F.substring(section, 1, budget + 1).alias("_s"), F.length(body).alias("_n"), F.length(section).cast("long").alias("_size"))
    groups = docs.select(group).filter(F.col(group).isNotNull()).distinct()
    kept = kept.filter(F.col(group).isNotNull() & (F.col("_n") > 0))
    by = Window.partitionBy(group).orderBy("_o")
    most = budget // 9 + 2
    kept = kept.withColumn("_r", F.row_number().over(by)).filter(F.col("_r") <= most)
    size = F.col("_size")
    total = F.sum(size).over(by.rowsBetween(Window.unboundedPreceding, 0))
    kept = kept.withColumn("_t", total).withColumn("_left", budget - (F.col("_t") - size))
    part = F.concat(F.expr("substring(_s, 1, greatest(_left, 0))"), F.lit(CUT_NOTE))
    piece = F.when(F.col("_t") <= budget, F.col("_s")).when((F.col("_left") > least) & (F.col("_left") > 0), part)
    # only the first section that does not fit may be cut: those after it start beyond the budget
    over = F.max((F.col("_t") > budget).cast("int"))
    first_over = (F.col("_t") - size) <= budget
    assembled = kept.withColumn("_p", F.when((F.col("_t") <= budget) | first_over, piece)).groupBy(group).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("_p").isNotNull(), F.struct("_r", "_p")))), lambda x: x["_p"]), "").alias("text"),
        over.alias("over"),
    )
    whole = F.concat(F.col("text"), F.when(F.col("over") == 1, F.lit(CUT_NOTE_ALL)).otherwise(F.lit("")))
    return groups.join(assembled, group, "left").select(group, F.coalesce(whole, F.lit(NOTHING)).alias("context"))


def user_prompt(question: Column, context: Column) -> Column:
    """The question, with the context above it where there is one."""
    return F.when(F.length(context) > 0, labelled_prompt(question, context)).otherwise(question)


def labelled_prompt(question: Column, context: Column) -> Column:
    return F.concat(F.lit(f"{CONTEXT_LABEL}\n"), context, F.lit(f"\n\n{QUESTION_LABEL}\n"), question)


def several_prompt(question: Column, context: Column) -> Column:
    """The prompt over several documents: where nothing was found a note stands for the context."""
    return labelled_prompt(question, F.coalesce(F.nullif(context, F.lit("")), F.lit(NO_HITS)))


def answer_or_notice(content: Column, answer: Column, use_context: Column) -> Column:
    """A question to a blank document gets a fixed answer where the context is to be used; the model is not asked."""
    return F.when(is_blank(content) & use_context, F.lit(EMPTY_DOCUMENT)).otherwise(answer)


#: What a model is told, by what it answers from: one document, several, or none. Templates may be replaced by others.
SYSTEM_PROMPTS = {
    "document": "Answer from the given document only, in at most 300 characters, and say so if it holds no answer. "
    "Mark what you take from a numbered block with its number as [N]. After a line --- list each source as: [N] 【文档：title】excerpt",
    "notebook": "Answer from the given documents only, putting together what they say, in at most 300 characters, and say so if they hold no answer. "
    "Mark what you take from a numbered block with its number as [N]. After a line --- list every source as: [N] 【文档：title】excerpt",
    "general": "Answer from what you know, in at most 300 characters, and say so if you are not sure.",
}


def system_prompt(scope: Column, use_context: Column, templates: dict[str, str] | None = None) -> Column:
    """The template for scope ``document`` or ``notebook``; a document without its context gets the general one."""
    texts = {**SYSTEM_PROMPTS, **(templates or {})}
    return F.when(scope == "notebook", texts["notebook"]).when(use_context, texts["document"]).otherwise(texts["general"])


def message_list(system: Column, history: Column, user: Column) -> Column:
    """array<struct<role, content>>: system, history in order, user."""
    row = lambda role, c: F.struct(F.lit(role).alias("role"), c.cast("string").alias("content"))
    return F.concat(F.array(row("system", system)), F.coalesce(history, F.array().cast("array<struct<role:string,content:string>>")), F.array(row("user", user)))
