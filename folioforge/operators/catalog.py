"""Collections and their owners: scoped reads, existence, updates, cascading deletes, validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.operators.vectors import delete_documents


def newest_first(df: DataFrame) -> DataFrame:
    return df.orderBy(F.desc("create_time"), F.desc("id"))


def without(df: DataFrame, *columns: str) -> DataFrame:
    """What may be shown of a table: columns such as passwords left out, whether or not they are there."""
    return df.drop(*columns)


def owned(df: DataFrame, owner: str, user: int) -> DataFrame:
    return df.filter(F.col(owner) == user)


def owned_row(df: DataFrame, key: str, value: int, owner: str, user: int) -> DataFrame:
    return df.filter((F.col(key) == value) & (F.col(owner) == user))


def exists(df: DataFrame, condition: Column) -> bool:
    return not df.filter(condition).limit(1).isEmpty()


def children_of_owned(children: DataFrame, foreign: str, parents: DataFrame, key: str, owner: str, user: int) -> DataFrame:
    """Children whose parent the user owns: the ownership gate as a semi join."""
    mine = owned(parents, owner, user).select(F.col(key).alias("_parent"))
    return children.join(mine, F.col(foreign) == F.col("_parent"), "left_semi")


def find_by_name(df: DataFrame, column: str, name: str) -> DataFrame:
    return df.filter(F.col(column) == name).limit(1)


def repeated_keys(df: DataFrame, column: str) -> DataFrame:
    """Values that should be unique and are not."""
    return df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") > 1)


def append_rows(df: DataFrame, new: DataFrame, **fixed: object) -> DataFrame:
    """df with the rows of new, whose owner, time and the like are set by ``fixed``."""
    for column, value in fixed.items():
        new = new.withColumn(column, F.lit(value).cast(df.schema[column].dataType))
    return df.unionByName(new, allowMissingColumns=True)


def update_columns(df: DataFrame, key: str, changes: DataFrame, columns: list[str]) -> DataFrame:
    """df with ``columns`` taken from the row of changes that has the same key; a null there sets null."""
    delta = changes.select(F.col(key).alias("_key"), F.struct(*columns).alias("_new"))
    joined = df.join(delta, F.col(key) == F.col("_key"), "left")
    return joined.select(
        *[F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in df.columns]
    )


def validation_errors(df: DataFrame, rules: dict[str, list[tuple[str, Column]]]) -> DataFrame:
    """Adds ``errors``: 'field: message; ...' of the rules a row breaks, empty if none; a null check breaks its rule."""
    parts = [
        F.when(~F.coalesce(ok, F.lit(False)), F.lit(f"{field}: {message}")) for field, checks in rules.items() for message, ok in checks
    ]
    return df.withColumn("errors", F.concat_ws("; ", *parts))


def delete_document(tables: dict[str, DataFrame], documents: DataFrame, user: int | None = None) -> dict[str, DataFrame]:
    """vectors, messages and documents without the documents of ``documents`` (id) and what hangs on them.

    With a user, only that user's messages about a document go, as where several users share it.
    """
    gone = documents.select(F.col("id").alias("_gone")).filter(F.col("_gone").isNotNull()).distinct()
    about = F.col("document_id") == F.col("_gone")
    if user is not None:
        about = about & (F.col("user_id") == user)
    return {
        "vectors": delete_documents(tables["vectors"], gone, "_gone"),
        "messages": tables["messages"].join(gone, about, "left_anti"),
        "documents": tables["documents"].join(gone, F.col("id") == F.col("_gone"), "left_anti"),
    }


def delete_notebook(tables: dict[str, DataFrame], notebook: int, cascade: str = "full") -> dict[str, DataFrame]:
    """A notebook with its documents, their vectors and the conversations.

    cascade 'full' removes both kinds of conversation; 'web' only those about the notebook, which leaves the
    conversations about its documents orphaned.
    """
    if cascade not in ("full", "web"):
        raise ValueError(f"unknown cascade {cascade}")
    inside = tables["documents"].filter(F.col("notebook_id") == notebook).select("id")
    after = delete_document(tables, inside)
    messages = after["messages"] if cascade == "full" else tables["messages"]
    of_notebook = F.col("document_id").isNull() & F.col("notebook_id").eqNullSafe(F.lit(notebook))
    return {
        "notebooks": tables["notebooks"].filter(F.col("id") != notebook),
        "documents": tables["documents"].filter(~F.col("notebook_id").eqNullSafe(F.lit(notebook))),
        "vectors": after["vectors"],
        "messages": messages.filter(~of_notebook),
    }
