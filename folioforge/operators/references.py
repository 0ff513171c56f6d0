"""References to records that do not exist: orphans by reason, table and period.

Method: a Bloom filter of the parent keys proves most orphans at the scan; only keys that pass it are verified by an
exact join. Verification runs on one row per key (pre-aggregated before the shuffle, so a hot key costs one row), and
rows are touched again only for keys that have a finding.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.operators.bloom import MAX_BITS, bloom_filter, might_contain


@dataclass(frozen=True)
class Reference:
    """Rows of ``rows`` point by ``key`` to a parent; ``row_key`` names the row, ``at`` is when it was written."""

    table_name: str
    rows: DataFrame
    row_key: Column
    key: Column
    at: Column


def orphan_references(
    references: list[Reference],
    parents: DataFrame,
    parent_key: str,
    parent_time: str,
    deletions: DataFrame,
    deleted_key: str,
    max_bits: int = MAX_BITS,
) -> DataFrame:
    """(table_name, row_key, reason, period), each row once.

    reason: ``deleted`` (no parent, but logged as deleted), ``missing`` (neither) or ``late`` (the parent's time lies
    after the row's). Defined cases: a null key is no reference; a null row time is never late and has a null period;
    a parent without a time is never late; of several parent rows of one key the earliest time holds; a key both
    deleted and present counts as present; repeated rows count once; empty tables give an empty result or only
    missing references. Extra columns of any name are never read.
    """
    if not references:
        raise ValueError("no references")
    spark = parents.sparkSession
    refs = reduce(
        DataFrame.unionByName,
        [
            r.rows.select(
                F.lit(r.table_name).alias("table_name"),
                r.row_key.cast("string").alias("row_key"),
                r.key.cast("long").alias("ref"),
                r.at.cast("timestamp_ntz").alias("at"),
            )
            for r in references
        ],
    ).filter(F.col("ref").isNotNull())

    held = parents.select(
        F.col(parent_key).cast("long").alias("ref"), F.col(parent_time).cast("timestamp_ntz").alias("held_at")
    )
    count = parents.count()  # answered from the files' footers
    known = bloom_filter(held.select("ref"), F.col("ref"), count, max_bits)

    # One row per referenced key: the partial aggregate runs before the shuffle.
    keys = refs.groupBy("ref").agg(F.min("at").alias("first_at"))
    passes = might_contain(known, F.col("ref"))
    held_once = held.filter(F.col("ref").isNotNull()).groupBy("ref").agg(F.min("held_at").alias("held_at"))
    verified = (
        keys.filter(passes)
        .join(held_once.withColumn("held", F.lit(True)), "ref", "left")
        .filter(F.col("held").isNull() | (F.col("held_at") > F.col("first_at")))
        .select("ref", F.coalesce("held", F.lit(False)).alias("held"), "held_at")
    )
    proven = keys.filter(~passes).select(
        "ref", F.lit(False).alias("held"), F.lit(None).cast("timestamp_ntz").alias("held_at")
    )
    logged = deletions.select(F.col(deleted_key).cast("long").alias("ref")).distinct().withColumn("logged", F.lit(True))
    findings = (
        verified.unionByName(proven)
        .join(logged, "ref", "left")
        .select(
            "ref",
            "held_at",
            F.when(F.col("held"), "late").when(F.col("logged"), "deleted").otherwise("missing").alias("reason"),
        )
    )

    # Rows of keys without a finding end here, before any shuffle of rows.
    suspect = bloom_filter(findings.select("ref"), F.col("ref"), max(1024, count // 8), max_bits)
    return (
        refs.filter(might_contain(suspect, F.col("ref")))
        .join(findings, "ref")
        .filter((F.col("reason") != "late") | (F.col("held_at") > F.col("at")))
        .select("table_name", "row_key", "reason", F.date_format("at", "yyyy-MM").alias("period"))
        .distinct()
    )


def orphan_counts(orphans: DataFrame) -> DataFrame:
    """Orphans per table, period and reason."""
    return orphans.groupBy("table_name", "period", "reason").agg(F.count(F.lit(1)).alias("orphans"))


def latest_version(df: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """Of rows that share a key the one of highest order; a partial aggregate, no sort. Null keys are left out."""
    packed = F.max_by(F.struct(*columns), F.coalesce(F.col(order), F.lit(-(2**62)))).alias("v")
    return df.filter(F.col(key).isNotNull()).groupBy(key).agg(packed).select(key, "v.*")
