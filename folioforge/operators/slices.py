"""Very long groups cut into slices by time, so that order within a group never has to be worked out in one task.

Only groups with more than ``long`` rows and more than a thousandth of all rows are cut, so at most 1000 groups are, and
their slices number a few thousand: both are safe to broadcast.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LONG = 200_000


@dataclass(frozen=True)
class Span:
    """A long group: where its times begin, how far they reach, and into how many slices it is cut."""

    group: str
    begin: int
    span: int
    parts: int


def _micros(time: Column) -> Column:
    return F.unix_micros(time.cast("timestamp"))


def long_groups(counted: DataFrame, group: Column, time: Column, long: int = LONG) -> list[Span]:
    """Sizes are counted from two columns with a partial aggregate; the number of all rows comes from the files' footers."""
    sizes = counted.select(group.alias("g"), _micros(time).alias("t")).filter(F.col("g").isNotNull())
    sizes = sizes.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.min("t").alias("begin"), F.max("t").alias("end"))
    limit = max(long, counted.count() // 1000)
    rows = sizes.filter(F.col("n") > limit).limit(1001).collect()
    return [Span(r["g"], r["begin"] or 0, max(1, (r["end"] or 0) - (r["begin"] or 0) + 1), -(-2 * r["n"] // limit)) for r in rows]


def with_slices(rows: DataFrame, spans: list[Span], group: str, time: str) -> DataFrame:
    """Adds ``slice``, which rises with time inside a group; 0 throughout for groups that are not long."""
    if not spans:
        return rows.withColumn("slice", F.lit(0))
    plan = rows.sparkSession.createDataFrame([(s.group, s.begin, s.span, s.parts) for s in spans], f"`{group}` string, _begin long, _span long, _parts long")
    part = F.floor((_micros(F.col(time)) - F.col("_begin")) / F.col("_span") * F.col("_parts")).cast("int")
    return rows.join(F.broadcast(plan), group, "left").withColumn("slice", F.coalesce(part, F.lit(0))).select(*rows.columns, "slice")


def before_slices(sliced: DataFrame, spans: list[Span], group: str, **sums: Column) -> DataFrame:
    """(group, slice, ...): of long groups what the sums come to before each slice begins."""
    inside = sliced.filter(F.col(group).isin([s.group for s in spans])).groupBy(group, "slice").agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    earlier = Window.partitionBy(group).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    return inside.select(group, "slice", *[F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(n) for n in sums])


def running(
    rows: DataFrame, group: str, time: str, order: list[Column], long: int = LONG, counted: DataFrame | None = None, **values: Column
) -> DataFrame:
    """Adds for each value its sum over the rows of the group that come earlier; ``order`` begins with the time.

    ``counted`` may give a plain table with the same columns to count sizes from, where ``rows`` is costly to work out.
    """
    spans = long_groups(rows if counted is None else counted, F.col(group), F.col(time), long)
    sliced = with_slices(rows, spans, group, time)
    earlier = Window.partitionBy(group, "slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = sliced
    for name, value in values.items():
        out = out.withColumn(name, F.coalesce(F.sum(value).over(earlier), F.lit(0)))
    if spans:
        before = before_slices(sliced, spans, group, **{f"_b_{n}": v for n, v in values.items()})
        out = out.join(F.broadcast(before), [group, "slice"], "left")
        for name in values:
            out = out.withColumn(name, F.col(name) + F.coalesce(F.col(f"_b_{name}"), F.lit(0)))
    return out.select(*rows.columns, *values)
