"""Bloom filters as Catalyst expressions: built by a partial aggregate, probed inside codegen.

The filter is a scalar subquery, so building it is part of the plan that uses it. Its size is fixed by ``max_bits``
whatever the data; once saturated it lets more rows through, which costs time but never correctness, because every
caller verifies what passes by an exact join.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: 8 MB; what is broadcast never exceeds it.
MAX_BITS = 1 << 26


def _expressions(df: DataFrame):
    from pyspark.sql.classic.column import Column as ClassicColumn

    jvm = df.sparkSession._jvm
    utils = jvm.org.apache.spark.sql.classic.ExpressionUtils
    return (
        jvm.org.apache.spark.sql.catalyst.expressions,
        lambda c: utils.expression(c._jc),
        lambda e: ClassicColumn(utils.column(e)),
    )


def bits_for(items: int, rate: float = 0.01, max_bits: int = MAX_BITS) -> int:
    return int(min(max_bits, max(1024, math.ceil(-max(items, 1) * math.log(rate) / math.log(2) ** 2))))


def bloom_filter(keys: DataFrame, key: Column, items: int, max_bits: int = MAX_BITS) -> DataFrame:
    """One row with the filter over ``key``; null keys are left out, and no keys give a null filter."""
    ex, to_expr, to_col = _expressions(keys)
    bits = bits_for(items, max_bits=max_bits)
    # Spark caps the number of items by a setting of its own; only the ratio of bits to items matters for the hashes
    capped = max(1, min(items, 4_000_000))
    agg = ex.aggregate.BloomFilterAggregate(
        to_expr(F.xxhash64(key)), to_expr(F.lit(capped).cast("long")), to_expr(F.lit(bits).cast("long"))
    )
    return keys.filter(key.isNotNull()).agg(to_col(agg.toAggregateExpression()).alias("filter"))


def might_contain(filter_row: DataFrame, key: Column) -> Column:
    """False: certainly not among the keys. True: perhaps. An empty filter contains nothing; a null key gives false."""
    ex, to_expr, to_col = _expressions(filter_row)
    probe = to_col(ex.BloomFilterMightContain(to_expr(filter_row.scalar()), to_expr(F.xxhash64(key))))
    return key.isNotNull() & F.coalesce(probe, F.lit(False))
