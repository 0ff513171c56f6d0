"""Text cleaning inside one expression per text: no explode, no shuffle, order of steps by variant."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.functions.text import strip, trim

CONTROL = r"[\x00-\x08\x0B\x0C\x0E-\x1F]"
WATERMARK_LENGTH, WATERMARK_SHARE, REPEATS = 12, 0.4, 3


def strip_control(c: Column) -> Column:
    return F.regexp_replace(c, CONTROL, "")


def collapse_newlines(c: Column) -> Column:
    return F.regexp_replace(c, "\n{3,}", "\n\n")


def drop_watermarks(lines: Column, variant: str = "web") -> Column:
    """Lines of at least 12 characters of which more than 0.4 are blanks (U+0020)."""

    def keep(line: Column) -> Column:
        t = strip(line, variant)
        n = F.length(t)
        blanks = n - F.length(F.replace(t, F.lit(" "), F.lit("")))
        return ~((n >= WATERMARK_LENGTH) & (blanks / F.greatest(n, F.lit(1)) > WATERMARK_SHARE))

    return F.filter(lines, keep)


def bound(value: Column, body) -> Column:
    """body(value), with value computed once: inside lambdas Spark repeats whatever an expression refers to."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _repeated_lines(ordered: Column) -> Column:
    """Of sorted lines those that fill at least REPEATS places in a row."""
    last = F.size(ordered) - REPEATS + 1
    runs = F.transform(
        F.sequence(F.lit(1), F.greatest(last, F.lit(1))),
        lambda i: F.when(F.get(ordered, i - 1) == F.get(ordered, i + REPEATS - 2), F.get(ordered, i - 1)),
    )
    return F.when(last > 0, F.array_distinct(F.filter(runs, lambda x: x.isNotNull() & (x != "")))).otherwise(
        F.array().cast("array<string>")
    )


def drop_repeated(lines: Column, variant: str = "web") -> Column:
    """All copies of a non-blank line that occurs at least three times in its text; n log n by sorting the lines."""

    def without(own: Column) -> Column:
        ordered = F.array_sort(F.transform(own, lambda x: strip(x, variant)))
        return bound(
            bound(ordered, _repeated_lines), lambda runs: F.filter(own, lambda x: ~F.array_contains(runs, strip(x, variant)))
        )

    return bound(lines, without)


def clean_text(c: Column, variant: str = "web") -> Column:
    """web: control characters, newline runs, watermarks, repeats, line ends; desktop: newline runs come last.

    Null gives an empty text.
    """
    if variant not in ("web", "desktop"):
        raise ValueError(f"unknown variant {variant}")
    text = strip_control(F.coalesce(c, F.lit("")))
    if variant == "web":
        text = collapse_newlines(text)
    kept = drop_repeated(drop_watermarks(F.split(text, "\n"), variant), variant)
    text = F.array_join(F.transform(kept, lambda x: strip(x, variant)), "\n")
    if variant == "desktop":
        text = collapse_newlines(text)
    return trim(text, variant)


def clean(df: DataFrame, column: str, variant: str = "web") -> DataFrame:
    return df.withColumn(column, clean_text(F.col(column), variant))
