"""String functions whose exact semantics matter: trimming, lengths, labels, small parsers. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPACES = "              　"
#: What the two variants strip from the ends of a line, and of a whole text.
STRIP_WEB = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f " + _SPACES
STRIP_DESKTOP = "\t\n\x0b\x0c\r " + " ﻿  " + _SPACES
TRIM_WEB = "".join(map(chr, range(0, 33)))
TRIM_DESKTOP = STRIP_DESKTOP


def strip(c: Column, variant: str = "web") -> Column:
    return F.btrim(c, F.lit(STRIP_WEB if variant == "web" else STRIP_DESKTOP))


def trim(c: Column, variant: str = "web") -> Column:
    return F.btrim(c, F.lit(TRIM_WEB if variant == "web" else TRIM_DESKTOP))


def is_blank(c: Column) -> Column:
    return F.coalesce(F.length(strip(c)) == 0, F.lit(True))


def utf16_length(c: Column) -> Column:
    """Length in UTF-16 units: characters outside the basic plane count two. Texts in ASCII are not encoded anew."""
    encoded = (F.octet_length(F.encode(c, "UTF-16BE")) / 2).cast("int")
    return F.when(F.octet_length(c) == F.length(c), F.length(c)).otherwise(encoded)


def utf16_prefix(c: Column, n: int) -> Column:
    """The first n UTF-16 units; half of a character outside the basic plane is left out."""
    units = F.encode(c, "UTF-16BE")
    half = F.hex(F.substring(units, 2 * n - 1, 1)).rlike("^D[89AB]")
    whole = F.decode(F.substring(units, F.lit(1), F.when(half, 2 * n - 2).otherwise(2 * n)), "UTF-16BE")
    return F.when(utf16_length(c) == F.length(c), F.substring(c, 1, n)).otherwise(whole)


def occurrences(text: Column, term: Column) -> Column:
    """How often term occurs in text without overlap; 0 for an empty term."""
    n = F.length(term)
    return F.when(n == 0, 0).otherwise(((F.length(text) - F.length(F.replace(text, term, F.lit("")))) / n).cast("int"))


def size_label(n: Column) -> Column:
    kb = F.format_string("%.1f KB", n.cast("double") / 1024)
    mb = F.format_string("%.1f MB", n.cast("double") / 1048576)
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1048576, kb).otherwise(mb)


def usage_cost(total: Column, per_thousand: float = 0.0015) -> Column:
    return F.format_string("%.4f", total.cast("double") * F.lit(per_thousand) / F.lit(1000.0))


def preview(c: Column, n: int = 50) -> Column:
    return F.replace(F.substring(c, 1, n), F.lit("\n"), F.lit(" "))


def date_label(at: Column, missing: str = "未知时间") -> Column:
    return F.coalesce(F.date_format(at, "yyyy/MM/dd HH:mm"), F.lit(missing))


def extension(name: Column) -> Column:
    """Lower case, without the dot; empty if there is none."""
    return F.lower(F.regexp_extract(name, r"\.([^./\\]+)$", 1))


def stem(name: Column) -> Column:
    base = F.regexp_extract(name, r"([^/\\]*)$", 1)
    return F.when(base.contains("."), F.regexp_extract(base, r"^(.*)\.[^.]*$", 1)).otherwise(base)


def route_ids(route: Column) -> Column:
    """struct(notebook, document) of '#notebook/N' or '#notebook/N/document/M'; null where absent."""
    return F.struct(
        F.nullif(F.regexp_extract(route, r"^#notebook/(\d+)", 1), F.lit("")).try_cast("long").alias("notebook"),
        F.nullif(F.regexp_extract(route, r"^#notebook/\d+/document/(\d+)", 1), F.lit("")).try_cast("long").alias("document"),
    )


def html_escape(c: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        c = F.replace(c, F.lit(raw), F.lit(safe))
    return c


def merged_content(extra: Column, text: Column) -> Column:
    """Extra text, a rule, the file's text; only the file's text if the extra is blank."""
    trimmed = trim(extra)
    return F.when(F.length(trimmed) > 0, F.concat(trimmed, F.lit("\n\n---\n\n"), text)).otherwise(text)


def token_estimate(c: Column, variant: str = "web") -> Column:
    """1.3 tokens a character, rounded down (web) or up (desktop); null and empty count 0."""
    scaled = utf16_length(c) * F.lit(1.3)
    return F.coalesce((F.floor(scaled) if variant == "web" else F.ceil(scaled)).cast("int"), F.lit(0))
