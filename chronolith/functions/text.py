"""Scalar text functions, Column to Column."""

from __future__ import annotations

import re

from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# fixed values: double-encoded punctuation and what it stands for
MOJIBAKE_NEWS = (("ΓÇô", "-"), ("ΓÇÖ", "'"), ("ΓÇ£", '"'), ("ΓÇ¥", '"'))
MOJIBAKE_RELEASE = (*MOJIBAKE_NEWS, ("╬ô├ç├û", "'"), ("╬ô├ç├┤", "-"), ("╬ô├ç┬ú", '"'), ("╬ô├ç┬Ñ", '"'))
MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")
ANCHOR_PHRASES = ("aggregate new vehicle sales", "total reported industry sales", "industry total", "total vehicle sales", "domestic new vehicle sales", "new vehicle sales")


def collapse(col: Column, repairs: tuple[tuple[str, str], ...] = MOJIBAKE_NEWS) -> Column:
    """Blanks (Unicode's too) to one space, known mojibake repaired, trimmed; null is empty."""
    out = F.coalesce(col, F.lit(""))
    for wrong, right in ((" ", " "), *repairs):
        out = F.replace(out, F.lit(wrong), F.lit(right))
    return F.trim(F.regexp_replace(out, r"(?U)\s+", " "))


def release_text(col: Column, most: int | None = None) -> Column:
    whole = collapse(col, MOJIBAKE_RELEASE)
    return whole if most is None else F.substring(whole, 1, most)


def whole_number(col: Column) -> Column:
    """'55,956' and '55 956' as a long; anything else null."""
    return F.nullif(F.translate(col, ", ", ""), F.lit("")).try_cast("bigint")


def stripped(col: Column) -> Column:
    """Without blanks of any kind at both ends; null is empty."""
    return F.regexp_replace(F.coalesce(col, F.lit("")), r"(?U)^\s+|\s+\z", "")


def _portable(col: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(stripped(col), r'[<>:"/\\|?*\x00-\x1F]', "_"), r"(?U)\s+", "_")


def file_name(col: Column, most: int = 180, default: str = "snapshot") -> Column:
    return F.coalesce(F.nullif(F.substring(_portable(col), 1, most), F.lit("")), F.lit(default))


def pdf_name(col: Column, most: int = 200) -> Column:
    safe = _portable(col)
    return F.substring(F.when(F.lower(safe).endswith(".pdf"), safe).otherwise(F.concat(safe, F.lit(".pdf"))), 1, most)


def usable(pattern: str) -> bool:
    """Whether Spark can run a pattern, and Python read it; configured patterns that are broken are left out."""
    try:
        re.compile(pattern)
        SparkSession.active()._jvm.java.util.regex.Pattern.compile(pattern)
    except (re.error, IllegalArgumentException):
        return False
    return True


def anchor_strength(evidence: Column) -> Column:
    """Two for each known phrase in the evidence, one more for its unit."""
    low = F.lower(F.coalesce(evidence, F.lit("")))
    total = (low.contains("units") | low.contains("vehicles")).cast("int")
    for phrase in ANCHOR_PHRASES:
        total = total + low.contains(phrase).cast("int") * 2
    return total


def month_name(number: Column) -> Column:
    return F.coalesce(F.get(F.array(*map(F.lit, MONTHS)), number - 1), F.lit(""))


def month_number(name: Column) -> Column:
    """From the first three letters; null if unknown."""
    at = F.array_position(F.array(*[F.lit(m[:3].lower()) for m in MONTHS]), F.lower(F.substring(name, 1, 3)))
    return F.nullif(at, F.lit(0).cast("bigint")).cast("int")


def context(text: Column, start: Column, end: Column, pad: int) -> Column:
    """Characters start to end (from 0) with pad more on both sides, trimmed."""
    low = F.greatest(start - pad, F.lit(0))
    return F.trim(F.substring(text, low + 1, end + pad - low))


def table_text(tables: Column, most: int = 60_000) -> Column:
    """Nested tables as text: cells joined by ' | ', blank rows left out, tables parted by a blank line."""
    row = lambda cells: F.array_join(F.filter(F.transform(cells, lambda c: F.trim(c)), lambda c: c.isNotNull()), " | ")
    one = lambda t: F.array_join(F.filter(F.transform(t, row), lambda r: F.length(F.regexp_replace(r, r"[ |]", "")) > 0), "\n")
    return F.substring(F.array_join(F.filter(F.transform(tables, one), lambda t: F.length(t) > 0), "\n\n"), 1, most)


def posix_path(col: Column) -> Column:
    """A path with slashes, runs of backslashes being one."""
    return F.regexp_replace(col, r"\\+", "/")


def windows_path(col: Column) -> Column:
    return F.replace(col, F.lit("/"), F.lit("\\"))
