"""Date and month functions, Column to Column. Unparsable values are null, never errors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronolith.functions.text import MONTHS, month_number

_NAMES = "|".join(MONTHS)
_YEAR = r"((?:19|20)\d{2})"
WRITTEN = ("d MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm:ss z", "d MMMM yyyy", "d MMM yyyy", "MMMM d, yyyy", "MMM d, yyyy", "d MMMM yyyy HH:mm", "MMMM d, yyyy HH:mm", "yyyy/MM/dd", "yyyy/MM/dd HH:mm:ss", "yyyyMMdd", "MM/dd/yyyy")
NEAR = 80  # characters around a month in which the word 'sales' counts
HEAD = 16_000  # characters of a release in which its period is looked for


def parsed(col: Column) -> Column:
    """A timestamp from the usual ISO forms, and from those of WRITTEN, with or without a weekday before them."""
    c = F.nullif(F.trim(col), F.lit(""))
    plain = F.regexp_replace(c, r"(?i)^(?:mon|tue|wed|thu|fri|sat|sun)[a-z]*,? ", "")
    return F.coalesce(F.try_to_timestamp(c), *[F.try_to_timestamp(plain, F.lit(form)) for form in WRITTEN])


def iso_utc(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def month_of(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM")


def month_id(year: Column, month: Column) -> Column:
    return F.concat(year.cast("string"), F.lit("-"), F.lpad(month.cast("string"), 2, "0"))


def month_start(month: Column) -> Column:
    return F.try_to_date(F.concat(month, F.lit("-01")), "yyyy-MM-dd")


def year_of_month(month: Column) -> Column:
    return F.substring(month, 1, 4).try_cast("int")


def number_of_month(month: Column) -> Column:
    return F.substring(month, 6, 2).try_cast("int")


def date_in_url(url: Column) -> Column:
    """/YYYY/MM/DD/, else YYYY-MM-DD or YYYY_MM_DD; the first match decides, even if it is no date."""
    def of(pattern: str) -> Column:
        parts = [F.regexp_extract(url, pattern, k) for k in (1, 2, 3)]
        return F.when(parts[0] != "", F.concat_ws("-", *parts))
    found = F.coalesce(of(r"/(20\d{2})/(\d{2})/(\d{2})/"), of(r"(20\d{2})[-_](\d{2})[-_](\d{2})"))
    return F.try_to_date(found, "yyyy-MM-dd")


def date_in_text(text: Column) -> Column:
    """'5 March 2024' (also 'Mar'), else YYYY-MM-DD or YYYY/MM/DD; the first match decides."""
    short = "|".join(f"{m[:3]}(?:{m[3:]})?" if m[3:] else m for m in MONTHS)
    named = rf"(?i)\b([0-3]?\d)\s+({short}|Sept)\s+{_YEAR}\b"
    year, month, day = F.regexp_extract(text, named, 3), month_number(F.regexp_extract(text, named, 2)), F.regexp_extract(text, named, 1)
    first = F.when(year != "", F.concat_ws("-", year, F.lpad(month.cast("string"), 2, "0"), F.lpad(day, 2, "0")))
    plain = rf"\b{_YEAR}[-/](0[1-9]|1[0-2])[-/]([0-3]\d)\b"
    parts = [F.regexp_extract(text, plain, k) for k in (1, 2, 3)]
    second = F.when(F.regexp_extract(text, plain, 1) != "", F.concat_ws("-", *parts))
    return F.when(text.rlike(_YEAR), F.try_to_date(F.coalesce(first, second), "yyyy-MM-dd"))  # most texts have no year: a quick look


def event_time(published: Column, raw: Column, url: Column, fetched: Column) -> Column:
    return F.coalesce(parsed(published), parsed(raw), date_in_url(url).cast("timestamp"), parsed(fetched))


def period_of_file(name: Column) -> tuple[Column, Column]:
    """Year and month from a file name: the first month in calendar order that occurs anywhere, the first year; a
    YYYY_MM_ prefix fills what is missing if no month is named."""
    low = F.lower(F.coalesce(name, F.lit("")))
    named = F.lit(None).cast("int")
    for k in range(12, 0, -1):
        named = F.when(low.contains(MONTHS[k - 1].lower()), k).otherwise(named)
    year = F.nullif(F.regexp_extract(low, _YEAR, 1), F.lit("")).try_cast("int")
    prefix = r"^(19\d{2}|20\d{2})_(0[1-9]|1[0-2])_"
    pre_year, pre_month = (F.nullif(F.regexp_extract(low, prefix, k), F.lit("")).try_cast("int") for k in (1, 2))
    return F.when(named.isNull() & pre_year.isNotNull(), pre_year).otherwise(year), F.coalesce(named, pre_month)


_ANY_MONTH = rf"(?i)\b({_NAMES})\s+{_YEAR}\b"
_PHRASES = (
    rf"(?i)(?:for|during)\s+(?:the\s+)?month\s+of\s+(?:{_NAMES})\s+{_YEAR}",
    rf"(?i)\b(?:{_NAMES})\s+{_YEAR}\s+(?:new\s+vehicle\s+)?sales\b",
    rf"(?i)\bIn\s+(?:{_NAMES})\s+{_YEAR}\b",
)


def release_head(text: Column, chars: int = HEAD) -> Column:
    """Where a release's period is looked for."""
    return F.substring(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " ")), 1, chars)


def period_phrase(head: Column, near: int = NEAR) -> Column:
    """The explicit phrase that tells the period, else the first month and year if the word 'sales' is near; or null."""
    explicit = [F.nullif(F.regexp_extract(head, p, 0), F.lit("")) for p in _PHRASES]
    first, at = F.regexp_extract(head, _ANY_MONTH, 0), F.regexp_instr(head, F.lit(_ANY_MONTH))  # its place counts from 1
    low = F.greatest(at - near, F.lit(1))
    sales = F.lower(F.substring(head, low, at + F.length(first) + near - low)).contains("sales")
    return F.when(head.rlike(_YEAR), F.coalesce(*explicit, F.when(sales, F.nullif(first, F.lit("")))))  # most texts have no year: a quick look


def with_period_of_text(df: DataFrame, text_col: str, year: str = "text_year", month: str = "text_month") -> DataFrame:
    """df with the year and month that its releases are about. Each step is a column of its own, computed once a row."""
    said = df.withColumn("_head", release_head(F.col(text_col))).withColumn("_said", period_phrase(F.col("_head"))).drop("_head")
    name = month_number(F.regexp_extract("_said", _ANY_MONTH, 1))
    return said.withColumns({year: F.nullif(F.regexp_extract("_said", _ANY_MONTH, 2), F.lit("")).try_cast("int"), month: name}).drop("_said")


def now_iso(clock: Column | None = None) -> Column:
    """The time of the query, or of a given clock, in UTC to the second."""
    return iso_utc(F.current_timestamp() if clock is None else clock)
