"""Monthly totals from releases: tiered extraction with guards, evidence and warnings.

All tiers need match offsets, which Spark's regular expressions do not give, so they share one vectorised UDF over Arrow
batches; `industry_total_native` expresses the anchored tier in Columns.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronolith.functions.text import MONTHS, release_text, table_text
from chronolith.functions.times import period_of_file, with_period_of_text
from chronolith.shipping import ship

# fixed values: number token, guards, anchors and headline phrases, with their gaps
NUMBER = r"(\d{1,3}(?:[,\s]\d{3})+|\d+)"
BROAD = (10_000, 160_000)
SANE = (15_000, 70_000)
BAD = [re.compile(p) for p in (r"%", r"\bkg\b", r">\s*8500\s*kg", r"\bytd\b|\byear\s*to\s*date\b|\byear-to-date\b")]
EXPORT = re.compile(r"\bexport(s)?\b", re.I)
FULL_YEAR = re.compile(r"\bfull\s+year\b|\bcalendar\s+year\b|\bannual\b", re.I)
VERB = re.compile(r"\b(?:were|was|stood\s+at|came\s+in\s+at|recorded\s+at|totalled|totaled|amounted\s+to|at)\b", re.I)
KEY_GOES_ON = re.compile(r"[^\W\d_]+\d")
NEW_VEHICLE_SALES = r"\bnew\s*[- ]\s*vehicle\s+sales\b"
INDUSTRY_TOTAL = r"\bindustry\s+total\b"
HEADLINES = (
    ("AGGREGATE_NEW_VEHICLE_SALES_TO_UNITS", r"\baggregate\b.{0,160}\bnew[- ]vehicle\b.{0,120}\bsales\b.{0,140}\b(?:rose|increased|climbed|improved|grew)\b.{0,120}\bto\b", 40),
    ("AGGREGATE_NEW_VEHICLE_SALES_AT_UNITS", r"\baggregate\b.{0,220}\bnew[- ]vehicle\b.{0,160}\bsales\b.{0,120}\b(?:at|were\s+at|came\s+in\s+at|recorded\s+at)\b", 40),
    ("TOTAL_REPORTED_INDUSTRY_SALES_OF_VEHICLES", r"\btotal\b.{0,60}\breported\b.{0,60}\bindustry\b.{0,60}\bsales\b.{0,60}\b(?:of|at|were)\b", 40),
    ("NEW_VEHICLE_SALES_TOTALLED_UNITS", r"\bnew[- ]vehicle\b.{0,80}\bsales\b.{0,140}\b(?:totalled|totaled|amounted\s+to|were|stood\s+at|came\s+in\s+at|recorded)\b", 50),
    ("INDUSTRY_NEW_VEHICLE_SALES_RECORDED_UNITS", r"\bindustry\b.{0,60}\bnew[- ]vehicle\b.{0,60}\bsales\b.{0,120}\b(?:at|were\s+at|came\s+in\s+at|recorded\s+at|totalled|totaled)\b", 50),
    ("TOTAL_NEW_VEHICLE_SALES_WERE_UNITS", r"\b(?:total|overall)\b.{0,80}\bnew[- ]vehicle\b.{0,60}\bsales\b.{0,120}\b(?:were|stood\s+at|came\s+in\s+at|recorded\s+at)\b", 50),
)
FALLBACKS = (
    ("INDUSTRY_TOTAL", INDUSTRY_TOTAL),
    ("TOTAL_VEHICLE_SALES", r"\btotal\s+vehicle\s+sales\b"),
    ("NEW_VEHICLE_SALES", NEW_VEHICLE_SALES),
    ("DOMESTIC_NEW_VEHICLE_SALES", r"\bdomestic\b.{0,20}" + NEW_VEHICLE_SALES),
)

RESULT = "total_sales_units bigint, extraction_method string, extraction_confidence string, warning_flag string, evidence_pattern string, evidence_window string"


@dataclass(frozen=True)
class Limits:
    """Bounds and switches of an extraction. lazy_gaps lets a headline's gap stop before the number instead of inside it;
    closed_numbers refuses a token that digits follow.

    Characters that are looked at: of a text (chars; None: all), of it for headlines (head; None: all), after an anchor
    (ahead; after the industry total: total_ahead), for a verb before a number (lookback), around a fallback's anchor
    (window) and without one (no_anchor). anchors: how many are tried.
    """

    low: int = SANE[0]
    high: int = SANE[1]
    lazy_gaps: bool = False
    closed_numbers: bool = False
    chars: int | None = None
    head: int | None = None
    ahead: int = 450
    total_ahead: int = 260
    lookback: int = 80
    anchors: int = 6
    window: int = 380
    no_anchor: int = 9_000

    @classmethod
    def of(cls, low: int | None, high: int | None) -> Limits:
        return cls() if low is None or high is None or low > high else cls(low, high)

    def sane(self, value: int) -> bool:
        return self.low <= value <= self.high

    @property
    def number(self) -> re.Pattern:
        return re.compile(NUMBER + (r"(?!\d)" if self.closed_numbers else ""))

    @property
    def headlines(self) -> list[tuple[str, re.Pattern]]:
        shape = "{head}.{{0,{gap}}}{lazy}{number}.{{0,{gap}}}\\b(?:units|vehicles)\\b"
        number = ("(?<!\\d)" if self.lazy_gaps else "") + self.number.pattern
        return [(tag, re.compile(shape.format(head=head, gap=gap, lazy="?" if self.lazy_gaps else "", number=number), re.I | re.S)) for tag, head, gap in HEADLINES]


@dataclass(frozen=True)
class Total:
    value: int | None = None
    method: str = ""
    confidence: str = ""
    pattern: str = ""
    evidence: str = ""
    warning: str = ""

    def row(self) -> tuple:
        return self.value, self.method, self.confidence, self.warning, self.pattern, self.evidence


@dataclass
class Source:
    """A text with what the guards ask of places in it."""

    text: str
    limits: Limits
    period: tuple[int | None, int | None] = (None, None)
    low: str = field(init=False)

    def __post_init__(self) -> None:
        self.low = self.text.lower()

    def around(self, start: int, end: int, pad: int) -> str:
        return self.text[max(0, start - pad) : end + pad].strip()

    def near(self, rule: re.Pattern | list[re.Pattern], at: int, span: int) -> bool:
        part = self.low[max(0, at - span) : at + span]
        return any(r.search(part) for r in (rule if isinstance(rule, list) else [rule]))

    def numbers(self, start: int = 0, end: int | None = None) -> Iterator[tuple[int, int, int]]:
        """Value, start and end of each number token of a stretch, matched as if nothing surrounded it; parts of keys are none."""
        for m in self.limits.number.finditer(self.text[start:end]):
            if not self.in_key(start + m.start(1), start + m.end(1)):
                yield int(re.sub(r"[,\s]", "", m[1])) if re.fullmatch(r"[\d, ]+", m[1]) else -1, start + m.start(1), start + m.end(1)

    def in_key(self, start: int, end: int) -> bool:
        """Whether only letters part these digits from others on one side, as in keys and hashes (9c82e26784)."""
        before = start
        while before > 0 and self.text[before - 1].isalpha():
            before -= 1
        return 0 < before < start and self.text[before - 1].isdecimal() or KEY_GOES_ON.match(self.text, end) is not None

    def plausible(self, value: int, at: int, export_span: int | None) -> bool:
        return BROAD[0] <= value <= BROAD[1] and not self.near(BAD, at, 14) and (export_span is None or not self.near(EXPORT, at, export_span))

    def rank(self, value: int, at: int, place: int, evidence: str, verb: bool, check_export: bool) -> tuple[int, ...]:
        """Higher is better: period named, domestic, aggregate, verb, no full year, no export, sane, earlier."""
        year, month = self.period
        low = evidence.lower()
        named = int(bool(month) and 1 <= month <= 12 and MONTHS[month - 1].lower() in low) + int(bool(year) and str(year) in evidence)
        flags = ("domestic" in low, "aggregate" in low, verb, not self.near(FULL_YEAR, at, 25), not (check_export and self.near(EXPORT, at, 10)), self.limits.sane(value))
        return (named, *map(int, flags), -place)

    def warned(self, value: int) -> str:
        return "" if self.limits.sane(value) else "OUT_OF_RANGE"


def headline(text: str, limits: Limits, period: tuple[int | None, int | None]) -> Total:
    whole, head = Source(text, limits, period), Source(text[: limits.head], limits, period)
    best: tuple[tuple[int, ...], int, str, str] | None = None
    for tag, rule in limits.headlines:
        for m in rule.finditer(head.text):
            value, at = int(re.sub(r"\D", "", m[1])) if re.fullmatch(r"[\d, ]+", m[1]) else -1, m.start(1)
            if head.plausible(value, at, None) and not head.in_key(at, m.end(1)):
                evidence = whole.around(m.start(), m.end(), 280)
                key = head.rank(value, at, m.start(), evidence, VERB.search(evidence) is not None, True)
                if best is None or key > best[0]:
                    best = key, value, tag, evidence
    if best:
        return Total(best[1], "HEADLINE_REGEX", "high", best[2], best[3], whole.warned(best[1]))
    found: list[tuple[tuple[int, ...], int, str]] = []
    anchors = [m for _, m in zip(range(limits.anchors), re.finditer(NEW_VEHICLE_SALES, head.text, re.I), strict=False)]
    for anchor in anchors:
        for value, start, end in head.numbers(anchor.end(), anchor.end() + limits.ahead):
            if head.plausible(value, start, 10):
                verb = VERB.search(head.text[max(anchor.end(), start - limits.lookback) : start]) is not None
                evidence = whole.around(start, end, 280)
                found.append((head.rank(value, start, anchor.start(), evidence, verb, False), value, evidence))
    if not found:
        return Total()
    found.sort(key=lambda x: x[0], reverse=True)  # stable: the first found wins a tie
    key, value, evidence = found[0]
    if len(found) > 1 and found[1][0] == key and found[1][1] != value:
        return Total(evidence=evidence, warning="AMBIGUOUS")
    return Total(value, "HEADLINE_REGEX", "high" if key[0] and key[3] else "medium", "NEW_VEHICLE_SALES_ANCHORED_SCAN", evidence, whole.warned(value))


def industry_total(text: str, tables: str, limits: Limits) -> Total:
    for name, blob in (("TABLES", tables), ("TEXT", text)):
        anchor = re.search(INDUSTRY_TOTAL, blob, re.I)
        if not anchor:
            continue
        source = Source(blob, limits)
        valid = [x for x in source.numbers(anchor.end(), anchor.end() + limits.total_ahead) if source.plausible(x[0], x[1], 8)]
        if not valid:
            continue
        value, start, end = valid[0]
        warning = source.warned(value)
        sane = [v for v, _, _ in valid if limits.sane(v)]
        if not warning and len(sane) > 1 and abs(sane[0] - sane[1]) <= 0.10 * sane[0]:
            warning = "MULTIPLE_TOTALS_NEARBY"
        evidence = source.around(start, end, 600)
        wider = source.around(anchor.start(), anchor.end(), 600)
        if "industry total" not in evidence.lower() and "industry total" in wider.lower():
            evidence = wider
        return Total(value, "ANCHORED_INDUSTRY_TOTAL", "medium", f"INDUSTRY_TOTAL_FIRST_NUMBER_{name}", evidence, warning)
    return Total()


def fallback(text: str, limits: Limits) -> Total:
    low = text.lower()
    name, anchor = next(((n, m) for n, p in FALLBACKS if (m := re.search(p, low))), ("", None))
    whole = Source(text, limits)
    window = whole.around(anchor.start(), anchor.end(), limits.window) if anchor else text[: limits.no_anchor]
    base = max(0, anchor.start() - limits.window) if anchor else 0
    part = Source(window, limits)
    found = [(v, base + s) for v, s, _ in part.numbers() if limits.sane(v) and not part.near(BAD, s, 14) and not part.near(EXPORT, s, 10)]
    if not found:
        return Total()
    if not anchor:
        values = {v for v, _ in found}
        return Total(evidence=window, warning="AMBIGUOUS") if len(values) > 1 else Total(values.pop(), "FALLBACK_SCAN", "low", "FALLBACK_SCAN_NO_ANCHOR", window)
    near = sorted((abs(p - anchor.start()), v, p) for v, p in found)
    if len(near) > 1 and near[1][0] - near[0][0] <= 10 and near[1][1] != near[0][1]:
        return Total(evidence=window, warning="AMBIGUOUS")
    _, value, at = near[0]
    return Total(value, "FALLBACK_SCAN", "low", f"FALLBACK_SCAN_NEAR_{name}", whole.around(at, at + 1, limits.window))


def monthly_total(text: str, tables: str, limits: Limits, period: tuple[int | None, int | None]) -> Total:
    """The first tier that finds a value; without any, what the last tier says."""
    found = headline(text, limits, period)
    if found.value is None:
        found = industry_total(text, tables, limits)
    if found.value is None:
        found = fallback(text, limits)
    return found


def extract_totals(releases: DataFrame, limits: Limits = Limits()) -> DataFrame:  # noqa: B008  frozen
    """releases (text, tables array<array<array<string>>>, file_name, further columns) with period and the six fields."""
    ship(releases.sparkSession)
    file_year, file_month = period_of_file(F.col("file_name"))
    from_text = F.col("_text_year").isNotNull() & F.col("_text_month").isNotNull()

    @F.pandas_udf(RESULT)
    def totals(text: pd.Series, tables: pd.Series, year: pd.Series, month: pd.Series) -> pd.DataFrame:
        whole = lambda x: None if pd.isna(x) else int(x)
        rows = [monthly_total(t, b, limits, (whole(y), whole(m))).row() for t, b, y, m in zip(text, tables, year, month, strict=True)]
        names = [c.split()[0] for c in RESULT.split(", ")]
        out = pd.DataFrame(rows, columns=names)
        out["total_sales_units"] = out["total_sales_units"].astype("Int64")
        return out

    said = with_period_of_text(releases, "text", "_text_year", "_text_month")
    dated = said.withColumns({"period_year": F.when(from_text, F.col("_text_year")).otherwise(file_year), "period_month": F.when(from_text, F.col("_text_month")).otherwise(file_month)}).drop("_text_year", "_text_month")
    flat = F.coalesce(release_text(table_text(F.col("tables")), limits.chars), F.lit(""))
    return dated.withColumn("found", totals(release_text(F.col("text"), limits.chars), flat, "period_year", "period_month")).select("*", "found.*").drop("found")


FINAL = ("period_year", "period_month", "total_sales_units", "extraction_method", "extraction_confidence", "warning_flag", "evidence_pattern", "evidence_window", "pdf_path")


def final_table(found: DataFrame) -> DataFrame:
    """The fixed columns in their order; those that are not there are null."""
    return found.select(*[F.col(c) if c in found.columns else F.lit(None).cast("string").alias(c) for c in FINAL])


def industry_total_native(text: Column) -> Column:
    """The first plausible number in the 260 characters after 'industry total', without the guards of the full tier."""
    at = F.regexp_instr(F.lower(text), F.lit(r"industry\s+total"))
    tail = F.substring(text, at + 14, F.lit(260))
    values = F.transform(F.regexp_extract_all(tail, F.lit(r"(\d{1,3}(?:,\d{3})+|\d+)"), F.lit(1)), lambda x: F.replace(x, F.lit(","), F.lit("")).try_cast("bigint"))
    return F.when(at > 0, F.get(F.filter(values, lambda v: v.between(*BROAD)), F.lit(0)))
