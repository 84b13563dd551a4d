"""Rule-based event labels: an ontology compiled to Columns."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronolith.functions.text import usable

@dataclass(frozen=True)
class Rule:
    code: str
    positive: tuple[str, ...]
    negative: tuple[str, ...] = ()
    min_score: int = 1


@dataclass(frozen=True)
class Ontology:
    rules: tuple[Rule, ...]
    title_weight: int = 2
    body_weight: int = 1

    @classmethod
    def from_dict(cls, config: dict) -> Ontology:
        scoring = config.get("scoring") or {}
        rules = tuple(
            Rule(code, tuple(r.get("positive_patterns") or ()), tuple(r.get("negative_patterns") or ()), int(r.get("min_score", 1))) for code, r in (config.get("ontology") or {}).items()
        )
        return cls(rules, int(scoring.get("title_weight", 2)), int(scoring.get("body_weight", 1)))

    @property
    def codes(self) -> list[str]:
        return [r.code for r in self.rules]


_CASELESS = re.compile(r"(?:[a-z0-9 '\-\[\]().?*+|]|\\[bBdDsSwW.()?*+|\-])+")


def _folded(col: Column) -> Column:
    """Lower case, with the two letters that ignoring case also takes for s and i."""
    return F.translate(F.lower(F.coalesce(col, F.lit(""))), "ſı", "si")


def _hit(col: Column, pattern: str) -> Column:
    """Whether a pattern occurs in folded text, whatever its case. Patterns without upper case need no folding again, and
    plain words no expression."""
    if re.fullmatch(r"[a-z0-9 ]+", pattern):
        return col.contains(pattern)
    return col.rlike(pattern if _CASELESS.fullmatch(pattern) and "(?" not in pattern else f"(?iu){pattern}")


def score(rule: Rule, ontology: Ontology, title: Column, body: Column) -> Column:
    """Of folded fields: each pattern adds the weight of each field it occurs in; a negative pattern in either field vetoes. Broken
    patterns count as absent."""
    points = [_hit(t, p).cast("int") * w for p in filter(usable, rule.positive) for t, w in ((title, ontology.title_weight), (body, ontology.body_weight))]
    total = reduce(lambda a, b: a + b, points, F.lit(0))
    if vetoes := list(filter(usable, rule.negative)):
        both = F.concat(title, F.lit("\n"), body)
        total = F.when(reduce(lambda a, b: a | b, [_hit(both, p) for p in vetoes]), 0).otherwise(total)
    return total


def scored(docs: DataFrame, ontology: Ontology, title: str = "title", text: str = "text") -> DataFrame:
    """docs with an integer score column for each code."""
    rows = docs.withColumns({"_title": _folded(F.col(title)), "_body": _folded(F.col(text))})
    return rows.select(*docs.columns, *[score(r, ontology, F.col("_title"), F.col("_body")).alias(r.code) for r in ontology.rules])


def label_matrix(docs: DataFrame, ontology: Ontology) -> DataFrame:
    """docs with 0 or 1 for each code."""
    wide = scored(docs, ontology)
    return wide.select(*docs.columns, *[(F.col(r.code) >= r.min_score).cast("int").alias(r.code) for r in ontology.rules])


def label_hits(docs: DataFrame, ontology: Ontology) -> DataFrame:
    """One row for each document and code that reaches its minimum, with event_code and score."""
    wide = scored(docs, ontology)
    pairs = F.array(*[F.struct(F.lit(r.code).alias("event_code"), F.col(r.code).alias("score"), F.lit(r.min_score).alias("least")) for r in ontology.rules])
    return wide.select(*docs.columns, F.explode(F.filter(pairs, lambda x: x["score"] >= x["least"])).alias("hit")).select(*docs.columns, "hit.event_code", "hit.score")


def month_counts(matrix: DataFrame, codes: list[str]) -> DataFrame:
    """Labels summed by period; documents without a period stay a group of their own."""
    return matrix.groupBy("period_year", "period_month").agg(*[F.sum(c).cast("bigint").alias(c) for c in codes])


def pattern_frequency(docs: DataFrame, ontology: Ontology, text: str = "text") -> DataFrame:
    """event_code and the number of (pattern, document) matches, case-sensitive on lower-cased text, in one pass."""
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    sums = docs.agg(*[F.sum(reduce(lambda a, b: a + b, [low.rlike(p).cast("bigint") for p in filter(usable, r.positive)], F.lit(0).cast("bigint"))).alias(r.code) for r in ontology.rules])
    return sums.unpivot([], ontology.codes, "event_code", "matches")


def listing_page(url: Column, title: Column, text: Column, raw: Column, published: Column, strict: bool = False) -> Column:
    """Whether an undated page is a listing, by its address or its title and length. strict: a null date counts as one."""
    some = lambda c: F.trim(F.coalesce(c, F.lit("nan" if strict else ""))) != ""
    u, t = F.lower(F.rtrim(F.coalesce(url, F.lit("")), F.lit("/"))), F.lower(F.trim(F.coalesce(title, F.lit(""))))
    address = u.rlike(r"^https?://[^/]+/news\z") | u.rlike(r"/news/(category|latest|industry|motoring|cars|vehicle)s?\z") | u.rlike(r"/category/[^/]+\z")
    named = reduce(lambda a, b: a | b, [t.contains(w) for w in ("motoring", "latest", "category", "news")])
    return ~(some(published) | some(raw)) & (address | (named & (F.length(F.coalesce(text, F.lit(""))) > 2000)))


def total_hits(matrix: DataFrame, codes: list[str]) -> DataFrame:
    """One row: articles_kept and total_hits."""
    hits = reduce(lambda a, b: a + b, [F.coalesce(F.sum(c), F.lit(0)) for c in codes], F.lit(0)).cast("bigint")
    return matrix.agg(F.count("*").alias("articles_kept"), hits.alias("total_hits"))
