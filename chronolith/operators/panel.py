"""Month tables: coverage and missingness audits, the panel, the plot frame, deduplication by month."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from chronolith.functions.text import anchor_strength
from chronolith.functions.times import month_start

KEYS = {"month_id", "period_year", "period_month", "total_sales_units", "year", "month_num"}
# fixed values: how far methods and confidences are trusted
METHOD_RANK = {"HEADLINE_REGEX": 3, "ANCHORED_INDUSTRY_TOTAL": 2, "FALLBACK_SCAN": 1}
CONFIDENCE_RANK = {"high": 3, "medium": 2, "low": 1}


def first_column(df: DataFrame, names: list[str]) -> str | None:
    return next((n for n in names if n in df.columns), None)


def numeric_columns(df: DataFrame, without: set[str] = frozenset(KEYS)) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, NumericType) and f.name not in without]


def intensity(columns: list[str]) -> Column:
    """Row sum, nulls as 0; 0.0 without columns."""
    return reduce(lambda a, b: a + b, [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns], F.lit(0.0))


def missing(total: str | None) -> Column:
    """Whether the total is no number; null if there is no such column."""
    return F.lit(None).cast("boolean") if total is None else F.col(total).try_cast("double").isNull()


def news_months(articles: DataFrame) -> DataFrame:
    return articles.where("month_id is not null").groupBy("month_id").agg(F.count("*").cast("int").alias("news_articles"))


def event_months(counts: DataFrame) -> DataFrame:
    return counts.select("month_id", intensity(numeric_columns(counts)).alias("event_intensity_total"))


def sales_months(sales: DataFrame, total: str | None = "total_sales_units") -> DataFrame:
    return sales.where("month_id is not null").groupBy("month_id").agg(F.count("*").cast("int").alias("naamsa_rows"), F.max(missing(total)).alias("naamsa_total_missing")).withColumn("naamsa_available", F.lit(1))


def panel_months(panel: DataFrame, total: str | None = "total_sales_units") -> DataFrame:
    rows = panel.where("month_id is not null").withColumn("sum", intensity(numeric_columns(panel)))
    return rows.groupBy("month_id").agg(F.count("*").cast("int").alias("panel_rows"), F.max(missing(total)).alias("panel_sales_missing"), F.sum("sum").alias("panel_event_intensity_total")).withColumn("panel_available", F.lit(1))


def coverage(news: DataFrame, events: DataFrame, sales: DataFrame, panel: DataFrame) -> DataFrame:
    """Full outer join of four month tables (unique months each); counts and flags of availability default to 0."""
    both = reduce(lambda a, b: a.join(b, "month_id", "full"), (news, events, sales, panel))
    zero = lambda c, kind: F.coalesce(F.col(c), F.lit(0)).cast(kind).alias(c)
    return both.select(
        "month_id", zero("news_articles", "int"), zero("event_intensity_total", "double"), zero("naamsa_available", "int"), "naamsa_total_missing", zero("panel_available", "int"), "panel_sales_missing", "panel_event_intensity_total"
    )


def missing_months(panel: DataFrame, field: str = "total_sales_units", dataset: str = "panel_monthly_events_sales", reason: str = "missing_in_panel") -> DataFrame:
    rows = panel.where(missing(field)).select("month_id").distinct()
    return rows.select("month_id", F.lit(field).alias("missing_field"), F.lit(dataset).alias("dataset"), F.lit(reason).alias("reason"))


def joined_panel(counts: DataFrame, sales: DataFrame) -> DataFrame:
    return counts.join(sales, ["period_year", "period_month"], "left")


def plot_frame(panel: DataFrame) -> DataFrame:
    """month_dt, sales and intensity of months that have either."""
    rows = panel.select(month_start(F.col("month_id")).alias("month_dt"), F.col("total_sales_units").try_cast("double").alias("sales"), intensity(numeric_columns(panel)).alias("intensity"))
    return rows.where("month_dt is not null and (sales is not null or intensity <> 0)")


def ranked(col: str, ranks: dict[str, int]) -> Column:
    table = F.create_map(*[F.lit(x) for pair in ranks.items() for x in pair])
    return F.coalesce(F.try_element_at(table, F.coalesce(F.col(col), F.lit(""))), F.lit(0))


def best_by_month(rows: DataFrame) -> DataFrame:
    """Of each period the row by method, confidence, strength of evidence, having a total, and path."""
    order = (
        ranked("extraction_method", METHOD_RANK).desc(),
        ranked("extraction_confidence", CONFIDENCE_RANK).desc(),
        anchor_strength(F.col("evidence_window")).desc(),
        F.col("total_sales_units").isNotNull().desc(),
        F.coalesce("pdf_path", F.lit("")).asc(),
    )
    place = F.row_number().over(Window.partitionBy("period_year", "period_month").orderBy(*order))
    return rows.where("period_year is not null and period_month is not null").withColumn("place", place).where("place = 1").drop("place")
