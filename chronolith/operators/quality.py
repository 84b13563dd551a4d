"""Column profiles and the data-quality gate: every check is a row, one aggregation a table."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from chronolith.functions.times import month_id, month_of, parsed


class GateError(Exception):
    pass


def profile(df: DataFrame, order: str) -> DataFrame:
    """column, dtype, missing_count, missing_pct and example_value (of the first row by order), by column, in one pass."""
    types = dict(df.dtypes)
    counts = df.agg(F.count("*").alias("rows"), *[F.count(F.col(c)).alias(f"n.{c}") for c in df.columns], *[F.min_by(F.col(c).cast("string"), F.when(F.col(c).isNotNull(), F.col(order))).alias(f"x.{c}") for c in df.columns])
    rows = [
        F.struct(
            F.lit(c).alias("column"),
            F.lit(types[c]).alias("dtype"),
            (F.col("rows") - F.col(f"`n.{c}`")).alias("missing_count"),
            F.round(100.0 * (F.col("rows") - F.col(f"`n.{c}`")) / F.greatest(F.col("rows"), F.lit(1)), 2).alias("missing_pct"),
            F.coalesce(F.col(f"`x.{c}`"), F.lit("")).alias("example_value"),
        )
        for c in df.columns
    ]
    return counts.select(F.explode(F.array(*rows)).alias("r")).select("r.*").orderBy("column")


def shown(value: Column) -> Column:
    """A cell of a markdown table: bars escaped, one line, 80 characters at most."""
    plain = F.replace(F.replace(value, F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))
    return F.when(F.length(plain) > 80, F.concat(F.substring(plain, 1, 77), F.lit("..."))).otherwise(plain)


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def require_columns(df: DataFrame, names: list[str]) -> None:
    if gone := [n for n in names if n not in df.columns]:
        raise GateError(f"missing columns: {gone}")


def _checks(df: DataFrame, table: str, sums: dict[str, Column], passed: dict[str, Column]) -> DataFrame:
    row = df.agg(*[c.alias(k) for k, c in sums.items()])
    parts = [F.struct(F.lit(table).alias("table"), F.lit(k).alias("check"), passed[k].alias("passed"), F.col(k).cast("bigint").alias("detail")) for k in sums]
    return row.select(F.explode(F.array(*parts)).alias("r")).select("r.*")


def unique(keys: list[str]) -> Column:
    """Rows beyond the first of their key."""
    return F.count("*") - F.count_distinct(F.struct(*[F.coalesce(F.col(k).cast("string"), F.lit("\0")) for k in keys]))


def article_checks(articles: DataFrame, least_months: int = 6) -> DataFrame:
    require_columns(articles, ["article_id", "url", "published_at"])
    month = month_of(parsed(F.col("published_at")))
    sums = {"unique_article_id": unique(["article_id"]), "url_not_null": F.count_if(F.col("url").isNull()), "dates_parse": F.count(month), "months": F.count_distinct(month)}
    return _checks(articles, "news_articles", sums, {"unique_article_id": F.col("unique_article_id") == 0, "url_not_null": F.col("url_not_null") == 0, "dates_parse": F.col("dates_parse") > 0, "months": F.col("months") >= least_months})


def count_checks(counts: DataFrame, codes: list[str], least_months: int = 12) -> DataFrame:
    require_columns(counts, ["period_year", "period_month"])
    if not codes:
        raise GateError("no event columns")
    sums = {"unique_period": unique(["period_year", "period_month"]), "months": F.count("*"), **_event_sums(codes)}
    return _checks(counts, "monthly_event_counts", sums, {"unique_period": F.col("unique_period") == 0, "months": F.col("months") >= least_months, "numeric": F.col("numeric") == 0, "not_negative": F.col("not_negative") == 0})


def sales_checks(sales: DataFrame, low: int = 10_000, high: int = 200_000) -> DataFrame:
    """in_range is reported and never fails."""
    require_columns(sales, ["period_year", "period_month", "total_sales_units"])
    v = F.col("total_sales_units").try_cast("double")
    sums = {"unique_period": unique(["period_year", "period_month"]), "missing_totals": F.count_if(v.isNull()), "positive": F.count_if(v <= 0), "in_range": F.count_if(~v.between(low, high))}
    return _checks(sales, "sales_headlines", sums, {"unique_period": F.col("unique_period") == 0, "missing_totals": F.lit(True), "positive": F.col("positive") == 0, "in_range": F.lit(True)})


_PANEL_KEYS = ("month_id", "total_sales_units", "period_year", "period_month")


def _event_sums(codes: list[str]) -> dict[str, Column]:
    """How many rows have an event count that is no number, or a negative one."""
    any_of = lambda f: reduce(lambda a, b: a | b, [f(F.col(c).try_cast("double")) for c in codes], F.lit(False))
    return {"numeric": F.count_if(any_of(lambda c: c.isNull())), "not_negative": F.count_if(any_of(lambda c: c < 0))}


def panel_checks(panel: DataFrame) -> DataFrame:
    """All columns beside the keys are event counts. Without year and month columns nothing has to agree with them."""
    require_columns(panel, ["month_id", "total_sales_units"])
    sums = {"unique_month": unique(["month_id"]), **_event_sums([c for c in panel.columns if c not in _PANEL_KEYS])}
    if {"period_year", "period_month"} <= set(panel.columns):
        sums["month_agrees"] = F.count_if(~F.substring("month_id", 1, 7).eqNullSafe(month_id(F.col("period_year"), F.col("period_month"))))
    passed = {k: F.col(k) == 0 for k in sums}
    sums["missing_sales"] = F.count_if(F.col("total_sales_units").try_cast("double").isNull())
    return _checks(panel, "panel", sums, passed | {"missing_sales": F.lit(True)})


def documented_months(text: str) -> list[str]:
    """Months that a document lists as missing, in lines '- YYYY-MM'. A document without any is an error."""
    if not (found := re.findall(r"(?m)^- (\d{4}-\d{2})\s*$", text)):
        raise GateError("the document lists no missing months")
    return sorted(set(found))


def documented_checks(panel: DataFrame, months: DataFrame) -> DataFrame:
    """Months without sales against the documented ones (column month_id): each month that only one side has fails."""
    computed = panel.where(F.col("total_sales_units").try_cast("double").isNull()).select(F.substring("month_id", 1, 7).alias("month_id"))
    sides = same_set(computed, months.select(F.col("month_id").cast("string")))
    parts = [F.struct(F.lit("panel").alias("table"), F.lit(name).alias("check"), (F.col(side) == 0).alias("passed"), F.col(side).alias("detail")) for name, side in (("undocumented", "only_left"), ("not_missing", "only_right"))]
    return sides.select(F.explode(F.array(*parts)).alias("r")).select("r.*")


def same_set(a: DataFrame, b: DataFrame) -> DataFrame:
    """only_left and only_right: how many distinct rows one side lacks; repeats do not count."""
    left, right = a.subtract(b).agg(F.count("*").alias("only_left")), b.subtract(a).agg(F.count("*").alias("only_right"))
    return left.crossJoin(right)  # one row each


def snapshot_mismatches(rows: DataFrame, files: DataFrame, sample: int | None = None, key: str = "article_id") -> DataFrame:
    """Rows whose recorded digest differs from that of the stored bytes (files: path, content), with fault: 'missing' or
    'differs'. sample: only so many rows, the first by key."""
    asked = rows if sample is None else rows.orderBy(key).limit(sample)
    found = asked.join(files.select(F.col("path").alias("snapshot_path"), F.sha2("content", 256).alias("found_sha256")), "snapshot_path", "left")
    fault = F.when(F.col("found_sha256").isNull(), "missing").when(~F.col("snapshot_sha256").eqNullSafe(F.col("found_sha256")), "differs")
    return found.withColumn("fault", fault).where("fault is not null")


def require_tables(spark: SparkSession, paths: list[str]) -> None:
    """Fail unless a file or folder stands at each path."""
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
            raise GateError(f"missing {path}")


def enforce(checks: DataFrame) -> None:
    if failed := checks.where("not passed").select("table", "check", "detail").collect():  # one row a check
        raise GateError("; ".join(f"{r['table']}.{r['check']}: {r['detail']}" for r in failed))


def observed(df: DataFrame, name: str, **counts: Column) -> tuple[DataFrame, Observation]:
    """df, and what is known of it once an action has read it all: rows and further aggregates, without another pass."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("rows"), *[c.alias(k) for k, c in counts.items()]), seen
