"""Lagged intensity and ordinary least squares with standard errors."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronolith.functions.times import number_of_month, year_of_month
from chronolith.operators.panel import intensity, numeric_columns

LEAST_ROWS = 12


def lagged(panel: DataFrame, sales: str = "total_sales_units") -> DataFrame:
    """month_id, y, events_t, events_t_minus_1, year and month_num. The lag is by rows, before rows without y go.

    One row a month: the window over the whole table stays small.
    """
    by_month = Window.orderBy("month_id")
    rows = panel.select("month_id", F.col(sales).try_cast("double").alias("y"), intensity(numeric_columns(panel)).alias("events_t"))
    rows = rows.withColumn("events_t_minus_1", F.lag("events_t").over(by_month))
    return rows.withColumn("year", year_of_month(F.col("month_id"))).withColumn("month_num", number_of_month(F.col("month_id")))


def complete(rows: DataFrame) -> DataFrame:
    return rows.na.drop(subset=["y", "events_t", "events_t_minus_1", "year", "month_num"])


def with_dummies(rows: DataFrame, column: str, prefix: str) -> tuple[DataFrame, list[str]]:
    """0/1 columns for the levels of a column but the first."""
    levels = sorted(r[0] for r in rows.select(column).distinct().collect())[1:]  # months or years: few
    names = [f"{prefix}{x}" for x in levels]
    return rows.select("*", *[(F.col(column) == x).cast("double").alias(n) for x, n in zip(levels, names, strict=True)]), names


def lag_model(panel: DataFrame) -> DataFrame:
    """variable, coef, std_err, t_value, n_obs and r2 of y on intensity, its lag, and month and year effects."""
    rows = complete(lagged(panel))
    rows, months = with_dummies(rows, "month_num", "month_")
    rows, years = with_dummies(rows, "year", "year_")
    names = ["events_t", "events_t_minus_1", *months, *years]
    n = rows.count()
    if n < LEAST_ROWS:
        raise ValueError(f"{n} complete months; at least {LEAST_ROWS} are needed")
    data = VectorAssembler(inputCols=names, outputCol="features").transform(rows).select("features", F.col("y").alias("label"))
    model = LinearRegression(solver="normal", regParam=0.0).fit(data)
    s = model.summary
    values = [("const", float(model.intercept), s.coefficientStandardErrors[-1], s.tValues[-1])]
    values += [(v, float(c), e, t) for v, c, e, t in zip(names, model.coefficients, s.coefficientStandardErrors, s.tValues, strict=False)]
    return panel.sparkSession.createDataFrame([(v, c, float(e), float(t), n, float(s.r2)) for v, c, e, t in values], "variable string, coef double, std_err double, t_value double, n_obs long, r2 double")


def moments(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Sums of products of all pairs of columns: the normal equations, in one pass."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    sums = rows.agg(*[F.sum(F.col(a) * F.col(b)).alias(f"{a}*{b}") for a, b in pairs])
    return sums.unpivot([], [f"{a}*{b}" for a, b in pairs], "product", "total")
