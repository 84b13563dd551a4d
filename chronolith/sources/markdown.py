"""Column profiles as markdown tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolith.operators.quality import profile, shown


def dictionary(tables: dict[str, tuple[DataFrame, str]]) -> str:
    """A section for each table (with the column that orders its examples); one row a column reaches the driver."""
    parts = []
    for name, (df, order) in tables.items():
        rows = profile(df, order).withColumn("example_value", shown(F.col("example_value"))).collect()
        parts.append(f"## {name}\n\nRows: {df.count()}\nColumns: {len(df.columns)}\n\n| column | dtype | missing_count | missing_pct | example_value |\n|---|---|---:|---:|---|\n")
        parts += [f"| {r['column']} | {r['dtype']} | {r['missing_count']} | {r['missing_pct']} | {r['example_value']} |\n" for r in rows]
        parts.append("\n")
    return "# Data dictionary\n\n" + "".join(parts)
