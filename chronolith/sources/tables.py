"""Readers and writers. Schemas are always given: inference would read a month such as 2019-01 as a timestamp."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolith.functions.times import parsed

MANIFEST = "downloaded_at_utc string, pdf_url string, saved_path string, sha256 string, bytes bigint, http_status int, status string, error string"
INDEX_MANIFEST = "fetched_at_utc string, url string, path string, sha256 string, bytes bigint, content_type string"
ARTICLES = (
    "article_id string, source_id string, url string, title string, author string, text string, published_at string, published_raw string, fetched_at_utc string, text_sha256 string, "
    "simhash64 bigint, snapshot_path string, snapshot_sha256 string"
)
RELEASES = "period_year int, period_month int, total_sales_units bigint, extraction_method string, extraction_confidence string, warning_flag string, evidence_pattern string, evidence_window string, pdf_path string"
COUNTS = "period_year int, period_month int, ENTRY_EXIT bigint, LAUNCH_PRODUCT bigint, PRICE_ACTION bigint, RECALL_QUALITY bigint, CAPACITY_SUPPLY bigint, DEALER_NETWORK bigint, EV_POLICY_INFRA bigint"
PANEL = f"{COUNTS}, month_id string, total_sales_units double"


def parquet(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Empty cells are null; quotes are doubled; cells may hold line ends."""
    return spark.read.schema(schema).csv(path, header=True, multiLine=True, quote='"', escape='"', nullValue="")


def write_csv(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("overwrite").csv(path, header=True, quote='"', escape='"', nullValue="", emptyValue="")


def read_manifest(spark: SparkSession, path: str, schema: str = MANIFEST) -> DataFrame:
    """JSON lines; blank and broken ones are left out."""
    return spark.read.schema(schema).json(path, mode="DROPMALFORMED")


def append_manifest(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def succeeded(manifest: DataFrame) -> DataFrame:
    return manifest.where((F.col("status") == "success") & (F.length("saved_path") > 0))


def existing(records: DataFrame, files: DataFrame, path_col: str = "saved_path") -> DataFrame:
    """Records whose file is there (files: path)."""
    return records.join(files.select(F.col("path").alias(path_col)).distinct(), path_col, "left_semi")


def snapshot_files(spark: SparkSession, path: str) -> DataFrame:
    """path, content, sha256 and bytes of stored files."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return found.select("path", "content", F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes"))


def snapshots(pages: DataFrame, prefix: str, text_col: str, url_col: str, fetched_col: str, by_url: bool = False) -> DataFrame:
    """Records of text snapshots: path (by the second of fetching, or a hash of the whole URL), sha256, bytes, type."""
    when = F.date_format(parsed(F.col(fetched_col)), "yyyyMMdd_HHmmss")
    name = F.concat(F.lit(f"{prefix}_"), F.substring(F.sha2(F.col(url_col).cast("binary"), 256), 1, 16) if by_url else when, F.lit(".html"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    return pages.select(
        F.col(fetched_col).alias("fetched_at_utc"), F.col(url_col).alias("url"), name.alias("path"), F.sha2(text.cast("binary"), 256).alias("sha256"), F.octet_length(text).cast("bigint").alias("bytes"), F.lit("text/html").alias("content_type")
    )


def to_fetch(urls: DataFrame, stored: DataFrame, least_bytes: int = 500) -> DataFrame:
    """URLs without a usable snapshot."""
    return urls.join(stored.where(F.col("bytes") > least_bytes).select("url").distinct(), "url", "left_anti")


def listed_months(spark: SparkSession, path: str) -> DataFrame:
    """Months in a text file's list items."""
    return spark.read.text(path).select(F.regexp_extract("value", r"^- (\d{4}-\d{2})\s*$", 1).alias("month_id")).where("month_id <> ''")
