"""Streaming forms of the incremental steps: counts by day and keys seen once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def stream(spark: SparkSession, path: str, schema: str, files_at_once: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(path)


def day_counts(events: DataFrame, late: str | None = "1 day") -> DataFrame:
    """Events and their values by day and type; with a watermark when events is a stream."""
    rows = events.withWatermark("ts", late) if events.isStreaming and late else events
    day = F.window("ts", "1 day")
    counts = rows.groupBy(day.alias("day"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return counts.select(F.col("day.start").alias("day"), "event_type", "n", "total")


def seen_once(rows: DataFrame, key: str) -> DataFrame:
    """The first row of every key: of a download log, what has not been fetched before."""
    return rows.dropDuplicates([key])


def append_new(batch: DataFrame, target: str, key: str) -> None:
    """One micro-batch: rows whose key the target table lacks are added to it."""
    spark = batch.sparkSession
    known = spark.read.schema(batch.schema).parquet(target) if _exists(spark, target) else batch.limit(0)
    batch.dropDuplicates([key]).join(known.select(key), key, "left_anti").select(*batch.columns).write.mode("append").parquet(target)


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def run_once(df: DataFrame, name: str, checkpoint: str, mode: str = "complete") -> StreamingQuery:
    """All that is there now, into a table in memory, in as many batches as the source makes."""
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
