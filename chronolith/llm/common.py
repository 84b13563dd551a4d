"""Helpers shared by the training-data operators: shared storage, row keys and table access."""

from __future__ import annotations

import atexit
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, suppress
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from chronolith.shipping import ship

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor and the driver can reach, as the cluster names it in spark.checkpoint.dir."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"file://{_own_folder()}"  # one process: nothing else reads it


@cache
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="chronolith-")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(_remove_written)
    _written.append((spark, path))
    return path


def _remove_written() -> None:
    for spark, path in _written:
        try:
            remove(spark, path)
        except Exception:  # noqa: BLE001  the session may be gone already
            return


def remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """Session settings (dots as double underscores) for the queries that run inside."""
    names = {k.replace("__", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def stored(df: DataFrame, name: str, rows_per_batch: int = 0, few: bool = False) -> DataFrame:
    """Write df as a table in the shared folder and read it back: cuts the lineage, survives lost executors. The step's
    shuffle files are removed once the table stands. rows_per_batch: of Arrow batches, where rows are large. few: the
    table is much smaller than the input; a few tasks a core write it, each from several partitions in turn."""
    spark = df.sparkSession
    df = df.coalesce(2 * spark.sparkContext.defaultParallelism) if few else df
    path = new_path(spark, name)
    own = {"spark__sql__classic__shuffleDependency__fileCleanup__enabled": "true"}
    if rows_per_batch:
        own["spark__sql__execution__arrow__maxRecordsPerBatch"] = str(rows_per_batch)
    with settings(spark, **own):
        df.write.parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found.stored_at = path
    return found


def done_with(*tables: DataFrame) -> None:
    """Remove stored tables that nothing reads any more."""
    for df in tables:
        remove(df.sparkSession, df.stored_at)
        if (df.sparkSession, df.stored_at) in _written:
            _written.remove((df.sparkSession, df.stored_at))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_arrow(df: DataFrame, function, schema: str | StructType) -> DataFrame:
    """mapInArrow, with this package sent to the workers; memory that a task's end leaves unused goes back."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from function(batches)
        release()

    return df.mapInArrow(run, schema)


def release() -> None:
    """Return what a worker does not use to the system: workers live on and would hold their largest task's memory."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # not on every system
        ctypes.CDLL(None).malloc_trim(0)


def fold(id_col: str | Column, parts: int) -> Column:
    """crc32 of the id's decimal text modulo parts; null where the id is null."""
    col = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.pmod(F.crc32(col.cast("string").cast("binary")), F.lit(parts))


def in_fold(id_col: str | Column, parts: int, held: int) -> Column:
    """Whether a row belongs to the held-out fold; a row without an id does not."""
    return F.coalesce(fold(id_col, parts) == held, F.lit(False))
