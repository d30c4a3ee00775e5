"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.io import scratch_path as scratch
from ..sources.io import ship as _ship

#: Stands for a null doc_id inside the operators, and orders first; results give null again. A true doc_id of
#: this one value would be taken for null.
NULL_ID = -(2**63)
#: Number of a row, for rows that share a doc_id or have none.
ROW = "_qg_row"
BATCHES, BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch", 2000
#: The setting that decides, with file sizes, how files are cut into tasks.
CUTS = "spark.sql.files.minPartitionNum"

def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers. Batches of texts on the way to them hold ``BATCH`` rows, unless the session says
    otherwise: whole texts are long."""
    if not spark.conf.get(BATCHES, None):
        spark.conf.set(BATCHES, str(BATCH))
    _ship(spark)


def stored(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """``df`` written to the shared folder and read again: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, name)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)  # an empty table has no file to infer it from


def numbered(df: DataFrame) -> DataFrame:
    """``df`` with ``ROW``, a number that is the row's own whenever the frame is read again.

    Numbers come from the place in the scan, which is the same each time only over files that are cut alike; any other plan is
    written to the shared folder first. Files are cut by the cores there are, so that losing an executor between two
    reads would shift numbers: the count is fixed for the session, unless it is set already.
    """
    spark = df.sparkSession
    if not spark.conf.get(CUTS, None):
        spark.conf.set(CUTS, str(spark.sparkContext.defaultParallelism))
    steps = set(re.findall(r"^[\s:+*|-]*(?:\(\d+\)\s*)?([A-Z]\w+)", df._jdf.queryExecution().sparkPlan().toString(), re.M))
    if "FileScan" not in steps or steps - {"FileScan", "Project", "Filter", "ColumnarToRow"}:
        df = stored(df, "rows")
    return df.withColumn(ROW, F.monotonically_increasing_id())


def without_rows(df: DataFrame, gone: DataFrame, rows: int = 1_000_000) -> DataFrame:
    """A numbered ``df`` less the numbers in ``gone``, and without numbers. Up to ``rows`` of them, 8 bytes each, are
    broadcast, so that texts don't move; more are joined by a shuffle."""
    gone = stored(gone.select(ROW), "gone")
    return df.join(F.broadcast(gone) if gone.count() <= rows else gone, ROW, "left_anti").drop(ROW)


def tidy() -> None:
    """Gives a Python worker's freed memory back to the system at a task's end: workers stay for later stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # no such call in this C library
        pass


def row_id(column: str = "doc_id") -> Column:
    return F.coalesce(F.col(column).cast("long"), F.lit(NULL_ID)).alias("doc_id")


def public_id(column: str) -> Column:
    return F.when(F.col(column) != NULL_ID, F.col(column)).alias(column)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def input_bytes(df: DataFrame) -> int:
    """Size of the scanned files as the optimiser estimates it; no job runs."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
