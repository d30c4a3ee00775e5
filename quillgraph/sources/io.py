"""Sources and sinks: candidate paths, JSON documents, file streams, CSV, keyed table writes."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path
from typing import TypeVar

from pyspark import SparkContext
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions import vector as V

T = TypeVar("T")


def open_first(spark: SparkSession, root: str, names: list[str], splits: list[str], fmt: str = "parquet") -> DataFrame:
    """The first of root/name/split that exists, names before splits; blank parts are skipped. Raises with all that were tried."""
    tried = []
    for name in dict.fromkeys(names):
        for split in dict.fromkeys(splits):
            path = "/".join(p for p in (root, name, split) if p)
            try:
                return spark.read.format(fmt).load(path)
            except AnalysisException:
                tried.append(path)
    raise FileNotFoundError(f"none of {tried}")


def json_documents(spark: SparkSession, path: str, limit: int | None = None, lines: bool = False, schema: str | None = None) -> DataFrame:
    """A JSON file that is a list of objects, or an object with a list under ``documents``; with ``lines`` a folder of one object a line,
    which is split over tasks. A schema given spares the pass that infers it."""
    reader = spark.read.option("multiLine", not lines)
    rows = (reader.schema(schema) if schema else reader).json(path)
    if "documents" in rows.columns:
        rows = rows.select(F.explode("documents").alias("d")).select("d.*")
    return rows.limit(limit) if limit else rows


def file_stream(spark: SparkSession, path: str, schema: str, per_trigger: int | None = None, fmt: str = "parquet") -> DataFrame:
    """New files of a folder as a stream; offsets live in the query's checkpoint, so each file is read once a group."""
    reader = spark.readStream.format(fmt).schema(schema)
    return (reader.option("maxFilesPerTrigger", per_trigger) if per_trigger else reader).load(path)


def consume(stream: DataFrame, checkpoint: str, handle: Callable[[DataFrame, int], None]) -> None:
    """Hands all new rows to ``handle``, batch by batch, and records what was done. A batch that fails comes again."""
    stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def append(rows: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    rows.write.mode("append").partitionBy(*(partition_by or [])).parquet(path)


def overwrite(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").parquet(path)


def recover(spark: SparkSession, table: str) -> bool:
    """Gives a table its old rows back if a swap was stopped while neither old nor new had its name. True if it did."""
    if spark.catalog.tableExists(table) or not spark.catalog.tableExists(f"{table}__old"):
        return False
    spark.sql(f"ALTER TABLE {table}__old RENAME TO {table}")
    return True


def swap_in(spark: SparkSession, rows: DataFrame, table: str) -> None:
    """Replaces a table that ``rows`` may read: written beside it first, then renamed. Where an earlier call was stopped between the two
    names, call ``recover`` before reading the table."""
    new, old = f"{table}__new", f"{table}__old"
    recover(spark, table)
    for name in (new, old):
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    rows.write.format("parquet").saveAsTable(new)
    if spark.catalog.tableExists(table):
        spark.sql(f"ALTER TABLE {table} RENAME TO {old}")
    spark.sql(f"ALTER TABLE {new} RENAME TO {table}")
    spark.sql(f"DROP TABLE IF EXISTS {old}")


def csv_sink(rows: DataFrame, path: str) -> None:
    """CSV with a header; each file starts with a byte order mark, so that spreadsheets read it as UTF-8."""
    first = rows.columns[0]
    rows.withColumnRenamed(first, "\ufeff" + first).write.mode("overwrite").option("header", True).option("encoding", "UTF-8").csv(path)


def create_schema(spark: SparkSession, name: str) -> None:
    spark.sql(f"CREATE SCHEMA IF NOT EXISTS {name}")


def truncate(spark: SparkSession, table: str) -> bool:
    """Empties a table; False where there is none."""
    if not spark.catalog.tableExists(table):
        return False
    spark.sql(f"TRUNCATE TABLE {table}")
    return True


def ensure_collection(spark: SparkSession, table: str, width: int, metric: str = "cosine") -> dict[str, str]:
    """A vector table with its width and metric among its properties, made if absent; an unknown metric is cosine. Returns the
    properties; one that is there with another width raises."""
    if not spark.catalog.tableExists(table):
        spark.sql(f"CREATE TABLE {table} (id STRING, vector ARRAY<DOUBLE>, payload STRING) USING parquet TBLPROPERTIES ('width' = '{int(width)}', 'metric' = '{V.name_of(metric)}')")
    found = {r.key: r.value for r in spark.sql(f"SHOW TBLPROPERTIES {table}").collect() if r.key in ("width", "metric")}
    if int(found["width"]) != width:
        raise ValueError(f"{table} holds vectors of width {found['width']}, not {width}")
    return found


def check_unique(rows: DataFrame, *keys: str) -> None:
    """Raises with a few keys that stand more than once; null keys don't count."""
    twice = rows.dropna(subset=list(keys)).groupBy(*keys).count().where("count > 1").limit(3).collect()
    if twice:
        raise ValueError(f"not unique by {', '.join(keys)}: {[tuple(r[k] for k in keys) for r in twice]}")


def sync(documents: DataFrame, chunks: DataFrame, relations: DataFrame, root: str) -> dict[str, int]:
    """Checks the keys, then writes documents, chunks and relations in this order. Returns the rows written, as the writes counted them."""
    check_unique(documents, "doc_id")
    check_unique(chunks, "chunk_uid")
    counts = {}
    for name, rows in (("documents", documents), ("chunks", chunks), ("relations", relations)):
        seen = Observation(name)
        rows.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{root}/{name}")
        counts[name] = seen.get["n"]
    return counts


def stamp(rows: DataFrame, column: str = "transform_ts") -> DataFrame:
    """The time of the query in every row."""
    return rows.withColumn(column, F.current_timestamp())


def keep_last(log: DataFrame, n: int, order: str) -> DataFrame:
    """The newest ``n`` rows of a log."""
    return log.orderBy(F.col(order).desc()).limit(n)


def flush_when(rows: Iterator[T], most: int, flush: Callable[[list[T]], None]) -> int:
    """Inside a partition: hands rows on in lists of ``most``, the rest at the end. Returns the rows handed on."""
    held: list[T] = []
    n = 0
    for row in rows:
        held.append(row)
        if len(held) >= most:
            flush(held)
            n += len(held)
            held = []
    if held:
        flush(held)
    return n + len(held)


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once a context, for clusters that don't have it installed."""
    context = spark.sparkContext
    if getattr(context, "_quillgraph_shipped", False):
        return
    top = Path(__file__).resolve().parent.parent
    folder = tempfile.mkdtemp()
    atexit.register(shutil.rmtree, folder, True)
    path = f"{folder}/{top.name}.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as archive:
        for file in sorted(top.rglob("*.py")):
            archive.write(file, file.relative_to(top.parent))
    context.addPyFile(path)
    context._quillgraph_shipped = True


def stored(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` written to the shared folder and read again: computed once, and lost executors cost nothing but a read."""
    path = scratch_path(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """The session's settings for a while; they are as before afterwards."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


_made: list[str] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the cluster's shared folder (``spark.checkpoint.dir``), removed when the driver ends.

    Where that setting is absent a local master gets a folder of its own; on a cluster that raises, as
    executors would not find each other's files there.
    """
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not base:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = f"{tempfile.gettempdir()}/checkpoints/quillgraph"
    if not _made:
        atexit.register(_sweep)
    _made.append(path := f"{base}/{name}-{uuid.uuid4().hex}")
    return path


def _sweep() -> None:
    """Removes what ``scratch_path`` gave out, by each path's file system while the session lasts."""
    context = SparkContext._active_spark_context
    for path in _made:
        try:
            place = context._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(context._jsc.hadoopConfiguration()).delete(place, True)
        except Exception:  # the session is gone: a local folder can still be removed
            shutil.rmtree(path.removeprefix("file://"), ignore_errors=True)
