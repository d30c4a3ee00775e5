"""Stored tables by key: upserts that write only the buckets they touch, views kept up to date, and pages that read only their files."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

from . import tables as M

BUCKETS = 256


@dataclass(frozen=True)
class KeyedTable:
    """Files partitioned by a hash of the key. A write replaces whole partitions, each in one step of the commit, and leaves the others'
    files as they are."""

    spark: SparkSession
    path: str
    keys: tuple[str, ...]
    schema: StructType
    buckets: int = BUCKETS

    def _bucketed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("_bucket", F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int"))

    def _write(self, rows: DataFrame) -> None:
        names = [f.name for f in self.schema]
        rows.select(*names, "_bucket").repartition("_bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_bucket").parquet(self.path)

    def read(self) -> DataFrame:
        return self._rows().drop("_bucket")

    def _rows(self) -> DataFrame:
        return self.spark.read.schema(StructType([*self.schema.fields]).add("_bucket", IntegerType())).parquet(self.path)

    def create(self, rows: DataFrame) -> None:
        self._write(self._bucketed(rows))

    def change(self, incoming: DataFrame, merged: Callable[[DataFrame, DataFrame], DataFrame]) -> int:
        """Rewrites the buckets of ``incoming``'s keys as ``merged(current rows of these, incoming)``. Returns how many there were: at most all."""
        rows = self._bucketed(incoming)
        touched = [r[0] for r in rows.select("_bucket").distinct().collect()]
        if touched:
            current = self._rows().where(F.col("_bucket").isin(touched))  # other partitions aren't listed
            self._write(self._bucketed(merged(current.drop("_bucket"), incoming)))
        return len(touched)

    def upsert(self, incoming: DataFrame, version: str) -> int:
        """Rows of ``incoming`` replace those of equal key; ties on ``version`` go to ``incoming``. Null keys are keys like others."""
        return self.change(incoming, lambda current, new: M.upsert(current, new, list(self.keys), version))

    def insert_absent(self, incoming: DataFrame) -> int:
        """Rows whose key is there, or came before in ``incoming``'s order of all columns, are ignored."""
        once = M.latest(incoming, list(self.keys), *[F.col(c).asc_nulls_first() for c in incoming.columns])
        return self.change(once, lambda current, new: M.insert_absent(current, new, list(self.keys)))


def create(rows: DataFrame, path: str, keys: list[str], buckets: int = BUCKETS) -> KeyedTable:
    table = KeyedTable(rows.sparkSession, path, tuple(keys), rows.schema, buckets)
    table.create(rows)
    return table


def check_width(rows: DataFrame, column: str, width: int) -> None:
    """Raises if a vector has another width, or is null."""
    wrong = rows.where(F.col(column).isNull() | (F.size(column) != width)).limit(1).count()
    if wrong:
        raise ValueError(f"{column} holds vectors of another width than {width}")


def maintain(table: KeyedTable, partial: DataFrame, batch: int, sums: list[str], most: list[str] = []) -> int:  # noqa: B006
    """Merges a batch's partial aggregates, a row a key, into a stored view with the columns keys, sums, most and batch.

    A key that has this batch already keeps its row, so a batch that comes again after a failure changes nothing.
    """
    keys = list(table.keys)

    def merged(current: DataFrame, new: DataFrame) -> DataFrame:
        done = current.where(F.col("batch") >= batch).select(*keys)
        fresh = new.join(done, keys, "left_anti").withColumn("batch", F.lit(batch).cast("long"))
        both = current.unionByName(fresh.select(*current.columns))
        return both.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums], *[F.max(c).alias(c) for c in most], F.max("batch").alias("batch"))

    return table.change(partial, merged)


# ---- clustered tables


def write_clustered(rows: DataFrame, path: str, order: list[str], files: int | None = None) -> None:
    """Rows sorted over all files by ``order``; path/files lists each file's first and last place and its rows."""
    dealt = rows.repartitionByRange(files, *order) if files else rows.repartitionByRange(*order)
    dealt.sortWithinPartitions(*order).write.mode("overwrite").parquet(f"{path}/rows")
    place = F.struct(*order)
    told = rows.sparkSession.read.schema(rows.schema).parquet(f"{path}/rows").select(F.col("_metadata.file_path").alias("file"), place.alias("p"))
    told.groupBy("file").agg(F.min("p").alias("first"), F.max("p").alias("last"), F.count(F.lit(1)).alias("n")).coalesce(1).write.mode("overwrite").parquet(f"{path}/files")


def files_of_page(spark: SparkSession, path: str, order: list[str], after: tuple | None, limit: int) -> list[str]:
    """The files, in order, that hold the ``limit`` rows after the place ``after``."""
    told = spark.read.parquet(f"{path}/files")
    if after is not None:
        told = told.where(F.col("last") > _place(told, after))
    inside = F.lit(False) if after is None else F.col("first") <= _place(told, after)  # of such a file only a part may count
    held, out = 0, []
    for r in told.select("file", "n", inside.alias("part")).orderBy("first").limit(limit + 1).collect():  # a file has a row at least
        out.append(r.file)
        held += 0 if r.part else r.n
        if held >= limit:
            break
    return out


def _place(told: DataFrame, after: tuple) -> Column:
    kinds = told.schema["last"].dataType
    return F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(after, kinds.fields)])


def page(spark: SparkSession, path: str, order: list[str], after: tuple | None, limit: int) -> DataFrame:
    """The next ``limit`` rows after ``after`` in order; nothing but their files is read. Order columns hold no nulls."""
    files = files_of_page(spark, path, order, after, limit)
    schema = spark.read.parquet(f"{path}/rows").schema
    if not files:
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(schema).parquet(*files)
    if after is not None:
        place = F.struct(*order)
        rows = rows.where(place > F.struct(*[F.lit(v).cast(schema[c].dataType).alias(c) for v, c in zip(after, order)]))
    return rows.orderBy(*order).limit(limit)
