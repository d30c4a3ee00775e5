"""Keyed writes and deletes over plain tables: MERGE semantics without a table format."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(log: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """Append log -> the last row of each key by ``order`` (descending columns first)."""
    return log.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rn = 1").drop("_rn")


def upsert(current: DataFrame, incoming: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Rows of ``incoming`` replace those of equal key; ties on ``version`` go to ``incoming``."""
    both = current.withColumn("_new", F.lit(0)).unionByName(incoming.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    return latest(both, keys, F.col(version).desc_nulls_last(), F.col("_new").desc()).drop("_new")


def insert_absent(current: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """ON CONFLICT DO NOTHING."""
    return current.unionByName(incoming.join(current.select(*keys), keys, "left_anti"), allowMissingColumns=True)


def not_yet(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows still to do: resume and incremental runs."""
    return rows.join(done.select(key).distinct(), key, "left_anti")


def fill_missing(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Left join that fills NULLs of ``left`` from ``right`` and adds its other columns; '' isn't missing."""
    other = [c for c in right.columns if c != key]
    joined = left.join(right.select(key, *[F.col(c).alias(f"_r_{c}") for c in other]), key, "left")
    cols = [F.coalesce(F.col(c), F.col(f"_r_{c}")).alias(c) if c in other else F.col(c) for c in left.columns]
    return joined.select(*cols, *[F.col(f"_r_{c}").alias(c) for c in other if c not in left.columns])


def cascade_delete(children: DataFrame, deleted: DataFrame, foreign_key: str) -> DataFrame:
    """Children whose parent isn't among the deleted keys (NULL parents stay)."""
    return children.join(deleted.select(F.col(deleted.columns[0]).alias(foreign_key)), foreign_key, "left_anti")


def page(rows: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    return rows.orderBy(*order).offset(offset).limit(limit)


def keyset_page(rows: DataFrame, a: str, b: str, after: tuple, limit: int) -> DataFrame:
    """The next rows after the pair ``after`` in (a, b) order."""
    return rows.where((F.col(a) > after[0]) | ((F.col(a) == after[0]) & (F.col(b) > after[1]))).orderBy(a, b).limit(limit)
