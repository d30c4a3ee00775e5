"""The corpus pipeline: toxicity, exact duplicates, near duplicates, decontamination, packing.

In every stage a null text is an empty one, and texts are read whole however long. Rows that share a doc_id, or have none, are rows like
others. An empty table gives an empty one; extra columns are carried on to the last stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillgraph.llm import decontaminate, exact_dedup, packing, simhash, toxicity
from quillgraph.llm._common import scratch, ship, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go. The model learns from the labelled documents of the input. Equal texts share a verdict; an empty one has a score as well."""
    ship(spark)
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts stays: the longest, then of least doc_id (null first), then any one. Empty texts are one group."""
    ship(spark)
    return exact_dedup.drop_copies(docs)


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least id of each near-duplicate component stays; of rows that share that id, one. Texts without words have the same fingerprint, so they link."""
    ship(spark)
    return simhash.drop_near_copies(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with benchmark windows in a twentieth of their words or more go. A text without words stays, and so does all if the benchmark is empty."""
    ship(spark)
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left as pieces in sequences of 4096 tokens, with ``packing.pack``'s columns only. An empty text is its end token."""
    ship(spark)
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact),
    ("simhash", drop_near),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

#: No stage but exact deduplication can be said in SQL; tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage over ``documents``, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            path = scratch(spark, f"pipeline-{name}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
