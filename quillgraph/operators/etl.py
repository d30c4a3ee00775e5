"""Raw records to documents, chunks, relations and embeddings, each table one lazy plan."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from ..functions import chunker as K
from ..functions import html as H
from ..functions import text as T
from . import tables as M

# Names under which source fields arrive.
FIELDS = {
    "doc_id": ("id", "doc_id", "document_id"),
    "doc_number": ("so_ky_hieu", "doc_number", "so_hieu"),
    "title": ("title", "ten_van_ban"),
    "doc_type": ("loai_van_ban", "doc_type"),
    "issuing_body": ("co_quan_ban_hanh", "issuing_body"),
    "issued_date": ("ngay_ban_hanh", "issued_date"),
    "status": ("tinh_trang_hieu_luc", "status"),
    "content_text": ("content_text", "content", "text", "body"),
    "content_html": ("content_html", "html"),
}


def read_json_rows(lines: DataFrame, schema: str, column: str = "json") -> DataFrame:
    """JSON text rows, or rows that hold ``{"documents": [...]}``, as columns; malformed rows go."""
    one, many = f"struct<{_ddl(schema)}>", f"struct<documents: array<struct<{_ddl(schema)}>>>"
    wrapped = F.from_json(column, many)["documents"]
    rows = F.coalesce(wrapped, F.array(F.from_json(column, one)))
    return lines.select(F.explode(rows).alias("r")).where("r is not null").select("r.*")


def _ddl(schema: str) -> str:
    return ", ".join(f"{n}: {t}" for n, t in (p.strip().split(" ", 1) for p in schema.split(",")))


def drop_equal_rows(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows distinct on ``keys``: grouped by a digest of unambiguous JSON, so wide texts aren't the sort key."""
    digest = F.sha2(F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}), 256)
    return rows.withColumn("_digest", digest).dropDuplicates(["_digest"]).drop("_digest")


def bronze(raw: DataFrame, keywords: list[str] | None = None, cap: int | None = None) -> DataFrame:
    """Records under any of the known field names -> one schema; blank is '', status defaults to active.

    A record without an id gets one from its number, title or content. ``keywords`` keeps documents
    that mention one in title, type or content; ``cap`` keeps that many by doc_id.
    """
    have = {c.lower(): c for c in raw.columns}
    pick = lambda field, default="": T.first_nonblank(*[F.col(have[n]).cast("string") for n in FIELDS[field] if n in have] or [F.lit(None).cast("string")], default=default)
    html = pick("content_html", None)
    content = F.coalesce(pick("content_text", None), H.html_to_text(html), F.lit(""))
    rows = raw.select(
        pick("doc_id", None).alias("doc_id"), pick("doc_number").alias("doc_number"), pick("title").alias("title"), pick("doc_type").alias("doc_type"), pick("issuing_body").alias("issuing_body"),
        pick("issued_date").alias("issued_date"), pick("status", "active").alias("status"), content.alias("content_text"), F.to_json(F.struct(*raw.columns)).alias("raw_record_json"),
    )
    rows = rows.withColumn("doc_id", F.coalesce("doc_id", T.generated_doc_id("doc_number", "title", F.substring(F.sha1("content_text"), 1, 8))))
    if keywords:
        rows = rows.where(T.contains_any(keywords, "title", "doc_type", "content_text"))
    return rows.orderBy("doc_id").limit(cap) if cap else rows


def with_auxiliary(content: DataFrame, metadata: DataFrame, order: str) -> DataFrame:
    """content(id, ...) filled from the last metadata row of its trimmed id; blank metadata ids go."""
    meta = M.latest(metadata.withColumn("id", F.trim("id")).where("id <> ''"), ["id"], F.col(order).desc()).drop(order)
    return M.fill_missing(content.withColumn("id", F.trim("id")), meta, "id")


def relation_lists(relationships: DataFrame, metadata: DataFrame, order: str) -> DataFrame:
    """relationships(doc_id, other_doc_id, relationship) -> doc_id, relations: targets by number, '' when unknown."""
    numbers = metadata.select(F.trim("id").alias("other_doc_id"), F.trim(F.coalesce("so_ky_hieu", F.lit(""))).alias("number")).dropDuplicates(["other_doc_id"])
    rows = relationships.withColumn("other_doc_id", F.trim("other_doc_id")).join(numbers, "other_doc_id", "left")
    item = F.struct(F.col(order).alias("o"), F.coalesce("number", F.lit("")).alias("target_so_ky_hieu"), F.col("other_doc_id").alias("target_doc_id"), F.col("relationship").alias("type"))
    grouped = rows.groupBy(F.trim("doc_id").alias("doc_id")).agg(F.array_sort(F.collect_list(item)).alias("r"))
    return grouped.select("doc_id", F.transform("r", lambda x: F.struct(x["target_so_ky_hieu"].alias("target_so_ky_hieu"), x["target_doc_id"].alias("target_doc_id"), x["type"].alias("type"))).alias("relations"))


def silver_documents(bronze_rows: DataFrame) -> DataFrame:
    keys = ["doc_id", "doc_number", "title", "content_text", "raw_record_json"]
    rows = drop_equal_rows(bronze_rows, keys)
    return rows.select(
        "doc_id", "doc_number", F.col("title").alias("doc_title"), "doc_type", "issuing_body", T.iso_date("issued_date").alias("issued_date"), F.coalesce("status", F.lit("active")).alias("status"), "content_text"
    )


def silver_chunks(documents: DataFrame, target: int = 220, limit: int = 300, overlap: int = 30, fold_d: bool = True, wide: bool = True) -> DataFrame:
    """Hierarchical chunks of each document, emitted as rows by one Arrow pass over the table."""
    return K.chunk_documents(documents, target, limit, overlap, fold_d, wide)


def silver_relations(chunks: DataFrame, explicit: DataFrame | None = None) -> DataFrame:
    """References found in chunks, with explicit relations: distinct on all five columns."""
    found = chunks.select(
        F.col("doc_id").alias("source_doc_id"), F.col("doc_number").alias("source_doc_number"), F.explode("references_to").alias("target_doc_number"), F.lit("MENTIONS").alias("relation_type"), F.lit("chunk_reference").alias("relation_source")
    )
    found = found.where(~T.is_blank("target_doc_number"))
    return (found.unionByName(explicit.select(*found.columns)) if explicit is not None else found).dropDuplicates()


def gold(chunks: DataFrame, embed: Callable[[list[str]], list[list[float]]], done: DataFrame | None = None, batch: int = 32, dim: int | None = None) -> DataFrame:
    """Chunks not embedded yet with their vectors, made on the executors in batches; row and vector never part."""
    todo = M.not_yet(chunks, done, "chunk_uid") if done is not None else chunks
    kept = [c for c in todo.columns if c not in ("tokens", "references_to")]
    schema = todo.select(*kept).schema.add("embedding", ArrayType(FloatType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in batches:
            for i in range(0, held.num_rows, batch):
                part = held.slice(i, batch)
                vectors = embed([t or "" for t in part.column("chunk_text").to_pylist()])
                if len(vectors) != part.num_rows or dim and any(len(v) != dim for v in vectors):
                    raise ValueError("the embedder returned other sizes than asked for")
                yield part.append_column("embedding", pa.array(vectors, pa.list_(pa.float32())))

    return todo.select(*kept).mapInArrow(run, schema)


def hierarchy_path(metadata: Column, parts: dict[str, Column]) -> Column:
    """metadata map<string,string> with the path of chapter, section, article, clause and point as JSON; the path wins."""
    path = F.to_json(F.struct(*[F.coalesce(c, F.lit(None).cast("string")).alias(n) for n, c in parts.items()]), {"ignoreNullFields": "false"})
    rest = F.map_filter(F.coalesce(metadata, F.create_map().cast("map<string,string>")), lambda k, v: k != "hierarchy_path")
    return F.map_concat(rest, F.create_map(F.lit("hierarchy_path"), path))


def embed_questions(questions: DataFrame, embed: Callable[[list[str]], list[list[float]]], text: str = "question", batch: int = 32) -> DataFrame:
    """Every row with the vector of its question; each distinct question is embedded once, however often it is asked."""
    distinct = questions.select(F.col(text).alias("_q")).where("_q is not null").distinct()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            texts = part["_q"].tolist()
            vectors = [v for i in range(0, len(texts), batch) for v in embed(texts[i : i + batch])]
            if len(vectors) != len(texts):
                raise ValueError(f"{len(texts)} questions gave {len(vectors)} vectors")
            yield part.assign(embedding=vectors)

    vectors = distinct.mapInPandas(run, "_q string, embedding array<float>")
    return questions.join(vectors, F.col(text) == F.col("_q"), "left").drop("_q")


def with_scores(samples: DataFrame, scores: DataFrame, key: str = "id") -> DataFrame:
    """Metadata of samples beside their scores, joined by id and not by place; either side may lack a row."""
    return samples.join(scores, key, "full")
