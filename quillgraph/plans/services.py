"""Queries of the operators around the tables: sources, sinks, queues, chunking, embedding and prompts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import chunker as K
from ..functions import embedding as EM
from ..functions import text as T
from ..operators import answer as A
from ..operators import etl as E
from ..operators import scan as SC
from ..sources import io as IO
from ..streaming import queue as Q
from . import surrogates as S

QUERIES: dict = {}
ORACLES: dict = {}


def register(name: str, oracle: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if oracle is not None:
            ORACLES[name] = S.sql(oracle)
        return f

    return keep


# ---- sources, sinks, settings


@register("src1_candidate_paths", "SELECT doc_id, lang FROM documents")
def src1(s, d):
    """The first of several names and splits that is there."""
    return IO.open_first(s, d, ["given", "content", "documents.parquet"], ["data", "train", ""]).select("doc_id", "lang")


def _streamed(s, d, table, columns, schema, per_trigger=None):
    """A table's rows through a file stream and a checkpoint, appended batch by batch."""
    into, source = IO.scratch_path(s, "consumed"), IO.scratch_path(s, "stream")
    S.raw(s, d, table).select(*columns).repartition(3).write.parquet(source)

    def handle(batch, number):
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{into}/batch_id={number}")  # a batch that comes again replaces itself

    IO.consume(IO.file_stream(s, source, schema, per_trigger), IO.scratch_path(s, "checkpoint"), handle)
    return s.read.parquet(into)


@register("src9_stream_consumer", "SELECT event_id, user_id FROM events")
def src9(s, d):
    return _streamed(s, d, "events", ["event_id", "user_id"], "event_id bigint, user_id bigint", 1).select("event_id", "user_id")


@register("stm2_at_least_once", "SELECT conv_id, turn, CAST(1 AS BIGINT) AS times FROM conversations")
def stm2(s, d):
    rows = _streamed(s, d, "conversations", ["conv_id", "turn"], "conv_id bigint, turn bigint")
    return rows.groupBy("conv_id", "turn").agg(F.count(F.lit(1)).alias("times"))


@register("stm1_published_requests", "SELECT CAST(conv_id AS VARCHAR) AS conversation_id, CAST(turn AS VARCHAR) AS user_message_id, text AS question, '5' AS top_k_vector, '5' AS top_k_graph, '{}' AS metadata, TRUE AS stamped FROM conversations WHERE role = 'user'")
def stm1(s, d):
    """Requests appended to the queue's table: every field a string, and a time."""
    path = IO.scratch_path(s, "requests")
    asked = S.raw(s, d, "conversations").where("role = 'user'")
    IO.append(Q.requests(asked.select(F.col("conv_id").alias("conversation_id"), F.col("turn").alias("user_message_id"), F.col("text").alias("question"))), path)
    return s.read.parquet(path).withColumn("stamped", F.col("timestamp").cast("double") > 0).drop("timestamp")


@register("snk18_results", "SELECT CAST(conv_id AS VARCHAR) AS conversation_id, CAST(turn AS VARCHAR) AS assistant_message_id, substr(text, 1, 500) AS answer, CAST(turn * 100 AS VARCHAR) AS latency_ms, '{}' AS metadata FROM conversations WHERE role = 'assistant'")
def snk18(s, d):
    """Results go into the queue with answers cut to 500 characters."""
    told = S.chat_messages(s, d).where("role = 'assistant'")
    path = IO.scratch_path(s, "results")
    IO.append(Q.results(told.select(F.col("conv_id").alias("conversation_id"), F.col("turn").alias("assistant_message_id"), F.col("text").alias("answer"), "latency_ms")), path)
    return s.read.parquet(path).drop("timestamp")


@register("snk18_analytics", "SELECT event_type, event_id, '{\"user_id\":' || user_id || '}' AS data FROM events ORDER BY event_id DESC LIMIT 10000")
def snk18_analytics(s, d):
    e = S.raw(s, d, "events").select("event_type", "event_id", F.struct("user_id").alias("data"))
    path = IO.scratch_path(s, "analytics")
    IO.append(Q.analytics(e, "event_id"), path)
    return s.read.parquet(path)


@register("snk11_ordered_sync", "SELECT 1 AS place, 'documents' AS name, count(*) AS n FROM doc UNION ALL SELECT 2, 'chunks', count(*) FROM chk UNION ALL SELECT 3, 'relations', count(*) FROM documents")
def snk11(s, d):
    from .relational import relations

    counts = IO.sync(S.documents(s, d), S.chunks(s, d), relations(s, d), IO.scratch_path(s, "sync"))
    return s.createDataFrame([(i + 1, k, n) for i, (k, n) in enumerate(counts.items())], "place int, name string, n long")


@register("snk19_csv", "SELECT item_id, text FROM benchmark")
def snk19(s, d):
    """Written with a byte order mark and read again."""
    path = IO.scratch_path(s, "csv")
    IO.csv_sink(S.raw(s, d, "benchmark").select("item_id", "text"), path)
    back = s.read.option("header", True).option("multiLine", True).csv(path)
    return back.select(F.col(back.columns[0]).cast("long").alias("item_id"), "text")


def _flushed(s, rows, order, size):
    """Rows in batches of ``size`` by ``order``, appended to a table a batch at a time and read back."""
    path = IO.scratch_path(s, "flushed")
    IO.append(SC.batches_of(rows, order, size), path)
    return s.read.parquet(path)


@register("snk12_batches", "SELECT batch, count(*) AS n, min(doc_id) AS first, max(doc_id) AS last FROM (SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // 256 AS batch FROM documents) GROUP BY batch")
def snk12(s, d):
    """Batches of 256 rows by id, whatever gaps the ids have."""
    rows = _flushed(s, S.raw(s, d, "documents").select("doc_id"), ["doc_id"], 256)
    return rows.groupBy("batch").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))


_FLUSHES = "SELECT '{}' AS kind, flush, count(*) AS n FROM (SELECT (row_number() OVER (ORDER BY {}) - 1) // {} AS flush FROM {}) GROUP BY flush"


@register("stm10_flush_thresholds", " UNION ALL ".join(_FLUSHES.format(*x) for x in (("documents", "doc_id", 200, "doc"), ("relations", "doc_id", 500, "documents"), ("chunks", "doc_id, chunk_order", 200, "chk"))))
def stm10(s, d):
    """Buffers of 200 documents, 500 relations and 200 chunks; what is left over is flushed at the end."""
    from .relational import relations

    kinds = (("documents", S.documents(s, d), ["doc_id"], 200), ("relations", relations(s, d), ["source_doc_id", "target_doc_number"], 500), ("chunks", S.chunks(s, d), ["doc_id", "chunk_order"], 200))
    flushes = [_flushed(s, rows.select(*order), order, size).groupBy(F.col("batch").alias("flush")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "flush", "n") for kind, rows, order, size in kinds]
    return flushes[0].unionByName(flushes[1]).unionByName(flushes[2])


@register("prj7_time_stamp", "SELECT doc_id, TRUE AS stamped FROM documents")
def prj7(s, d):
    rows = IO.stamp(S.raw(s, d, "documents").select("doc_id"))
    return rows.select("doc_id", (F.abs(F.unix_timestamp("transform_ts") - F.unix_timestamp(F.current_timestamp())) < 1).alias("stamped"))


# ---- joins by id where others rely on places


COUNTED = "length(coalesce(text, '')) AS characters, len(coalesce(text, '')) - len(replace(coalesce(text, ''), ' ', '')) AS spaces, len(coalesce(text, '')) - len(replace(coalesce(text, ''), chr(10), '')) AS breaks"


def _numbers():
    """The counting embedder's vector as columns."""
    return [F.col("embedding")[i].cast("long").alias(n) for i, n in enumerate(("characters", "spaces", "breaks"))]


@register("join16_rows_with_vectors", f"SELECT CAST(doc_id AS VARCHAR) AS chunk_uid, {COUNTED} FROM documents")
def join16(s, d):
    """Embedding inside the pass over the rows: a row and its vector can't part."""
    docs = S.raw(s, d, "documents").select(F.col("doc_id").cast("string").alias("chunk_uid"), F.col("text").alias("chunk_text"))
    return E.gold(docs, EM.counting_embedder()).select("chunk_uid", *_numbers())


@register("join19_samples_and_scores", "SELECT doc_id AS id, lang, quality FROM documents FULL JOIN labels USING (doc_id)")
def join19(s, d):
    samples = S.raw(s, d, "documents").select(F.col("doc_id").alias("id"), "lang")
    return E.with_scores(samples, S.raw(s, d, "labels").select(F.col("doc_id").alias("id"), "quality"))


@register("map1_hierarchy_path", "SELECT chunk_uid, map_extract(m, 'lang')[1] AS lang, map_extract(m, 'hierarchy_path')[1] AS path FROM (SELECT chunk_uid, MAP {'lang': 'x', 'hierarchy_path': '{\"chapter\":' || coalesce('\"' || chapter || '\"', 'null') || ',\"section\":null}'} AS m FROM chk)")
def map1(s, d):
    old = F.create_map(F.lit("lang"), F.lit("x"), F.lit("hierarchy_path"), F.lit("old"))
    path = E.hierarchy_path(old, {"chapter": F.col("chapter"), "section": F.lit(None).cast("string")})
    return S.chunks(s, d).select("chunk_uid", path.alias("m")).select("chunk_uid", F.col("m")["lang"].alias("lang"), F.col("m")["hierarchy_path"].alias("path"))


@register("jsn3_record_json", "SELECT doc_id, '{\"doc_id\":' || doc_id || ',\"lang\":\"' || lang || '\",\"n\":' || n_chars || '}' AS json FROM documents")
def jsn3(s, d):
    return S.raw(s, d, "documents").select("doc_id", F.to_json(F.struct("doc_id", "lang", F.col("n_chars").alias("n"))).alias("json"))


@register("udf1_chunk_documents", "SELECT doc_id, CAST(sum(CAST(len(regexp_extract_all(text, '[\\p{L}\\p{N}_]+|[^\\p{L}\\p{N}_\\s]')) AS BIGINT)) AS BIGINT) AS tokens FROM (SELECT CAST(doc_id AS VARCHAR) AS doc_id, unnest(['', text]) AS text FROM documents WHERE length(trim(text, ' ' || chr(10) || chr(9) || chr(13))) > 0) GROUP BY doc_id")
def udf1(s, d):
    """Every document through the chunker without overlap: no token is lost or doubled."""
    docs = S.raw(s, d, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), F.lit("").alias("doc_number"), F.lit("").alias("doc_title"), F.col("text").alias("content_text"))
    return K.chunk_documents(docs, overlap=0).groupBy("doc_id").agg(F.sum(T.token_count("chunk_text")).alias("tokens"))


@register("stm7_distinct_questions", f"SELECT conv_id, turn, {COUNTED} FROM conversations WHERE role = 'user' AND text IS NOT NULL")
def stm7(s, d):
    asked = S.raw(s, d, "conversations").where("role = 'user' and text is not null").select("conv_id", "turn", F.col("text").alias("question"))
    return E.embed_questions(asked, EM.counting_embedder()).select("conv_id", "turn", *_numbers())


QUERIES["udf4_embedding"], ORACLES["udf4_embedding"] = join16, ORACLES["join16_rows_with_vectors"]


@register("str26_prompts", "SELECT conv_id, turn, 'Answer the question from the numbered passages only and cite them.' || chr(10) || chr(10) || '[1] x' || chr(10) || chr(10) || 'Question: ' || text AS prompt FROM conversations WHERE role = 'user'")
def str26(s, d):
    asked = S.raw(s, d, "conversations").where("role = 'user'")
    return asked.select("conv_id", "turn", A.prompt(F.lit("general_qa"), F.lit("[1] x"), F.col("text")).alias("prompt"))
