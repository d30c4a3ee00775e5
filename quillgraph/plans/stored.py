"""Queries over tables and views that are stored, kept up to date and searched: lookups, scans, streams and pages."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import chunker as K
from ..functions import intent as I
from ..operators import answer as A
from ..operators import keyed as KT
from ..operators import lookup as L
from ..operators import scan as SC
from ..sources import io as IO
from ..streaming import state as ST
from . import retrieval, streams
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


@register(
    "flt7_titles_by_name",
    "WITH nm AS (SELECT doc_id AS key, lower(substr(title, 2, 3 + doc_id % 7)) AS name FROM doc WHERE doc_id % 100 = 0) SELECT key, g.doc_id AS id FROM nm JOIN doc g ON contains(lower(g.title), name) WHERE name <> '' QUALIFY row_number() OVER (PARTITION BY key ORDER BY length(g.title), g.doc_id) = 1",
)
def flt7_names(s, d):
    """For a piece of every hundredth title, the shortest title that contains it."""
    docs = S.documents(s, d, labelled=False)
    names = docs.where("doc_id % 100 = 0").select(F.col("doc_id").alias("key"), F.substring(F.col("title"), F.lit(2), (3 + F.col("doc_id") % 7).cast("int")).alias("name"))
    return L.shortest(names, docs.select(F.col("doc_id").alias("id"), F.col("title").alias("text")))


@register("win5_budget_scan")
def win5_scan(s, d):
    """The budget without a window: a document may be larger than a task."""
    return SC.within_budget(S.chunks(s, d), "doc_id", "chunk_order", "text", 2400).select("chunk_uid", "cum")


@register("stm4_burst_scan")
def stm4_scan(s, d):
    """The limiter without a window: a user's requests may be more than a task holds."""
    rows = SC.bursts(S.raw(s, d, "events").select("user_id", "event_id", "ts"), "user_id", "ts", "event_id", 3600)
    return rows.select("event_id", "n", (F.col("n") <= 1).alias("allowed"))


@register("win6_span_scan")
def win6_scan(s, d):
    key = F.regexp_extract(F.lower("text"), r"\b(th[a-z]*)\b", 1)
    return SC.span(S.chunks(s, d), "doc_id", "chunk_order", key, "the").select("chunk_uid")


# ---- the chunker as a table function

_WHITE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(28) || chr(29) || chr(30) || chr(31) || chr(133) || chr(160)"
BOUNDS = rf"""
ln0 AS (SELECT doc_id, list_filter(list_transform(string_split(replace(coalesce(text, ''), chr(13), chr(10)), chr(10)), lambda x: trim(x, {_WHITE})), lambda x: x <> '') AS l FROM documents),
ln AS (SELECT doc_id, unnest(l) AS line, CAST(unnest(range(1, len(l) + 1)) AS BIGINT) AS i FROM ln0),
lt AS (SELECT doc_id, i, len(regexp_extract_all(line, '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_\s]')) AS n, right(line, 1) IN ('.', ';', ':') AS ends,
  regexp_matches(lower(strip_accents(line)), '^(chuong\s+([ivxlcdm]+|\d+)\b|muc\s+([ivxlcdm]+|\d+)\b|dieu\s+\d+[a-z]?\b|(khoan\s+)?\d+[.)]\s+|[a-z]\)\s+)') AS heads FROM ln),
st AS (
  SELECT doc_id, i, n, 1 AS chunk, CASE WHEN n >= 220 AND ends THEN 0 ELSE n END AS held FROM lt WHERE i = 1
  UNION ALL
  SELECT t.doc_id, t.i, t.n, s.chunk + CASE WHEN s.held = 0 OR t.heads OR s.held + t.n > 300 THEN 1 ELSE 0 END,
    CASE WHEN (CASE WHEN s.held = 0 OR t.heads OR s.held + t.n > 300 THEN 0 ELSE s.held END) + t.n >= 220 AND t.ends THEN 0 ELSE (CASE WHEN s.held = 0 OR t.heads OR s.held + t.n > 300 THEN 0 ELSE s.held END) + t.n END
  FROM st s JOIN lt t ON t.doc_id = s.doc_id AND t.i = s.i + 1)"""


def _chunks(s, d, overlap: int):
    K.register_chunker(s)
    S.raw(s, d, "documents").createOrReplaceTempView("_chunked_documents")
    return s.sql(f"SELECT d.doc_id AS number, c.* FROM _chunked_documents d, LATERAL chunk_document(CAST(d.doc_id AS STRING), '', '', d.text, 220, 300, {overlap}) c")


@register("udf1_chunk_boundaries", f"WITH RECURSIVE {BOUNDS} SELECT doc_id, CAST(chunk AS INTEGER) AS chunk_order, count(*) AS n_lines, CAST(sum(n) AS BIGINT) AS tokens FROM st GROUP BY doc_id, chunk")
def udf1_bounds(s, d):
    """Which lines of every document make a chunk, by the table function."""
    c = _chunks(s, d, 0)
    return c.select(F.col("number").alias("doc_id"), "chunk_order", F.size(F.split("chunk_text", "\n")).cast("long").alias("n_lines"), F.col("token_count").cast("long").alias("tokens"))


@register("win8_overlap", f"WITH RECURSIVE {BOUNDS} SELECT doc_id, CAST(max(chunk) AS BIGINT) AS chunks, CAST(max(chunk) - 1 AS BIGINT) AS prefixed FROM st GROUP BY doc_id")
def win8(s, d):
    """Each chunk but a document's first begins with the last thirty tokens of the one before, itself already prefixed."""
    tail = F.array_join(F.slice("tokens", F.greatest(F.size("tokens") - 29, F.lit(1)), F.lit(30)), " ")
    # The thirty tokens and the first line move, not texts; a document's first chunk has no line to compare.
    head = F.when(F.col("chunk_order") > 1, F.substring_index("chunk_text", "\n", 1))
    after = F.lead("head").over(Window.partitionBy("number").orderBy("chunk_order"))
    pairs = _chunks(s, d, 30).select("number", "chunk_order", tail.alias("tail"), head.alias("head")).withColumn("prefixed", after == F.col("tail"))
    return pairs.groupBy(F.col("number").alias("doc_id")).agg(F.count(F.lit(1)).alias("chunks"), F.count_if("prefixed").alias("prefixed"))


@register("udf2_chunker", "SELECT doc_id, chunk_order, 'dieu ' || doc_id AS article, CASE WHEN chunk_order > 1 THEN (chunk_order - 1) || '. ' END AS clause, CASE WHEN chunk_order = 1 THEN 1 ELSE 0 END AS n_references FROM documents, (SELECT CAST(unnest([1, 2, 3]) AS INTEGER) AS chunk_order)")
def udf2(s, d):
    """An article of two clauses for every document."""
    k = F.col("doc_id").cast("string")
    law = S.raw(s, d, "documents").select(k.alias("doc_id"), F.lit("n").alias("doc_number"), F.lit("t").alias("doc_title"), F.concat(F.lit("Điều "), k, F.lit(". Theo 45/2019/QH14\n1. "), "source", F.lit("\n2. "), "lang").alias("content_text"))
    return K.chunk_documents(law, overlap=0).select(F.col("doc_id").cast("long").alias("doc_id"), "chunk_order", "article", "clause", F.size("references_to").alias("n_references"))


@register("str8_headings", "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'article' WHEN 1 THEN 'clause' END AS level, CASE doc_id % 3 WHEN 0 THEN 'dieu ' || doc_id WHEN 1 THEN doc_id || '. ' END AS label FROM documents")
def str8(s, d):
    """The heading that is put before every document's title."""

    @F.pandas_udf("struct<level: string, label: string>")
    def of(lines: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([K.heading(x) or (None, None) for x in lines], columns=["level", "label"])

    k = F.col("doc_id").cast("string")
    head = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("Điều "), k)).when(F.col("doc_id") % 3 == 1, F.concat(k, F.lit("."))).otherwise(F.lit("=="))
    return S.raw(s, d, "documents").select("doc_id", of(F.concat(head, F.lit(" "), F.substring_index("text", "\n", 1))).alias("h")).select("doc_id", "h.level", "h.label")


@register("str3_folded_accents", "SELECT doc_id, strip_accents(title) AS folded FROM doc WHERE title IS NOT NULL")
def str3(s, d):
    @F.pandas_udf("string")
    def folded(titles: pd.Series) -> pd.Series:
        return titles.map(K.fold)

    return S.documents(s, d, labelled=False).where("title is not null").select("doc_id", folded("title").alias("folded"))


# ---- questions and answers


@register("ret8_intents", "SELECT conv_id, turn, CASE conv_id % 3 WHEN 0 THEN 'summarize_doc' WHEN 1 THEN 'explain_article' ELSE 'compare' END AS intent, CASE WHEN conv_id % 3 = 2 THEN 2 ELSE 1 END AS n FROM conversations WHERE role = 'user'")
def ret8(s, d):
    """Every user's turn as a question that names its subject."""
    k = (1 + F.col("conv_id") % 90).cast("string")
    q = F.when(F.col("conv_id") % 3 == 0, F.concat(F.lit("Tóm tắt Nghị định "), k, F.lit("/2013/NĐ-CP"))).when(F.col("conv_id") % 3 == 1, F.concat(F.lit("Giải thích chi tiết Điều "), k, F.lit(" Luật Thuế thu nhập cá nhân")))
    q = q.otherwise(F.concat(F.lit("So sánh Điều "), k, F.lit(" Luật Thuế thu nhập cá nhân và Điều 99 Luật Thuế giá trị gia tăng")))
    asked = S.raw(s, d, "conversations").where("role = 'user'").select("conv_id", "turn", q.alias("question"))
    return I.classify(asked).select("conv_id", "turn", "intent", F.size("references").alias("n"))


def _missing(prompt):
    raise RuntimeError("404 NOT_FOUND: no such model")


def _down(prompt):
    raise RuntimeError("503 down")


@register("ret11_answers", """SELECT conv_id, turn, case_name, CASE case_name WHEN 'second model' THEN 'Answer' WHEN 'error' THEN '503 down' || chr(10) || chr(10) || coalesce(text, '') ELSE coalesce(text, '') END AS answer,
case_name = 'error' AS failed FROM conversations, (SELECT unnest(['second model', 'error', 'no model']) AS case_name)""")
def ret11(s, d):
    """Every turn as context: the next model answers where one isn't found; other errors, or no model, lose nothing of what was found."""
    asked = S.raw(s, d, "conversations").select("conv_id", "turn", F.lit("q").alias("question"), F.col("text").alias("context"), F.lit("general_qa").alias("intent"))
    cases = {"second model": [_missing, lambda p: p[:6]], "error": [_missing, _down, lambda p: "never"], "no model": None}
    told = [A.synthesize(asked, models).select("conv_id", "turn", F.lit(name).alias("case_name"), "answer", "failed") for name, models in cases.items()]
    return told[0].unionByName(told[1]).unionByName(told[2])


@register("ret9_structured", "WITH c AS (SELECT doc_id, chunk_uid, sum(length(text)) OVER w AS cum, row_number() OVER w AS rn FROM chk WHERE doc_id % 100 = 0 WINDOW w AS (PARTITION BY doc_id ORDER BY chunk_order)) SELECT doc_id AS question_id, 'chunk' AS kind, chunk_uid AS item FROM c WHERE cum <= 24000 OR rn = 1")
def ret9(s, d):
    """A summary of every hundredth document asks for its chunks within the budget."""
    docs = S.documents(s, d, labelled=False)
    ref = F.array(F.struct(F.col("doc_number"), F.lit(None).cast("string").alias("doc_name"), F.lit(None).cast("string").alias("article")))
    asked = docs.where("doc_id % 100 = 0").select(F.col("doc_id").alias("question_id"), F.lit("summarize_doc").alias("intent"), ref.alias("references"))
    none = s.createDataFrame([], "src string, dst string, rel_type string")
    return A.structured(asked, docs, S.chunks(s, d).withColumn("article", F.lit(None).cast("string")), none).select("question_id", "kind", "item")


# ---- sinks and streams


@register("snk4_schema_and_truncate", "SELECT 1 AS place, 'written' AS step, count(*) AS n FROM documents UNION ALL SELECT 2, 'truncated', 0 UNION ALL SELECT 3, 'absent', -1")
def snk4(s, d):
    import uuid

    schema = f"qg_{uuid.uuid4().hex}"
    IO.create_schema(s, schema)
    IO.create_schema(s, schema)
    S.raw(s, d, "documents").write.format("parquet").saveAsTable(f"{schema}.t")
    rows = [(1, "written", s.table(f"{schema}.t").count())]
    IO.truncate(s, f"{schema}.t")
    rows += [(2, "truncated", s.table(f"{schema}.t").count()), (3, "absent", 0 if IO.truncate(s, f"{schema}.none") else -1)]
    s.sql(f"DROP SCHEMA {schema} CASCADE")
    return s.createDataFrame(rows, "place int, step string, n long")


@register("flt4_clustered_page", "SELECT doc_id, chunk_order, chunk_uid FROM chk WHERE doc_id > 40 OR (doc_id = 40 AND chunk_order > 2) ORDER BY doc_id, chunk_order LIMIT 100")
def flt4(s, d):
    """A page of a table that is clustered by its order: only the page's files are read."""

    def write(path: str) -> None:
        KT.write_clustered(S.chunks(s, d).select("doc_id", "chunk_order", "chunk_uid"), path, ["doc_id", "chunk_order"], 8)

    return KT.page(s, S.built(s, d, "clustered", write), ["doc_id", "chunk_order"], (40, 2), 100)


def _view(s, d):
    """Messages arrive in three batches; the view of conversations takes up each."""
    source, path = IO.scratch_path(s, "messages"), IO.scratch_path(s, "view")
    m = S.chat_messages(s, d).where("role = 'assistant'").select("conv_id", "turn", "latency_ms", F.col("confidence").cast("double").alias("confidence"))
    for i in range(3):
        m.where(f"turn % 3 = {i}").coalesce(1).write.mode("append").parquet(source)
    view = KT.create(s.createDataFrame([], "conv_id long, n long, confidence double, latency_ms long, last long, batch long"), path, ["conv_id"], 16)

    def take(batch, number):
        partial = batch.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.sum("confidence").alias("confidence"), F.sum("latency_ms").alias("latency_ms"), F.max("turn").alias("last"))
        KT.maintain(view, partial, number, ["n", "confidence", "latency_ms"], ["last"])

    IO.consume(IO.file_stream(s, source, "conv_id long, turn long, latency_ms long, confidence double", 1), IO.scratch_path(s, "checkpoint"), take)
    return view.read()


@register("view1_maintained", "SELECT u.user_id, count(DISTINCT c.conv_id) AS total_conversations, round(avg(m.confidence), 6) AS avg_confidence, round(avg(m.latency_ms), 4) AS avg_latency_ms, max(m.turn) AS last_activity FROM usr u LEFT JOIN conv c ON c.user_id = u.user_id AND c.status = 'active' LEFT JOIN msg m ON m.conv_id = c.conv_id AND m.role = 'assistant' GROUP BY 1")
def view1(s, d):
    """The users' statistics from a view that each batch of messages brings up to date."""
    convs = S.chat_conversations(s, d).where("status = 'active'").select("conv_id", "user_id").join(_view(s, d), "conv_id", "left")
    of = convs.groupBy("user_id").agg(F.count(F.lit(1)).alias("c"), *[F.sum(x).alias(x) for x in ("n", "confidence", "latency_ms")], F.max("last").alias("last_activity"))
    rows = S.chat_users(s, d).select("user_id").join(of, "user_id", "left")
    return rows.select("user_id", F.coalesce("c", F.lit(0)).cast("long").alias("total_conversations"), F.round(F.col("confidence") / F.col("n"), 6).alias("avg_confidence"), F.round(F.col("latency_ms") / F.col("n"), 4).alias("avg_latency_ms"), "last_activity")


@register("oltp1_maintained", "SELECT conv_id, count(*) AS n, max(turn) AS last_turn FROM msg WHERE role = 'assistant' GROUP BY conv_id")
def oltp1(s, d):
    return _view(s, d).select("conv_id", "n", F.col("last").alias("last_turn"))


@register("stm5_cache_stream")
def stm5(s, d):
    """A hit or a miss for every request of a stream of three batches, in order of time."""
    e = S.raw(s, d, "events").select(F.concat("event_type", (F.col("user_id") % 10).cast("string")).alias("key"), F.col("event_id").alias("request_id"), F.col("ts").cast("timestamp").alias("ts"))
    source, out = IO.scratch_path(s, "requests"), IO.scratch_path(s, "hits")
    day = F.dayofmonth("ts")
    for test in (day <= 10, (day > 10) & (day <= 20), day > 20):  # the events span a month
        e.where(test).coalesce(1).write.mode("append").parquet(source)
    with IO.settings(s, {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", "spark.sql.streaming.noDataMicroBatches.enabled": "false"}):
        told = ST.cache_stream(IO.file_stream(s, source, "key string, request_id long, ts timestamp", 1), 3600)
        told.writeStream.format("parquet").option("path", out).option("checkpointLocation", IO.scratch_path(s, "checkpoint")).trigger(availableNow=True).start().awaitTermination()
    return s.read.parquet(out)


# The rows of their twins.
ORACLES |= {"win5_budget_scan": retrieval.ORACLES["win5_char_budget"], "win6_span_scan": retrieval.ORACLES["win6_span_selection"], "stm5_cache_stream": streams.ORACLES["stm5_cache_hits"], "stm4_burst_scan": streams.ORACLES["stm4_rate_limit"]}
