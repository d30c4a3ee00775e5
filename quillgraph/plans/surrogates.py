"""Logical tables over the driver's parquet files, in DataFrame form and as SQL CTEs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import postings as P
from ..sources.io import scratch_path


def raw(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def documents(spark: SparkSession, d: str, labelled: bool = True) -> DataFrame:
    """``labelled``: with the status, which takes a join; the title is cut from the text before it."""
    title = F.nullif(F.trim(F.substring_index("text", "\n", 1)), F.lit(""))
    docs = raw(spark, d, "documents").select(
        "doc_id", F.concat(F.lit("D"), F.col("doc_id").cast("string")).alias("doc_number"), title.alias("title"), F.col("lang").alias("doc_type"), F.col("source").alias("issuing_body")
    )
    if not labelled:
        return docs
    status = F.when(F.col("quality") == 1, "active").when(F.col("quality") == 0, "expired").alias("status")
    return docs.join(raw(spark, d, "labels").select("doc_id", status), "doc_id", "left")


def chunks(spark: SparkSession, d: str) -> DataFrame:
    lines = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    rows = raw(spark, d, "documents").select("doc_id", F.posexplode(lines).alias("pos", "text"))
    order = F.col("pos") + 1
    return rows.select(
        F.concat(F.col("doc_id").cast("string"), F.lit("__"), F.lpad(order.cast("string"), 5, "0")).alias("chunk_uid"), "doc_id", order.cast("long").alias("chunk_order"), "text",
        T.token_count("text").alias("token_count"), F.when(order % 10 == 1, F.concat(F.lit("ch"), F.floor(order / 10).cast("string"))).alias("chapter"),
    )


def graph_documents(spark: SparkSession, d: str) -> DataFrame:
    """Documents of the anti-join queries; the others leave orphan chunks."""
    return documents(spark, d).where("doc_id % 19 <> 0")


def graph_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of the anti-join queries; the others leave documents without chunks."""
    return chunks(spark, d).where("doc_id % 17 <> 0")


def has_chunk(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d).select("doc_id").join(chunks(spark, d).select("doc_id", "chunk_uid"), "doc_id")


def links(spark: SparkSession, d: str) -> DataFrame:
    """Edges as they are stored, parallel ones included: enough to traverse."""
    kind = F.when(F.col("l_returnflag") == "A", "AMENDS").when(F.col("l_returnflag") == "N", "MENTIONS").otherwise("REFERS_TO")
    return raw(spark, d, "lineitem").select(
        F.concat(F.lit("O"), F.col("l_orderkey").cast("string")).alias("src"), F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("dst"), kind.alias("rel_type"), "l_linestatus"
    )


def edges(spark: SparkSession, d: str) -> DataFrame:
    """One edge a (src, rel_type, dst)."""
    return links(spark, d).groupBy("src", "rel_type", "dst").agg(F.max("l_linestatus").alias("relation_type")).withColumn("edge_id", F.xxhash64("src", "rel_type", "dst"))


def edge_nodes(spark: SparkSession, d: str) -> DataFrame:
    e = edges(spark, d)
    ids = e.select(F.col("src").alias("id")).union(e.select(F.col("dst").alias("id"))).distinct()
    return ids.select("id", F.concat(F.lit("Title "), F.col("id")).alias("title"), F.when(F.col("id").startswith("O"), "order").otherwise("part").alias("doc_type"))


def seeds(spark: SparkSession, d: str) -> DataFrame:
    """Every hundredth order; each is a question of its own."""
    rows = raw(spark, d, "orders").where("o_orderkey % 100 = 0").select(F.concat(F.lit("O"), F.col("o_orderkey").cast("string")).alias("id"))
    return rows.select(F.col("id").alias("query_id"), "id")


def questions(spark: SparkSession, d: str) -> DataFrame:
    """Every hundredth vector, with the first three words of the document of that id."""
    said = raw(spark, d, "documents").where("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), F.slice(F.array_distinct(T.words("text")), 1, 3).alias("terms"))
    asked = raw(spark, d, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    return asked.join(said, "query_id", "left")


def searched(spark: SparkSession, d: str) -> DataFrame:
    """Chunks with the text that the full-text index covers: their own and their document's number."""
    return with_search_text(chunks(spark, d))


def with_search_text(rows: DataFrame) -> DataFrame:
    return rows.withColumn("search_text", F.concat("text", F.lit(" D"), F.col("doc_id").cast("string")))


_built: dict[tuple[str, str, str], str] = {}


def built(spark: SparkSession, d: str, name: str, build: Callable[[str], None]) -> str:
    """Path of something stored over the tables in ``d``, written by ``build`` at its first use in the application."""
    key = spark.sparkContext.applicationId, d, name
    if key not in _built:
        build(path := scratch_path(spark, name))
        _built[key] = path
    return _built[key]


def fulltext(spark: SparkSession, d: str) -> str:
    """The stored postings of every chunk."""
    return built(spark, d, "fulltext", lambda path: P.build(searched(spark, d), path, "chunk_uid", "search_text", ("doc_id",)))


def gold(spark: SparkSession, d: str) -> DataFrame:
    """Chunks as they are searched; their own texts are stored, map only."""
    path = built(spark, d, "gold", lambda path: chunks(spark, d).write.option("compression", "zstd").parquet(path))
    return with_search_text(spark.read.parquet(path))


def first_vectors(spark: SparkSession, d: str) -> DataFrame:
    """A document's first chunk has the vector whose vec_id is the doc_id; the other chunks have none."""
    first = chunks(spark, d).where("chunk_order = 1").select("chunk_uid", "doc_id")
    return first.join(raw(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector")), "doc_id").where("vector is not null")


def chat_users(spark: SparkSession, d: str) -> DataFrame:
    u = raw(spark, d, "conversations").select((F.col("conv_id") % 50).alias("user_id")).distinct()
    return u.withColumn("email", F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit("@example.org")))


def chat_conversations(spark: SparkSession, d: str) -> DataFrame:
    c = raw(spark, d, "conversations").groupBy("conv_id").agg(F.max("turn").alias("updated_at"))
    return c.select("conv_id", (F.col("conv_id") % 50).alias("user_id"), F.when(F.col("conv_id") % 7 == 0, "archived").otherwise("active").alias("status"), "updated_at")


def chat_messages(spark: SparkSession, d: str) -> DataFrame:
    m = raw(spark, d, "conversations")
    return m.select("conv_id", "turn", "role", "text", (F.col("turn") * 100).alias("latency_ms"), ((F.col("turn") % 10) / F.lit(10.0)).alias("confidence"))


TOKEN = T.TOKEN
SQL = rf"""
doc AS (SELECT d.doc_id, 'D' || d.doc_id AS doc_number, nullif(trim(string_split(d.text, chr(10))[1]), '') AS title, d.lang AS doc_type, d.source AS issuing_body,
  CASE l.quality WHEN 1 THEN 'active' WHEN 0 THEN 'expired' END AS status FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
chk0 AS (SELECT doc_id, unnest(l) AS text, CAST(unnest(range(1, len(l) + 1)) AS BIGINT) AS chunk_order FROM (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS l FROM documents)),
chk AS (SELECT doc_id || '__' || lpad(CAST(chunk_order AS VARCHAR), 5, '0') AS chunk_uid, doc_id, chunk_order, text,
  CAST(len(regexp_extract_all(text, '{TOKEN}')) AS BIGINT) AS token_count, CASE WHEN chunk_order % 10 = 1 THEN 'ch' || CAST(chunk_order // 10 AS VARCHAR) END AS chapter FROM chk0),
odoc AS (SELECT * FROM doc WHERE doc_id % 19 <> 0), ochk AS (SELECT * FROM chk WHERE doc_id % 17 <> 0),
ohc AS (SELECT g.doc_id, c.chunk_uid FROM odoc g JOIN ochk c ON g.doc_id = c.doc_id),
hc AS (SELECT g.doc_id, c.chunk_uid FROM doc g JOIN chk c ON g.doc_id = c.doc_id),
edge AS (SELECT 'O' || l_orderkey AS src, CASE l_returnflag WHEN 'A' THEN 'AMENDS' WHEN 'N' THEN 'MENTIONS' ELSE 'REFERS_TO' END AS rel_type, 'P' || l_partkey AS dst, max(l_linestatus) AS relation_type
  FROM lineitem GROUP BY 1, 2, 3),
node AS (SELECT id, 'Title ' || id AS title, CASE WHEN id LIKE 'O%' THEN 'order' ELSE 'part' END AS doc_type FROM (SELECT src AS id FROM edge UNION SELECT dst FROM edge)),
seed AS (SELECT 'O' || o_orderkey AS id FROM orders WHERE o_orderkey % 100 = 0),
ktok AS (SELECT chunk_uid AS id, doc_id, regexp_extract_all(lower(text || ' D' || doc_id), '[\p{{L}}\p{{N}}_]+') AS w FROM chk),
ktf AS (SELECT id, doc_id, dl, term, count(*) AS tf FROM (SELECT id, doc_id, len(w) AS dl, unnest(w) AS term FROM ktok) GROUP BY ALL),
asks AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS qe, list_filter(w, lambda x, i: list_position(w, x) = i)[1:3] AS terms
  FROM embeddings LEFT JOIN (SELECT doc_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+') AS w FROM documents WHERE doc_id % 100 = 0) ON doc_id = vec_id WHERE vec_id % 100 = 0),
kbm AS (SELECT query_id, id, ktf.doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS score
  FROM (SELECT query_id, unnest(terms) AS term FROM asks) q JOIN ktf USING (term) JOIN (SELECT term, count(*) AS df FROM ktf GROUP BY term) USING (term), (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM ktok) GROUP BY ALL),
cvec AS (SELECT c.chunk_uid AS id, c.doc_id, CAST(embedding AS DOUBLE[]) AS e FROM chk c JOIN embeddings ON vec_id = c.doc_id WHERE c.chunk_order = 1),
usr AS (SELECT DISTINCT conv_id % 50 AS user_id, 'u' || (conv_id % 50) || '@example.org' AS email FROM conversations),
conv AS (SELECT conv_id, conv_id % 50 AS user_id, CASE WHEN conv_id % 7 = 0 THEN 'archived' ELSE 'active' END AS status, max(turn) AS updated_at FROM conversations GROUP BY conv_id),
msg AS (SELECT conv_id, turn, role, text, turn * 100 AS latency_ms, (turn % 10) / 10.0 AS confidence FROM conversations)
"""


def sql(body: str) -> str:
    """``body`` with the CTEs it names, and those they name, before it."""
    import re

    parts = re.split(r",?\n(?=\w+ AS \()|, (?=\w+ AS \()", SQL.strip())
    ctes = {p.split(" AS ", 1)[0]: p for p in parts}
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in ctes:
            if re.search(rf"\b{name}\b", text) and name not in needed:
                body_of = ctes[name].split(" AS ", 1)[1]
                visit(body_of)
                if name not in needed:
                    needed.append(name)

    visit(body)
    if not needed:
        return body
    rest = body.strip()
    head = ",\n".join(ctes[n] for n in needed)
    return f"WITH {head},\n{rest[5:]}" if rest.upper().startswith("WITH ") else f"WITH {head}\n{rest}"
