"""Scans, projections, filters, joins, aggregates, windows, ordering, set operations and keyed writes."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import etl as E
from ..operators import graph as G
from ..operators import keyed as KT
from ..operators import tables as M
from ..sources import io as IO
from . import surrogates as S
from .dashboards import CHUNK_BUCKETS, PER_DOC, bucket_sql, per_document

QUERIES: dict = {}
ORACLES: dict = {}


def register(name: str, oracle: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if oracle is not None:
            ORACLES[name] = S.sql(oracle)
        return f

    return keep


def rows_n():
    return F.count(F.lit(1)).alias("n")

# ---- scans and sources


@register("src2_row_iterator", "SELECT doc_id, lang, source, n_chars FROM documents")
def src2(s, d):
    return S.raw(s, d, "documents").select("doc_id", "lang", "source", "n_chars")


@register("src3_auxiliary_maps", "SELECT o_custkey, max(o_orderkey) AS last_order, CAST(count(*) AS BIGINT) AS n_rel, list(o_orderkey ORDER BY o_orderkey) AS rel FROM orders GROUP BY o_custkey")
def src3(s, d):
    """Last row of a key wins; relationships are gathered in arrival order."""
    o = S.raw(s, d, "orders").select("o_custkey", "o_orderkey")
    meta = M.latest(o, ["o_custkey"], F.col("o_orderkey").desc()).select("o_custkey", F.col("o_orderkey").alias("last_order"))
    rel = o.groupBy("o_custkey").agg(F.array_sort(F.collect_list("o_orderkey")).alias("rel"))
    return meta.join(rel, "o_custkey").select("o_custkey", "last_order", F.size("rel").cast("long").alias("n_rel"), "rel")


@register("src4_json_documents", "SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, role FROM conversations")
def src4(s, d):
    """Rows written as JSON files and read again through the document reader."""
    path = IO.scratch_path(s, "json")
    S.raw(s, d, "conversations").select("conv_id", "turn", "role").write.json(path)
    return IO.json_documents(s, path, lines=True, schema="conv_id bigint, turn bigint, role string")


@register("src7_table_scan", "SELECT count(*) AS n, sum(token_count) AS tokens FROM chk")
def src7(s, d):
    """A catalog table, made and scanned by name."""
    name = f"qg_chunks_{uuid.uuid4().hex}"
    S.chunks(s, d).select("chunk_uid", "token_count").write.format("parquet").option("path", IO.scratch_path(s, "table")).saveAsTable(name)
    try:
        row = s.table(name).agg(rows_n(), F.sum("token_count").alias("tokens")).first()
    finally:
        s.sql(f"DROP TABLE {name}")
    return s.createDataFrame([tuple(row)], "n long, tokens long")


@register("src8_literal_rows", "SELECT doc_id, name FROM documents LEFT JOIN (VALUES ('en', 'English'), ('fr', 'French'), ('de', NULL)) v(lang, name) USING (lang)")
def src8(s, d):
    """A table given as rows, beside a stored one."""
    names = s.createDataFrame([("en", "English"), ("fr", "French"), ("de", None)], "lang string, name string")
    return S.raw(s, d, "documents").join(F.broadcast(names), "lang", "left").select("doc_id", "name")


@register("src10_point_reads", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey = 7 OR o_custkey = 370")
def src10(s, d):
    return S.raw(s, d, "orders").where("o_orderkey = 7 or o_custkey = 370").select("o_orderkey", "o_custkey", "o_totalprice")


@register("src12_evaluation_set", "SELECT CAST(item_id AS VARCHAR) AS id, text AS question, 'c' || item_id % 7 AS category FROM benchmark")
def src12(s, d):
    """The evaluation set as JSON files, read back."""
    path = IO.scratch_path(s, "evaluation")
    rows = S.raw(s, d, "benchmark").select(F.col("item_id").cast("string").alias("id"), F.col("text").alias("question"), F.concat(F.lit("c"), (F.col("item_id") % 7).cast("string")).alias("category"))
    rows.write.json(path)
    return IO.json_documents(s, path, lines=True, schema="id string, question string, category string")


# ---- projections


@register("prj1_select_rename", "SELECT doc_id, title AS doc_title, doc_type, issuing_body FROM doc")
def prj1(s, d):
    return S.documents(s, d).select("doc_id", F.col("title").alias("doc_title"), "doc_type", "issuing_body")


@register("prj2_computed_columns", "SELECT doc_id, coalesce(status, 'active') AS status, length(coalesce(title, '')) AS title_chars FROM doc")
def prj2(s, d):
    return S.documents(s, d).select("doc_id", F.coalesce("status", F.lit("active")).alias("status"), F.length(F.coalesce("title", F.lit(""))).alias("title_chars"))


@register("prj3_literal_column", "SELECT src, dst, 'explicit_relation' AS relation_source FROM edge")
def prj3(s, d):
    return S.edges(s, d).select("src", "dst", F.lit("explicit_relation").alias("relation_source"))


@register("prj4_drop_columns", "SELECT doc_id, lang, n_chars FROM documents")
def prj4(s, d):
    return S.raw(s, d, "documents").drop("text", "source")


@register("prj5_struct_fields", "SELECT conv_id, turn, role FROM conversations")
def prj5(s, d):
    return S.raw(s, d, "conversations").select(F.struct("conv_id", "turn", "role").alias("chunk")).select("chunk.*")


@register("prj6_explode", "SELECT doc_id, CAST(i AS INTEGER) AS pos, line FROM (SELECT doc_id, unnest(range(0, len(l))) AS i, unnest(l) AS line FROM (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: x <> '') AS l FROM documents))")
def prj6(s, d):
    lines = F.filter(F.split("text", "\n"), lambda x: x != "")
    return S.raw(s, d, "documents").select("doc_id", F.posexplode(lines).alias("pos", "line"))


@register("prj8_field_priority", "SELECT doc_id, coalesce(nullif(trim(CASE WHEN doc_id % 4 = 0 THEN '' ELSE title END), ''), nullif(trim(CASE WHEN doc_id % 3 = 0 THEN ' ' ELSE doc_type END), ''), issuing_body) AS picked FROM doc")
def prj8(s, d):
    k = F.col("doc_id")
    return S.documents(s, d).select("doc_id", T.first_nonblank(F.when(k % 4 == 0, "").otherwise(F.col("title")), F.when(k % 3 == 0, " ").otherwise(F.col("doc_type")), "issuing_body").alias("picked"))


@register("prj9_prepared_documents", "SELECT doc_id, trim(title) AS content FROM doc WHERE doc_id % 5 <> 0 AND title IS NOT NULL")
def prj9(s, d):
    content = F.when(F.col("doc_id") % 5 == 0, "  ").otherwise(F.col("title"))
    return S.documents(s, d).select("doc_id", T.blank_to_null(content).alias("content")).where("content is not null")


@register("prj10_text_fallback", "SELECT page_id, CASE WHEN page_id % 2 = 0 THEN url ELSE array_to_string(list_filter(list_transform(string_split(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '[^\\S\\n]+', ' ', 'g'), chr(10)), lambda x: trim(x)), lambda x: x <> ''), chr(10)) END AS content FROM pages")
def prj10(s, d):
    first = F.when(F.col("page_id") % 2 == 0, F.col("url"))
    return S.raw(s, d, "pages").select("page_id", F.coalesce(T.blank_to_null(first), T.strip_tags("html")).alias("content"))


# ---- filters


@register("flt1_keyword_filter", "SELECT doc_id FROM doc WHERE lower(coalesce(title, '')) LIKE '%thion%' OR lower(coalesce(doc_type, '')) LIKE '%fr%' OR lower(coalesce(issuing_body, '')) LIKE '%src3%'")
def flt1(s, d):
    return S.documents(s, d).where(T.contains_any(["thion"], "title") | T.contains_any(["fr"], "doc_type") | T.contains_any(["src3"], "issuing_body")).select("doc_id")


@register("flt2_not_null", "SELECT doc_id, status FROM doc WHERE status IS NOT NULL")
def flt2(s, d):
    return S.documents(s, d).where(F.col("status").isNotNull()).select("doc_id", "status")


@register("flt3_blank_filter", "SELECT doc_id FROM doc WHERE length(trim(coalesce(CASE WHEN doc_id % 3 = 0 THEN '  ' ELSE status END, ''))) > 0")
def flt3(s, d):
    x = F.when(F.col("doc_id") % 3 == 0, "  ").otherwise(F.col("status"))
    return S.documents(s, d).where(~T.is_blank(x)).select("doc_id")


@register("flt4_keyset_page", "SELECT doc_id, chunk_order, chunk_uid FROM chk WHERE doc_id > 40 OR (doc_id = 40 AND chunk_order > 2) ORDER BY doc_id, chunk_order LIMIT 100")
def flt4(s, d):
    return M.keyset_page(S.chunks(s, d).select("doc_id", "chunk_order", "chunk_uid"), "doc_id", "chunk_order", (40, 2), 100)


@register("flt8_type_filter", "SELECT c.chunk_uid FROM chk c JOIN doc g ON g.doc_id = c.doc_id WHERE g.doc_type = 'de'")
def flt8(s, d):
    return S.chunks(s, d).select("chunk_uid", "doc_id").join(S.documents(s, d).where("doc_type = 'de'").select("doc_id"), "doc_id").select("chunk_uid")


@register("flt9_null_tests", "SELECT doc_id FROM doc WHERE status IS NULL OR (title IS NOT NULL AND doc_type = 'es')")
def flt9(s, d):
    return S.documents(s, d).where("status is null or (title is not null and doc_type = 'es')").select("doc_id")


@register("flt10_pattern_absence", "SELECT doc_id FROM odoc g WHERE NOT EXISTS (SELECT 1 FROM ochk c WHERE c.doc_id = g.doc_id)")
def flt10(s, d):
    return S.graph_documents(s, d).select("doc_id").join(S.graph_chunks(s, d).select("doc_id"), "doc_id", "left_anti")


@register("flt11_having", "SELECT src, count(*) AS n FROM edge GROUP BY src HAVING count(*) >= 5")
def flt11(s, d):
    return S.edges(s, d).groupBy("src").agg(rows_n()).where("n >= 5")


@register("flt12_active_only", "SELECT conv_id FROM conv WHERE status = 'active'")
def flt12(s, d):
    return S.chat_conversations(s, d).where("status = 'active'").select("conv_id")


@register("flt13_ownership", "SELECT conv_id FROM conv WHERE user_id = 3")
def flt13(s, d):
    return S.chat_conversations(s, d).where("user_id = 3").select("conv_id")


# ---- joins


@register("join1_fill_join", "SELECT d.doc_id, coalesce(CASE WHEN d.doc_id % 2 = 0 THEN d.lang END, CAST(l.quality AS VARCHAR)) AS lang, CAST(l.toxic AS BIGINT) AS toxic FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def join1(s, d):
    left = S.raw(s, d, "documents").select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.col("lang")).alias("lang"))
    right = S.raw(s, d, "labels").select("doc_id", F.col("quality").cast("string").alias("lang"), F.col("toxic").cast("long").alias("toxic"))
    return M.fill_missing(left, right, "doc_id")


@register("join2_nested_relations", "SELECT c_custkey, CAST(coalesce(len(r), 0) AS BIGINT) AS n, r AS orders FROM customer LEFT JOIN (SELECT o_custkey, list(o_orderkey ORDER BY o_orderkey) AS r FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def join2(s, d):
    r = S.raw(s, d, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list("o_orderkey")).alias("orders"))
    c = S.raw(s, d, "customer").select("c_custkey")
    return c.join(r, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce(F.size("orders"), F.lit(0)).cast("long").alias("n"), "orders")


@register("join3_self_lookup", "SELECT a.doc_id, coalesce(trim(b.doc_number), '') AS other_number FROM doc a LEFT JOIN doc b ON b.doc_id = a.doc_id * 3")
def join3(s, d):
    a, b = S.documents(s, d).select("doc_id"), S.documents(s, d).select(F.col("doc_id").alias("other"), "doc_number")
    return a.join(b, F.col("other") == F.col("doc_id") * 3, "left").select("doc_id", F.coalesce(F.trim("doc_number"), F.lit("")).alias("other_number"))


@register("join4_left_anti", "SELECT chunk_uid FROM chk WHERE doc_id % 3 <> 0")
def join4(s, d):
    c = S.chunks(s, d).select("chunk_uid", "doc_id")
    return M.not_yet(c, c.where("doc_id % 3 = 0"), "chunk_uid").select("chunk_uid")


QUERIES["stm8_incremental_rows"], ORACLES["stm8_incremental_rows"] = join4, ORACLES["join4_left_anti"]


@register("join5_has_chunk", "SELECT doc_id, chunk_uid FROM hc")
def join5(s, d):
    return S.has_chunk(s, d)


@register("join6_optional_match", f"SELECT doc_id, CAST(n_chunks AS BIGINT) AS n FROM {PER_DOC}")
def join6(s, d):
    return per_document(s, d).select("doc_id", F.col("n_chunks").alias("n"))


@register("join7_absent_pattern", "SELECT chunk_uid FROM ochk c WHERE NOT EXISTS (SELECT 1 FROM odoc g WHERE g.doc_id = c.doc_id)")
def join7(s, d):
    return S.graph_chunks(s, d).select("chunk_uid", "doc_id").join(S.graph_documents(s, d).select("doc_id"), "doc_id", "left_anti").select("chunk_uid")


RELATIONS = "rel AS (SELECT doc_id AS source_doc_id, CASE WHEN doc_id % 4 = 0 THEN 'X' ELSE 'D' END || (doc_id * 2) AS target_doc_number, CASE doc_id % 3 WHEN 0 THEN ' ' WHEN 1 THEN 'amends by' ELSE ' cites ' END AS relation_type FROM doc)"


def relations(s, d):
    k = F.col("doc_id")
    number = F.concat(F.when(k % 4 == 0, "X").otherwise("D"), (k * 2).cast("string"))
    kind = F.when(k % 3 == 0, " ").when(k % 3 == 1, "amends by").otherwise(" cites ")
    return S.documents(s, d).select(k.alias("source_doc_id"), number.alias("target_doc_number"), kind.alias("relation_type"), F.lit("explicit").alias("relation_source"))


EDGES_SQL = f"WITH {RELATIONS} SELECT r.source_doc_id AS src, g.doc_id AS dst_doc_id, r.target_doc_number AS dst, coalesce(nullif(replace(upper(trim(r.relation_type)), ' ', '_'), ''), 'REFERS_TO') AS rel_type FROM rel r LEFT JOIN doc g ON g.doc_number = r.target_doc_number"


@register("join10_target_by_number", EDGES_SQL)
def join10(s, d):
    return G.merge_edges(relations(s, d), S.documents(s, d)).select("src", "dst_doc_id", "dst", "rel_type")


QUERIES["snk10_upsert_relations"], ORACLES["snk10_upsert_relations"] = join10, ORACLES["join10_target_by_number"]


@register("join11_both_endpoints", "SELECT a.doc_type AS src_type, b.doc_type AS dst_type, count(*) AS n FROM edge JOIN node a ON a.id = src JOIN node b ON b.id = dst GROUP BY ALL")
def join11(s, d):
    n = S.edge_nodes(s, d)
    rows = S.edges(s, d).join(n.select(F.col("id").alias("src"), F.col("doc_type").alias("src_type")), "src").join(n.select(F.col("id").alias("dst"), F.col("doc_type").alias("dst_type")), "dst")
    return rows.groupBy("src_type", "dst_type").agg(rows_n())


@register("join12_seed_list", "SELECT e.src, e.dst FROM edge e JOIN seed ON seed.id = e.src")
def join12(s, d):
    return S.edges(s, d).join(S.seeds(s, d), F.col("src") == F.col("id")).select("src", "dst")


@register("join13_conversations_messages", "SELECT c.conv_id, count(m.turn) AS n, max(m.turn) AS last_turn FROM conv c LEFT JOIN msg m ON m.conv_id = c.conv_id AND m.role = 'assistant' GROUP BY 1")
def join13(s, d):
    m = S.chat_messages(s, d).where("role = 'assistant'").groupBy("conv_id").agg(rows_n(), F.max("turn").alias("last_turn"))
    return S.chat_conversations(s, d).select("conv_id").join(m, "conv_id", "left").fillna(0, ["n"])


@register("join20_cascade_delete", "SELECT conv_id, turn FROM msg WHERE conv_id NOT IN (SELECT conv_id FROM conv WHERE status = 'archived')")
def join20(s, d):
    gone = S.chat_conversations(s, d).where("status = 'archived'").select("conv_id")
    return M.cascade_delete(S.chat_messages(s, d).select("conv_id", "turn"), gone, "conv_id")


QUERIES["snk17_delete_cascade"], ORACLES["snk17_delete_cascade"] = join20, ORACLES["join20_cascade_delete"]

# ---- aggregates


@register("agg1_document_dedup", "SELECT DISTINCT lang, source, text FROM documents")
def agg1(s, d):
    """Equal on every column, NULL equal to NULL; the shuffle carries a digest with the row."""
    return E.drop_equal_rows(S.raw(s, d, "documents").select("lang", "source", "text"), ["lang", "source", "text"])


@register("agg2_relation_dedup", "SELECT DISTINCT l_orderkey, l_returnflag, l_linestatus FROM lineitem")
def agg2(s, d):
    return S.raw(s, d, "lineitem").select("l_orderkey", "l_returnflag", "l_linestatus").dropDuplicates()


@register("agg3_first_wins", "SELECT l_orderkey, l_returnflag, min(l_linenumber) AS first_line FROM lineitem GROUP BY 1, 2")
def agg3(s, d):
    rows = S.raw(s, d, "lineitem").select("l_orderkey", "l_returnflag", F.col("l_linenumber").alias("first_line"))
    return M.latest(rows, ["l_orderkey", "l_returnflag"], F.col("first_line").asc())


@register("agg4_stage_counts", "SELECT 'documents' AS stage, count(*) AS n FROM doc UNION ALL SELECT 'chunks', count(*) FROM chk UNION ALL SELECT 'relations', count(*) FROM edge")
def agg4(s, d):
    stages = {"documents": S.documents(s, d), "chunks": S.chunks(s, d), "relations": S.edges(s, d)}
    out = None
    for name, df in stages.items():
        part = df.agg(rows_n()).select(F.lit(name).alias("stage"), "n")
        out = part if out is None else out.unionAll(part)
    return out


@register("agg5_distinct_references", "SELECT src, list_sort(list_distinct(list(rel_type))) AS types FROM edge GROUP BY src")
def agg5(s, d):
    return S.edges(s, d).groupBy("src").agg(F.array_sort(F.collect_set("rel_type")).alias("types"))


@register("agg6_basic_aggregates", "SELECT doc_id, count(*) AS n, count(chapter) AS chapters, count(DISTINCT token_count) AS sizes, max(token_count) AS mx, min(token_count) AS mn, round(avg(token_count), 4) AS av, CAST(sum(token_count) AS BIGINT) AS total FROM chk GROUP BY doc_id")
def agg6(s, d):
    t = F.col("token_count")
    return S.chunks(s, d).groupBy("doc_id").agg(rows_n(), F.count("chapter").alias("chapters"), F.countDistinct(t).alias("sizes"), F.max(t).alias("mx"), F.min(t).alias("mn"), F.round(F.avg(t), 4).alias("av"), F.sum(t).alias("total"))


@register("agg7_conditional_aggregate", "SELECT conv_id, count(*) FILTER (WHERE role = 'user') AS questions, count(CASE WHEN role = 'assistant' THEN 1 END) AS answers FROM msg GROUP BY 1")
def agg7(s, d):
    return S.chat_messages(s, d).groupBy("conv_id").agg(F.count_if(F.col("role") == "user").alias("questions"), F.count(F.when(F.col("role") == "assistant", 1)).alias("answers"))


@register("agg9_value_grouping", "SELECT coalesce(title, CAST(doc_id AS VARCHAR)) AS shown, count(*) AS n FROM doc GROUP BY 1")
def agg9(s, d):
    return S.documents(s, d).groupBy(F.coalesce("title", F.col("doc_id").cast("string")).alias("shown")).agg(rows_n())


@register("agg12_scalar_subqueries", "SELECT (SELECT count(*) FROM usr) AS users, (SELECT count(*) FROM conv WHERE status = 'active') AS active, (SELECT count(*) FROM msg) AS messages")
def agg12(s, d):
    one = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    return one(S.chat_users(s, d), "users").crossJoin(one(S.chat_conversations(s, d).where("status = 'active'"), "active")).crossJoin(one(S.chat_messages(s, d), "messages"))


@register("agg13_metric_means", "SELECT lang, round(avg(m1), 6) AS m1, round(avg(m2), 6) AS m2, round((avg(m1) + avg(m2)) / 2, 6) AS overall FROM (SELECT lang, n_chars / 1000.0 AS m1, CAST(doc_id % 7 AS DOUBLE) AS m2 FROM documents) GROUP BY lang")
def agg13(s, d):
    rows = S.raw(s, d, "documents").select("lang", (F.col("n_chars") / 1000.0).alias("m1"), (F.col("doc_id") % 7).cast("double").alias("m2"))
    return rows.groupBy("lang").agg(F.round(F.avg("m1"), 6).alias("m1"), F.round(F.avg("m2"), 6).alias("m2"), F.round((F.avg("m1") + F.avg("m2")) / 2, 6).alias("overall"))


@register("agg14_bucket_histogram", f"SELECT bucket, count(*) AS n FROM (SELECT {bucket_sql('turn', CHUNK_BUCKETS, '100+')} FROM conversations) GROUP BY 1")
def agg14(s, d):
    label, _ = T.bucket("turn", CHUNK_BUCKETS, "100+")
    return S.raw(s, d, "conversations").groupBy(label.alias("bucket")).agg(rows_n())


@register("agg15_coverage_unpivot", "SELECT 'toxic' AS property, round(count(toxic) * 100.0 / count(*), 1) AS pct FROM labels UNION ALL SELECT 'quality', round(count(nullif(quality, 0)) * 100.0 / count(*), 1) FROM labels")
def agg15(s, d):
    pct = lambda c: F.round(F.count(c).cast("double") * 100.0 / F.count(F.lit(1)), 1)
    return S.raw(s, d, "labels").agg(pct("toxic").alias("toxic"), pct(F.nullif("quality", F.lit(0))).alias("quality")).unpivot([], ["toxic", "quality"], "property", "pct")


# ---- windows


@register("win7_chunk_numbers", "SELECT chunk_uid, chunk_order, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY chunk_order) AS BIGINT) AS again FROM chk")
def win7(s, d):
    w = Window.partitionBy("doc_id").orderBy("chunk_order")
    return S.chunks(s, d).select("chunk_uid", "chunk_order", F.row_number().over(w).cast("long").alias("again"))


@register("win11_age_buckets", "SELECT event_id, CASE WHEN user_id = 1 THEN 'pinned' WHEN d = 0 THEN 'today' WHEN d = 1 THEN 'yesterday' WHEN d <= 7 THEN 'last_week' ELSE 'older' END AS bucket FROM (SELECT event_id, user_id, date_diff('day', CAST(ts AS DATE), DATE '2024-01-30') AS d FROM events)")
def win11(s, d):
    age = F.datediff(F.lit("2024-01-30").cast("date"), F.col("ts").cast("date"))
    name = F.when(F.col("user_id") == 1, "pinned").when(age == 0, "today").when(age == 1, "yesterday").when(age <= 7, "last_week").otherwise("older")
    return S.raw(s, d, "events").select("event_id", name.alias("bucket"))


# ---- ordering


@register("srt1_ordered_page", "SELECT doc_id, chunk_order FROM chk ORDER BY doc_id, chunk_order LIMIT 1000")
def srt1(s, d):
    return S.chunks(s, d).select("doc_id", "chunk_order").orderBy("doc_id", "chunk_order").limit(1000)


@register("srt7_limited_sample", "SELECT doc_id FROM doc ORDER BY doc_id LIMIT 25")
def srt7(s, d):
    return S.documents(s, d).select("doc_id").orderBy("doc_id").limit(25)


@register("srt8_limit_offset", "SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 40")
def srt8(s, d):
    return M.page(S.raw(s, d, "orders"), [F.col("o_totalprice").desc(), F.col("o_orderkey")], 20, 40).select("o_orderkey")


@register("srt9_oldest_messages", "SELECT conv_id, turn FROM msg WHERE conv_id = 5 ORDER BY turn LIMIT 3")
def srt9(s, d):
    return S.chat_messages(s, d).where("conv_id = 5").select("conv_id", "turn").orderBy("turn").limit(3)


@register("srt11_bucket_order", f"SELECT bucket, CAST(row_number() OVER (ORDER BY bucket_order) AS INTEGER) AS pos FROM (SELECT DISTINCT {bucket_sql('turn', CHUNK_BUCKETS, '100+')} FROM conversations)")
def srt11(s, d):
    label, order = T.bucket("turn", CHUNK_BUCKETS, "100+")
    rows = S.raw(s, d, "conversations").select(label.alias("bucket"), order.alias("o")).distinct()
    return rows.select("bucket", F.row_number().over(Window.orderBy("o")).alias("pos"))  # six rows


# ---- set operations


@register("set1_union_distinct", "SELECT src AS id FROM edge UNION SELECT dst FROM edge")
def set1(s, d):
    e = S.edges(s, d)
    return e.select(F.col("src").alias("id")).unionByName(e.select(F.col("dst").alias("id"))).distinct()


@register("set2_membership", "SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def set2(s, d):
    return S.raw(s, d, "documents").select("doc_id").join(S.raw(s, d, "labels").where("toxic = 1").select("doc_id"), "doc_id", "left_semi")


@register("set3_distinct", "SELECT DISTINCT rel_type, relation_type FROM edge")
def set3(s, d):
    return S.edges(s, d).select("rel_type", "relation_type").distinct()


@register("set4_literal_rows", "SELECT doc_id, property, position, value FROM (SELECT doc_id, 'title' AS property, 1 AS position, title AS value FROM doc UNION ALL SELECT doc_id, 'status', 2, status FROM doc)")
def set4(s, d):
    """Properties as rows."""
    rows = F.array(*[F.struct(F.lit(p).alias("property"), F.lit(i).alias("position"), F.col(p).alias("value")) for i, p in enumerate(("title", "status"), 1)])
    return S.documents(s, d).select("doc_id", F.inline(rows))


@register("set5_list_concat", "SELECT l, count(*) AS n FROM (SELECT 0 AS l FROM doc UNION ALL SELECT 1 FROM chk UNION ALL SELECT 2 FROM edge) GROUP BY l")
def set5(s, d):
    parts = [df.select(F.lit(i).alias("l")) for i, df in enumerate((S.documents(s, d), S.chunks(s, d), S.edges(s, d)))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("l").agg(rows_n())


# ---- keyed writes

LOG = "log AS (SELECT user_id, event_id % 20 AS item, 1 + event_id % 5 AS rating, event_id AS version FROM events WHERE event_type IN ('purchase', 'signup'))"


def _log(s, d):
    e = S.raw(s, d, "events").where("event_type in ('purchase', 'signup')")
    return e.select("user_id", (F.col("event_id") % 20).alias("item"), (1 + F.col("event_id") % 5).alias("rating"), F.col("event_id").alias("version"))


@register("snk1_append", "SELECT doc_id FROM documents WHERE doc_id < 100 UNION ALL SELECT doc_id FROM documents WHERE doc_id >= 100")
def snk1(s, d):
    """Two appends to one table, read back."""
    path = IO.scratch_path(s, "append")
    rows = S.raw(s, d, "documents").select("doc_id")
    IO.append(rows.where("doc_id < 100"), path)
    IO.append(rows.where("doc_id >= 100"), path)
    return s.read.schema(rows.schema).parquet(path)


@register("snk2_overwrite", "SELECT doc_id, coalesce(status, 'active') AS status FROM doc")
def snk2(s, d):
    """A table written, then replaced."""
    path = IO.scratch_path(s, "overwrite")
    docs = S.documents(s, d).select("doc_id", "status")
    IO.overwrite(docs, path)
    IO.overwrite(docs.select("doc_id", F.coalesce("status", F.lit("active")).alias("status")), path)
    return s.read.parquet(path)


@register("snk3_append_only_new", "SELECT chunk_uid, doc_id % 3 = 0 AS old FROM chk")
def snk3(s, d):
    """A table that a second run completes: only what it lacks is appended."""
    path, c = IO.scratch_path(s, "append"), S.chunks(s, d).select("chunk_uid", "doc_id")
    IO.append(c.where("doc_id % 3 = 0").select("chunk_uid", F.lit(True).alias("old")), path)
    IO.append(M.not_yet(c, s.read.parquet(path), "chunk_uid").select("chunk_uid", F.lit(False).alias("old")), path)
    return s.read.parquet(path)


def _kept(s, rows, *keys):
    """``rows`` as a stored table by key."""
    return KT.create(rows, IO.scratch_path(s, "keyed"), list(keys), 16)


@register("snk6_vector_upsert", "SELECT vec_id, CASE WHEN vec_id % 4 = 0 THEN 2 ELSE 1 END AS version, len(embedding) AS width FROM embeddings")
def snk6(s, d):
    """Vectors written under their points' ids, a quarter of them again; a vector of another width raises."""
    v = S.raw(s, d, "embeddings")
    KT.check_width(v, "embedding", 64)
    points = v.select(T.uuid5(F.col("vec_id").cast("string")).alias("point_id"), "vec_id", "embedding", F.lit(1).alias("version"))
    table = _kept(s, points, "point_id")
    table.upsert(points.where("vec_id % 4 = 0").withColumn("version", F.lit(2)), "version")
    return table.read().select("vec_id", "version", F.size("embedding").cast("long").alias("width"))


@register("snk8_upsert_documents", "SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'changed' ELSE doc_number END AS doc_number FROM doc")
def snk8(s, d):
    cur = S.documents(s, d).select("doc_id", "doc_number", F.lit(1).alias("v"))
    table = _kept(s, cur, "doc_id")
    table.upsert(cur.where("doc_id % 5 = 0").select("doc_id", F.lit("changed").alias("doc_number"), F.lit(1).alias("v")), "v")
    return table.read().drop("v")


@register("snk9_upsert_chunks", "SELECT chunk_uid, doc_id, CASE WHEN doc_id % 3 = 0 THEN text || '+' ELSE text END AS text FROM hc JOIN chk USING (chunk_uid, doc_id)")
def snk9(s, d):
    """Chunks of documents that are there; those of a third come again."""
    cur = S.chunks(s, d).join(S.documents(s, d).select("doc_id"), "doc_id", "left_semi").select("chunk_uid", "doc_id", "text", F.lit(1).alias("v"))
    table = _kept(s, cur, "chunk_uid")
    table.upsert(cur.where("doc_id % 3 = 0").withColumn("text", F.concat("text", F.lit("+"))), "v")
    return table.read().drop("v")


@register("snk13_append_messages", "SELECT conv_id, turn, role FROM msg UNION ALL SELECT conv_id, max(turn) + 1, 'user' FROM msg GROUP BY conv_id")
def snk13(s, d):
    path, m = IO.scratch_path(s, "messages"), S.chat_messages(s, d).select("conv_id", "turn", "role")
    IO.append(m, path)
    IO.append(s.read.parquet(path).groupBy("conv_id").agg((F.max("turn") + 1).alias("turn")).withColumn("role", F.lit("user")), path)
    return s.read.parquet(path)


@register("snk14_feedback_upsert", f"WITH {LOG} SELECT user_id, item, arg_max(rating, version) AS rating, min(version) AS first_id, max(version) AS version FROM log GROUP BY 1, 2")
def snk14(s, d):
    """The last rating stands; the id of the first insert is kept. The log comes in two parts, the later one as an upsert."""
    fold = lambda rows: rows.groupBy("user_id", "item").agg(F.max_by("rating", "version").alias("rating"), F.min("first_id").alias("first_id"), F.max("version").alias("version"))
    log = _log(s, d).withColumn("first_id", F.col("version"))
    table = _kept(s, fold(log.where("version % 2 = 0")), "user_id", "item")
    table.change(fold(log.where("version % 2 = 1")), lambda current, new: fold(current.unionByName(new.select(*current.columns))))
    return table.read()


@register("snk15_insert_if_absent", "SELECT user_id, email FROM usr UNION ALL SELECT 1000, 'new@example.org'")
def snk15(s, d):
    table = _kept(s, S.chat_users(s, d), "user_id")
    table.insert_absent(s.createDataFrame([(1000, "new@example.org"), (3, "other@example.org")], "user_id long, email string"))
    return table.read()


@register("snk16_soft_delete", "SELECT conv_id, CASE WHEN conv_id % 10 = 0 THEN 'archived' ELSE status END AS status FROM conv")
def snk16(s, d):
    c = S.chat_conversations(s, d).select("conv_id", "status", F.lit(0).alias("v"))
    table = _kept(s, c, "conv_id")
    table.upsert(c.where("conv_id % 10 = 0").withColumns({"status": F.lit("archived"), "v": F.lit(1)}), "v")
    return table.read().drop("v")


# ---- chat views and reads


@register("view1_user_stats", "SELECT u.user_id, u.email, count(DISTINCT c.conv_id) AS total_conversations, CAST(0 AS BIGINT) AS total_questions, round(avg(m.confidence), 6) AS avg_confidence, round(avg(m.latency_ms), 4) AS avg_latency_ms, max(m.turn) AS last_activity FROM usr u LEFT JOIN conv c ON c.user_id = u.user_id AND c.status = 'active' LEFT JOIN msg m ON m.conv_id = c.conv_id AND m.role = 'assistant' GROUP BY 1, 2")
def view1(s, d):
    """As the view says: only assistant messages are joined, so its question count is always 0."""
    from ..operators import chat as C

    return C.user_stats(S.chat_users(s, d), S.chat_conversations(s, d), S.chat_messages(s, d))


@register("view1_user_stats_fixed", "SELECT u.user_id, count(DISTINCT c.conv_id) AS total_conversations, count(m.turn) FILTER (WHERE m.role = 'user') AS total_questions FROM usr u LEFT JOIN conv c ON c.user_id = u.user_id AND c.status = 'active' LEFT JOIN msg m ON m.conv_id = c.conv_id GROUP BY 1")
def view1_fixed(s, d):
    from ..operators import chat as C

    return C.user_stats(S.chat_users(s, d), S.chat_conversations(s, d), S.chat_messages(s, d), all_roles=True).select("user_id", "total_conversations", "total_questions")


QUERIES["join14_chained_outer"], ORACLES["join14_chained_outer"] = view1, ORACLES["view1_user_stats"]


@register("view2_history", "SELECT m.conv_id, m.turn, m.role, m.confidence, c.user_id FROM msg m JOIN conv c ON c.conv_id = m.conv_id")
def view2(s, d):
    c = S.chat_conversations(s, d).select("conv_id", "user_id")
    return S.chat_messages(s, d).select("conv_id", "turn", "role", "confidence").join(c, "conv_id").orderBy("conv_id", "turn")


QUERIES["join15_messages_conversations"], ORACLES["join15_messages_conversations"] = view2, ORACLES["view2_history"]


@register("oltp1_list_conversations", "SELECT c.conv_id, c.updated_at, count(m.turn) AS n, max(m.turn) AS last_turn FROM conv c LEFT JOIN msg m ON m.conv_id = c.conv_id WHERE c.user_id = 3 AND c.status = 'active' GROUP BY 1, 2 ORDER BY c.updated_at DESC, c.conv_id LIMIT 20")
def oltp1(s, d):
    from ..operators import chat as C

    return C.list_conversations(S.chat_conversations(s, d), S.chat_messages(s, d), 3, 20)


@register("oltp2_history", "SELECT turn, role FROM msg WHERE conv_id = 4 ORDER BY turn LIMIT 50")
def oltp2(s, d):
    return S.chat_messages(s, d).where("conv_id = 4").orderBy("turn").limit(50).select("turn", "role")


@register("oltp3_point_reads", "SELECT user_id, email FROM usr WHERE email = 'u7@example.org'")
def oltp3(s, d):
    return S.chat_users(s, d).where("email = 'u7@example.org'")


@register("oltp4_health", "SELECT (SELECT count(*) FROM usr) AS users, (SELECT count(*) FROM conv WHERE status = 'active') AS conversations, (SELECT count(*) FROM msg) AS messages")
def oltp4(s, d):
    return agg12(s, d).withColumnRenamed("active", "conversations")
