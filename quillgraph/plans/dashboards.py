"""Analytical queries over documents, chunks and edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import graph as G
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


def counted(df: DataFrame, *by: Column | str, name: str = "n") -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias(name))


def top(df: DataFrame, n: int, by: str, *ties: str) -> DataFrame:
    return df.orderBy(F.col(by).desc_nulls_last(), *[F.col(t).asc_nulls_last() for t in ties]).limit(n)


CHUNK_BUCKETS = [(0, "0"), (5, "1-5"), (20, "6-20"), (50, "21-50"), (100, "51-100")]
TOKEN_BUCKETS = [(100, "0-100"), (300, "101-300"), (500, "301-500"), (1000, "501-1000"), (2000, "1001-2000")]


def bucket_sql(x: str, bounds: list[tuple[int, str]], last: str) -> str:
    label = " ".join(f"WHEN {x} <= {b} THEN '{n}'" for b, n in bounds)
    order = " ".join(f"WHEN {x} <= {b} THEN {i}" for i, (b, _) in enumerate(bounds))
    return f"CASE {label} ELSE '{last}' END AS bucket, CAST(CASE {order} ELSE {len(bounds)} END AS INTEGER) AS bucket_order"


def per_document(s, d) -> DataFrame:
    """Documents with their chunk counts, zero included: chunks are counted before the join."""
    n = S.chunks(s, d).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_chunks"))
    return S.documents(s, d).join(n, "doc_id", "left").fillna(0, ["n_chunks"])


PER_DOC = "(SELECT g.*, coalesce(n, 0) AS n_chunks FROM doc g LEFT JOIN (SELECT doc_id, count(*) AS n FROM chk GROUP BY doc_id) c ON g.doc_id = c.doc_id)"


@register("dash1_total_documents", "SELECT count(*) AS total FROM doc")
def dash1(s, d):
    return S.documents(s, d).agg(F.count(F.lit(1)).alias("total"))


@register("dash2_total_chunks", "SELECT count(*) AS total FROM chk")
def dash2(s, d):
    return S.chunks(s, d).agg(F.count(F.lit(1)).alias("total"))


QUERIES["dash38_total_chunks_again"], ORACLES["dash38_total_chunks_again"] = dash2, ORACLES["dash2_total_chunks"]


@register("dash3_total_relationships", "SELECT (SELECT count(*) FROM hc) + (SELECT count(*) FROM edge) AS total")
def dash3(s, d):
    rows = S.has_chunk(s, d).select(F.lit(1).alias("x")).unionAll(S.edges(s, d).select(F.lit(1).alias("x")))
    return rows.agg(F.count(F.lit(1)).alias("total"))


@register("dash4_avg_chunks_per_document", f"SELECT round(avg(n_chunks), 1) AS avg_chunks FROM {PER_DOC}")
def dash4(s, d):
    return per_document(s, d).agg(F.round(F.avg("n_chunks"), 1).alias("avg_chunks"))


@register("dash5_nodes_by_label", "SELECT 'Document' AS label, count(*) AS n FROM doc UNION ALL SELECT 'Chunk', count(*) FROM chk")
def dash5(s, d):
    nodes = S.documents(s, d).select(F.lit("Document").alias("label")).unionAll(S.chunks(s, d).select(F.lit("Chunk").alias("label")))
    return counted(nodes, "label")


@register("dash6_relationships_by_type", "SELECT rel_type, count(*) AS n FROM (SELECT rel_type FROM edge UNION ALL SELECT 'HAS_CHUNK' FROM hc) GROUP BY rel_type")
def dash6(s, d):
    return counted(S.edges(s, d).select("rel_type").unionAll(S.has_chunk(s, d).select(F.lit("HAS_CHUNK").alias("rel_type"))), "rel_type")


@register("dash7_top_documents_by_chunks", "SELECT coalesce(title, CAST(g.doc_id AS VARCHAR)) AS document, count(*) AS n FROM doc g JOIN hc ON g.doc_id = hc.doc_id GROUP BY 1 ORDER BY n DESC, document LIMIT 10")
def dash7(s, d):
    docs = S.documents(s, d).select("doc_id", F.coalesce("title", F.col("doc_id").cast("string")).alias("document"))
    n = S.chunks(s, d).groupBy("doc_id").agg(F.count(F.lit(1)).alias("c"))
    return top(docs.join(n, "doc_id").groupBy("document").agg(F.sum("c").alias("n")), 10, "n", "document")


@register("dash8_top_issuing_bodies", "SELECT issuing_body, count(*) AS n FROM doc WHERE issuing_body IS NOT NULL AND issuing_body <> '' GROUP BY 1 ORDER BY n DESC, issuing_body LIMIT 15")
def dash8(s, d):
    return top(counted(S.documents(s, d).where("issuing_body is not null and issuing_body <> ''"), "issuing_body"), 15, "n", "issuing_body")


@register("dash9_documents_by_type", "SELECT coalesce(doc_type, 'unknown') AS doc_type, count(*) AS n FROM doc GROUP BY 1")
def dash9(s, d):
    return counted(S.documents(s, d).select(F.coalesce("doc_type", F.lit("unknown")).alias("doc_type")), "doc_type")


@register("dash10_chunk_histogram", f"SELECT bucket, bucket_order, count(*) AS n FROM (SELECT {bucket_sql('n_chunks', CHUNK_BUCKETS, '100+')} FROM {PER_DOC}) GROUP BY 1, 2")
def dash10(s, d):
    label, order = T.bucket("n_chunks", CHUNK_BUCKETS, "100+")
    return counted(per_document(s, d).select(label.alias("bucket"), order.alias("bucket_order")), "bucket", "bucket_order")


@register(
    "dash11_document_table",
    f"SELECT doc_number, title, doc_type, issuing_body, status, CAST(sum(n_chunks) AS BIGINT) AS n_chunks FROM {PER_DOC} GROUP BY ALL ORDER BY n_chunks DESC, doc_number LIMIT 200",
)
def dash11(s, d):
    return top(per_document(s, d).groupBy("doc_number", "title", "doc_type", "issuing_body", "status").agg(F.sum("n_chunks").alias("n_chunks")), 200, "n_chunks", "doc_number")


@register(
    "dash12_missing_metadata",
    "SELECT doc_id, CASE WHEN title IS NULL THEN '✗' ELSE '✓' END AS has_title, CASE WHEN issuing_body IS NULL THEN '✗' ELSE '✓' END AS has_body, CASE WHEN status IS NULL THEN '✗' ELSE '✓' END AS has_status FROM doc WHERE title IS NULL OR issuing_body IS NULL OR status IS NULL ORDER BY doc_id LIMIT 100",
)
def dash12(s, d):
    mark = lambda c: F.when(F.col(c).isNull(), "✗").otherwise("✓")
    rows = S.documents(s, d).where("title is null or issuing_body is null or status is null")
    return rows.select("doc_id", mark("title").alias("has_title"), mark("issuing_body").alias("has_body"), mark("status").alias("has_status")).orderBy("doc_id").limit(100)


@register("dash13_recently_updated", "SELECT doc_id, doc_number, title, status FROM doc WHERE status IS NOT NULL ORDER BY doc_id DESC LIMIT 25")
def dash13(s, d):
    """doc_id stands for the update time, which the fixture lacks."""
    return S.documents(s, d).where("status is not null").select("doc_id", "doc_number", "title", "status").orderBy(F.col("doc_id").desc()).limit(25)


@register("dash14_documents_by_status", "SELECT coalesce(status, 'unknown') AS status, count(*) AS n FROM doc GROUP BY 1")
def dash14(s, d):
    return counted(S.documents(s, d).select(F.coalesce("status", F.lit("unknown")).alias("status")), "status")


@register("dash15_orphan_documents_by_body", "SELECT coalesce(issuing_body, 'unknown') AS issuing_body, count(*) AS n FROM odoc g WHERE NOT EXISTS (SELECT 1 FROM ohc WHERE ohc.doc_id = g.doc_id) GROUP BY 1")
def dash15(s, d):
    orphans = S.graph_documents(s, d).join(S.graph_chunks(s, d).select("doc_id"), "doc_id", "left_anti")
    return counted(orphans.select(F.coalesce("issuing_body", F.lit("unknown")).alias("issuing_body")), "issuing_body")


@register("dash16_avg_tokens", "SELECT round(avg(token_count), 0) AS avg_tokens FROM chk WHERE token_count IS NOT NULL")
def dash16(s, d):
    return S.chunks(s, d).where("token_count is not null").agg(F.round(F.avg("token_count"), 0).alias("avg_tokens"))


@register("dash17_max_tokens", "SELECT max(token_count) AS max_tokens FROM chk")
def dash17(s, d):
    return S.chunks(s, d).agg(F.max("token_count").alias("max_tokens"))


@register("dash18_token_histogram", f"SELECT bucket, bucket_order, count(*) AS n FROM (SELECT {bucket_sql('token_count', TOKEN_BUCKETS, '2000+')} FROM chk) GROUP BY 1, 2")
def dash18(s, d):
    label, order = T.bucket("token_count", TOKEN_BUCKETS, "2000+")
    return counted(S.chunks(s, d).select(label.alias("bucket"), order.alias("bucket_order")), "bucket", "bucket_order")


@register("dash19_top_chapters", "SELECT chapter, count(*) AS n FROM chk WHERE chapter IS NOT NULL GROUP BY 1 ORDER BY n DESC, chapter LIMIT 15")
def dash19(s, d):
    return top(counted(S.chunks(s, d).where("chapter is not null"), "chapter"), 15, "n", "chapter")


@register(
    "dash20_longest_chunks",
    "SELECT coalesce(g.title, CAST(c.doc_id AS VARCHAR)) AS document, c.chunk_uid, c.token_count, substr(c.text, 1, 100) || '...' AS preview FROM chk c LEFT JOIN doc g ON g.doc_id = c.doc_id ORDER BY c.token_count DESC, c.chunk_uid LIMIT 25",
)
def dash20(s, d):
    """The top 25 are found before the join; only they meet their documents."""
    best = top(S.chunks(s, d).select("doc_id", "chunk_uid", "token_count", T.preview("text").alias("preview")), 25, "token_count", "chunk_uid")
    docs = S.documents(s, d).select("doc_id", "title")
    return best.join(docs, "doc_id", "left").select(F.coalesce("title", F.col("doc_id").cast("string")).alias("document"), "chunk_uid", "token_count", "preview")


@register("dash21_refers_to_count", "SELECT count(*) AS total FROM edge WHERE rel_type = 'REFERS_TO'")
def dash21(s, d):
    return S.edges(s, d).where("rel_type = 'REFERS_TO'").agg(F.count(F.lit(1)).alias("total"))


def _end(s, d, end: str):
    named = S.edges(s, d).join(S.edge_nodes(s, d).select(F.col("id").alias(end), "title"), end)
    return top(counted(named.select(F.coalesce("title", end).alias("document")), "document"), 10, "n", "document")


@register("dash22_most_referenced", "SELECT coalesce(title, id) AS document, count(*) AS n FROM edge JOIN node ON id = dst GROUP BY 1 ORDER BY n DESC, document LIMIT 10")
def dash22(s, d):
    return _end(s, d, "dst")


@register("dash23_most_referencing", "SELECT coalesce(title, id) AS document, count(*) AS n FROM edge JOIN node ON id = src GROUP BY 1 ORDER BY n DESC, document LIMIT 10")
def dash23(s, d):
    return _end(s, d, "src")


@register("dash24_relation_types", "SELECT coalesce(relation_type, 'unknown') AS relation_type, count(*) AS n FROM edge GROUP BY 1")
def dash24(s, d):
    return counted(S.edges(s, d).select(F.coalesce("relation_type", F.lit("unknown")).alias("relation_type")), "relation_type")


@register("dash25_edge_table", "SELECT a.title AS source, rel_type, b.title AS target FROM edge JOIN node a ON a.id = src JOIN node b ON b.id = dst ORDER BY source, rel_type, target LIMIT 100")
def dash25(s, d):
    n = S.edge_nodes(s, d)
    rows = S.edges(s, d).join(n.select(F.col("id").alias("src"), F.col("title").alias("source")), "src").join(n.select(F.col("id").alias("dst"), F.col("title").alias("target")), "dst")
    return rows.select("source", "rel_type", "target").orderBy("source", "rel_type", "target").limit(100)


@register(
    "dash26_centrality",
    "SELECT id, CAST(sum(o) AS BIGINT) AS out_degree, CAST(sum(i) AS BIGINT) AS in_degree, CAST(sum(o + i) AS BIGINT) AS degree FROM (SELECT src AS id, 1 AS o, 0 AS i FROM edge UNION ALL SELECT dst, 0, 1 FROM edge) GROUP BY id HAVING sum(o + i) > 0 ORDER BY degree DESC, id LIMIT 15",
)
def dash26(s, d):
    return top(G.degrees(S.edges(s, d)).where("degree > 0"), 15, "degree", "id")


@register("dash27_sample_subgraph", "SELECT g.doc_id, c.chunk_uid FROM (SELECT doc_id FROM doc ORDER BY doc_id LIMIT 5) g JOIN chk c ON c.doc_id = g.doc_id")
def dash27(s, d):
    few = S.documents(s, d).select("doc_id").orderBy("doc_id").limit(5)
    return few.join(S.chunks(s, d).select("doc_id", "chunk_uid"), "doc_id")


@register("dash28_reference_network", "SELECT src, dst FROM edge WHERE rel_type = 'REFERS_TO' ORDER BY src, dst LIMIT 100")
def dash28(s, d):
    return S.edges(s, d).where("rel_type = 'REFERS_TO'").select("src", "dst").orderBy("src", "dst").limit(100)


EXPAND_SQL = """
both_ways AS (SELECT src AS a, dst AS b, rel_type, src || rel_type || dst AS eid FROM edge UNION ALL SELECT dst, src, rel_type, src || rel_type || dst FROM edge WHERE src <> dst),
hop1 AS (SELECT b AS id, eid, [rel_type] AS types FROM both_ways JOIN {seed} z ON a = z.id),
hop2 AS (SELECT b AS id, list_append(types, rel_type) AS types FROM hop1 JOIN both_ways ON a = hop1.id WHERE both_ways.eid <> hop1.eid),
reach AS (SELECT id, 1 AS hop, min(types) AS types FROM hop1 GROUP BY id UNION ALL SELECT id, 2, min(types) FROM hop2 GROUP BY id),
found AS (SELECT id, min(hop) AS hop, min_by(types, hop) AS types FROM reach WHERE id NOT IN (SELECT id FROM {seed}) GROUP BY id)
"""
HUB = "(SELECT id FROM (SELECT id, count(*) AS n FROM (SELECT src AS id FROM edge UNION ALL SELECT dst FROM edge) GROUP BY id ORDER BY n DESC, id LIMIT 1))"


@register("dash29_hub_neighbourhood", f"WITH {EXPAND_SQL.format(seed=HUB)} SELECT id, CAST(hop AS INTEGER) AS hop FROM found")
def dash29(s, d):
    e = S.edges(s, d)
    hub = top(G.degrees(e), 1, "degree", "id").select("id")
    return G.expand(S.links(s, d), hub, 2).select("id", "hop")


@register("dash30_keyword_exploration", "SELECT g.doc_id, g.title, c.chunk_uid FROM (SELECT doc_id, title FROM doc WHERE lower(title) LIKE '%the%' ORDER BY doc_id LIMIT 10) g LEFT JOIN chk c ON c.doc_id = g.doc_id")
def dash30(s, d):
    few = S.documents(s, d).where(T.contains_any(["the"], "title")).select("doc_id", "title").orderBy("doc_id").limit(10)
    return few.join(S.chunks(s, d).select("doc_id", "chunk_uid"), "doc_id", "left")


@register("dash31_sunburst3", "SELECT coalesce(issuing_body, 'unknown') || '>' || coalesce(doc_type, 'unknown') || '>' || coalesce(status, 'unknown') AS path, count(*) AS n FROM doc GROUP BY 1")
def dash31(s, d):
    unknown = lambda c: F.coalesce(c, F.lit("unknown"))
    rows = S.documents(s, d).select(F.array(unknown("issuing_body"), unknown("doc_type"), unknown("status")).alias("path"))
    return counted(rows, "path").select(F.array_join("path", ">").alias("path"), "n")


@register("dash32_sunburst2", "SELECT coalesce(doc_type, 'unknown') AS doc_type, coalesce(status, 'unknown') AS status, count(*) AS n FROM doc GROUP BY ALL")
def dash32(s, d):
    unknown = lambda c: F.coalesce(c, F.lit("unknown")).alias(c)
    return counted(S.documents(s, d).select(unknown("doc_type"), unknown("status")), "doc_type", "status")


@register("dash33_complete_metadata", "SELECT count(*) AS total, count(CASE WHEN title IS NOT NULL AND doc_type IS NOT NULL AND status IS NOT NULL THEN 1 END) AS complete, round(count(CASE WHEN title IS NOT NULL AND doc_type IS NOT NULL AND status IS NOT NULL THEN 1 END) * 100.0 / nullif(count(*), 0), 1) AS pct FROM doc")
def dash33(s, d):
    ok = F.count_if(F.col("title").isNotNull() & F.col("doc_type").isNotNull() & F.col("status").isNotNull())
    return S.documents(s, d).agg(F.count(F.lit(1)).alias("total"), ok.alias("complete"), F.round(ok.cast("double") * 100.0 / F.nullif(F.count(F.lit(1)), F.lit(0)), 1).alias("pct"))


@register("dash34_orphan_chunks", "SELECT count(*) AS total FROM ochk c WHERE NOT EXISTS (SELECT 1 FROM odoc g WHERE g.doc_id = c.doc_id)")
def dash34(s, d):
    return S.graph_chunks(s, d).select("doc_id").join(S.graph_documents(s, d).select("doc_id"), "doc_id", "left_anti").agg(F.count(F.lit(1)).alias("total"))


@register("dash35_isolated_chunks", "SELECT count(*) AS total FROM ochk c WHERE NOT EXISTS (SELECT 1 FROM edge e WHERE e.src = c.chunk_uid AND rel_type = 'REFERS_TO') AND NOT EXISTS (SELECT 1 FROM edge e WHERE e.dst = c.chunk_uid AND rel_type = 'REFERS_TO')")
def dash35(s, d):
    e = S.edges(s, d).where("rel_type = 'REFERS_TO'")
    tied = e.select(F.col("src").alias("chunk_uid")).union(e.select(F.col("dst").alias("chunk_uid"))).distinct()
    return S.graph_chunks(s, d).select("chunk_uid").join(tied, "chunk_uid", "left_anti").agg(F.count(F.lit(1)).alias("total"))


PROPERTIES = ("title", "doc_number", "doc_type", "issuing_body", "status")


@register("dash36_property_coverage", " UNION ALL ".join(f"SELECT '{p}' AS property, round(count({p}) * 100.0 / nullif(count(*), 0), 1) AS pct FROM doc" for p in PROPERTIES))
def dash36(s, d):
    pct = lambda p: F.round(F.count(p).cast("double") * 100.0 / F.nullif(F.count(F.lit(1)), F.lit(0)), 1).alias(p)
    return S.documents(s, d).agg(*[pct(p) for p in PROPERTIES]).unpivot([], list(PROPERTIES), "property", "pct")


@register("dash37_duplicate_documents", "SELECT title, count(*) AS n, list_sort(list(doc_id))[1] AS first_id FROM doc WHERE title IS NOT NULL GROUP BY title HAVING count(*) > 1")
def dash37(s, d):
    """Grouped by title, as the fixture's ids are unique."""
    return S.documents(s, d).where("title is not null").groupBy("title").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id")).where("n > 1")
