"""Vector search, keyword search, graph expansion, fusion and what is built from their hits."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import answer as A
from ..operators import graph as G
from ..operators import hybrid as H
from ..operators import postings as P
from ..operators import retrieval as R
from ..operators import vector_index as VI
from . import surrogates as S
from ..sources.io import scratch_path
from .relational import RELATIONS, relations

QUERIES: dict = {}
ORACLES: dict = {}


def register(name: str, oracle: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if oracle is not None:
            ORACLES[name] = S.sql(oracle)
        return f

    return keep


TERMS = ["the", "and", "er"]


def _corpus(s, d):
    return S.raw(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


def _queries(s, d, test="vec_id % 100 = 0"):
    """Every hundredth row is a query against all rows."""
    return S.raw(s, d, "embeddings").where(test).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))


VEC = "v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS e, label FROM embeddings), q AS (SELECT id AS query_id, e AS qe FROM v WHERE id % 100 = 0)"
SIM = {
    "cosine": "list_dot_product(e, qe) / (sqrt(list_dot_product(e, e)) * sqrt(list_dot_product(qe, qe)))",
    "dot": "list_dot_product(e, qe)",
    "euclid": "-sqrt(list_sum(list_transform(range(1, len(e) + 1), lambda i: (e[i] - qe[i]) * (e[i] - qe[i]))))",
    "manhattan": "-list_sum(list_transform(range(1, len(e) + 1), lambda i: abs(e[i] - qe[i])))",
}


def knn_sql(metric: str, k: int, where: str = "TRUE", threshold: float | None = None) -> str:
    t = f"AND score >= {threshold}" if threshold is not None else ""
    return f"""WITH {VEC}, sc AS (SELECT query_id, id, {SIM[metric]} AS score FROM v, q WHERE id <> query_id AND {where}),
    rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, id) AS rank FROM sc WHERE TRUE {t})
    SELECT query_id, id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM rk WHERE rank <= {k}"""


def _knn(s, d, metric="cosine", k=10, threshold=None, filters=None):
    # The query itself is in the corpus, at the first rank by any metric but dot; one more row is asked for.
    hits = R.knn(_corpus(s, d), _queries(s, d), k + 1, threshold, metric, filters).where("id <> query_id")
    order = Window.partitionBy("query_id").orderBy("rank")
    hits = hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return hits.select("query_id", "id", F.round("score", 6).alias("score"), "rank")


for _metric in SIM:
    register(f"vec1_knn_{_metric}", knn_sql(_metric, 10))(lambda s, d, m=_metric: _knn(s, d, m))


@register("ret1_vector_search", knn_sql("cosine", 10, threshold=0.3))
def ret1(s, d):
    return _knn(s, d, threshold=0.3)


@register("flt5_payload_filter", knn_sql("cosine", 5, "label >= 3 AND label <= 7"))
def flt5(s, d):
    return _knn(s, d, k=5, filters={"label": {"gte": 3, "lte": 7}})


@register("flt6_score_threshold", f"WITH {VEC} SELECT query_id, count(*) AS n FROM v, q WHERE id <> query_id AND round({SIM['cosine']}, 6) >= 0.25 GROUP BY query_id")
def flt6(s, d):
    pairs = R.similar(_corpus(s, d), _queries(s, d), 0.25 - 1e-6).where("id <> query_id and key >= 0.25")  # the tasks drop what scores less
    return pairs.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))


@register("join17_query_by_corpus", f"WITH {VEC} SELECT query_id, id, round({SIM['dot']}, 6) AS score FROM v, q WHERE label = 1")
def join17(s, d):
    """Every pair of a query and a row of one label, by a payload filter; tasks hand the pairs on as they score them."""
    return R.similar(_corpus(s, d), _queries(s, d), metric="dot", filters={"label": 1}).select("query_id", "id", F.round("score", 6).alias("score"))


@register("srt2_vector_topk", f"SELECT *, row_number() OVER (ORDER BY query_id, rank) AS place FROM ({knn_sql('cosine', 20)})")
def srt2(s, d):
    hits = _knn(s, d, k=20)
    # Questions number a hundredth of the rows: each has its places after those of the questions before it.
    n = hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    before = n.withColumn("before", F.sum("n").over(Window.orderBy("query_id").rowsBetween(Window.unboundedPreceding, -1))).select("query_id", F.coalesce("before", F.lit(0)).alias("before"))
    return hits.join(before, "query_id").withColumn("place", F.col("before") + F.col("rank")).drop("before")


def _index(s, d):
    return S.built(s, d, "cells", lambda path: VI.build(_corpus(s, d), path))


@register("ret1_vector_index", knn_sql("cosine", 10, threshold=0.3))
def ret1_index(s, d):
    """What the scan gives, from a stored index of cells."""
    hits = VI.search(s, _index(s, d), _queries(s, d), 11, 0.3).where("id <> query_id")
    hits = hits.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))).where("rank <= 10")
    return hits.select("query_id", "id", F.round("score", 6).alias("score"), "rank")


@register("src11_vector_index_rows", "SELECT vec_id AS id, label, len(embedding) AS width FROM embeddings")
def src11_index(s, d):
    """The index holds every row, with its payload."""
    return VI.read_rows(s, _index(s, d)).select("id", "label", F.size("vector").cast("long").alias("width"))


TF = " , ".join(f"len(list_filter(w, lambda x: x = '{t}')) AS tf{i}" for i, t in enumerate(TERMS))
BM25_SQL = f"""
tok AS (SELECT chunk_uid AS id, regexp_extract_all(lower(text || ' D' || doc_id), '[\\p{{L}}\\p{{N}}_]+') AS w FROM chk),
tf AS (SELECT id, len(w) AS dl, {TF} FROM tok),
st AS (SELECT count(*) AS n, avg(dl) AS avgdl, {", ".join(f"count(*) FILTER (WHERE tf{i} > 0) AS df{i}" for i in range(len(TERMS)))} FROM tf),
bm AS (SELECT id, {" + ".join(f"CASE WHEN tf{i} > 0 THEN ln(1 + (n - df{i} + 0.5) / (df{i} + 0.5)) * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * dl / avgdl)) ELSE 0 END" for i in range(len(TERMS)))} AS score
  FROM tf, st WHERE {" OR ".join(f"tf{i} > 0" for i in range(len(TERMS)))})
"""


KBEST = "kb AS (SELECT query_id, id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, id) AS rank FROM kbm)"


def _words(s, d, k, carry=()):
    """Every question's best chunks by the stored postings."""
    return P.search(s, S.fulltext(s, d), S.questions(s, d), k, carry)


def _terms(s):
    """Three frequent words as one question."""
    return s.createDataFrame([(0, TERMS)], "query_id long, terms array<string>")


@register(
    "ret2_bm25_topk",
    f"WITH {BM25_SQL}, tp AS (SELECT id, round(score, 6) AS score FROM bm ORDER BY score DESC, id LIMIT 20) SELECT tp.id, tp.score, g.doc_id, g.doc_number, g.title FROM tp JOIN chk c ON c.chunk_uid = tp.id JOIN doc g ON g.doc_id = c.doc_id",
)
def ret2(s, d):
    best = P.search(s, S.fulltext(s, d), _terms(s), 20, ("doc_id",)).select("id", F.round("score", 6).alias("score"), "doc_id")
    docs = S.documents(s, d, labelled=False).select("doc_id", "doc_number", "title")
    return docs.join(F.broadcast(best), "doc_id").select("id", "score", "doc_id", "doc_number", "title")  # twenty rows


@register("ret2_bm25_scan", f"WITH {BM25_SQL} SELECT id, round(score, 6) AS score FROM bm")
def ret2_scan(s, d):
    """Every chunk scored without an index."""
    return R.bm25(S.searched(s, d), TERMS, "chunk_uid", "search_text").select("id", F.round("score", 6).alias("score"))


@register("ret2_bm25_questions", f"WITH {KBEST} SELECT query_id, id, doc_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM kb WHERE rank <= 20")
def ret2_questions(s, d):
    return _words(s, d, 20, ("doc_id",)).select("query_id", "id", "doc_id", F.round("score", 6).alias("score"), "rank")


@register("srt3_keyword_topk", f"WITH {KBEST} SELECT query_id, id, round(score, 6) AS score FROM kb WHERE rank <= 50 ORDER BY query_id, rank")
def srt3(s, d):
    return _words(s, d, 50).select("query_id", "id", F.round("score", 6).alias("score"))


@register("agg10_max_normalised", f"WITH {KBEST} SELECT query_id, id, round(score / max(score) OVER (PARTITION BY query_id), 6) AS score FROM kb WHERE rank <= 20")
def agg10(s, d):
    best = _words(s, d, 20)
    return best.select("query_id", "id", F.round(F.col("score") / F.max("score").over(Window.partitionBy("query_id")), 6).alias("score"))  # twenty rows a question


@register("src11_fulltext_scan", "SELECT query_id, count(*) AS n FROM kbm GROUP BY query_id")
def src11(s, d):
    return P.matching(s, S.fulltext(s, d), S.questions(s, d))


# Two ranked lists of chunks a question: first chunks by their vectors, and chunks by their words.
LISTS = f"""
sv AS (SELECT query_id, id, {SIM["cosine"]} AS score FROM cvec, asks WHERE doc_id <> query_id),
{KBEST},
a AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, id) AS rank, 0 AS li, 'vector' AS source FROM sv QUALIFY rank <= 20
  UNION ALL SELECT query_id, id, rank, 1, 'keyword' FROM kb WHERE rank <= 20)"""


def _lists(s, d):
    vectors = S.first_vectors(s, d).select(F.col("chunk_uid").alias("id"), "doc_id", "vector")
    near = R.knn(vectors, S.questions(s, d), 21)
    own = F.concat(F.col("query_id").cast("string"), F.lit("__00001"))  # a question's own document is no hit
    return [R.ranked(near.where(F.col("id") != own), "vector", 0, 20), R.ranked(_words(s, d, 20), "keyword", 1, 20)]


def rrf_sql(weights: list[float]) -> str:
    return f"""WITH {LISTS}
    SELECT query_id, id, round(sum(CASE li WHEN 0 THEN CAST({weights[0]} AS DOUBLE) ELSE CAST({weights[1]} AS DOUBLE) END / (60 + rank)), 6) AS rrf_score, array_to_string(list(source ORDER BY li), ',') AS sources FROM a GROUP BY query_id, id"""


def _fused(df):
    return df.select("query_id", "id", "rrf_score", F.array_join("sources", ",").alias("sources"))


@register("ret6_rrf", rrf_sql([0.5, 0.5]))
def ret6(s, d):
    return _fused(R.rrf(_lists(s, d)))


@register("join18_rank_fusion", rrf_sql([0.7, 0.18]))
def join18(s, d):
    return _fused(R.rrf(_lists(s, d), R.fusion_weights(0.7, False)[:2]))


@register("agg11_weighted_sum", f"WITH {LISTS} SELECT query_id, id, round(sum(CASE li WHEN 0 THEN 0.6::DOUBLE ELSE 0.4::DOUBLE END / (60 + rank)), 6) AS rrf_score, CAST(min(li) AS INTEGER) AS first_list FROM a GROUP BY query_id, id")
def agg11(s, d):
    return R.rrf(_lists(s, d), [0.6, 0.4]).select("query_id", "id", "rrf_score", "first_list")


@register("srt10_fused_order", f"WITH {LISTS}, f AS (SELECT query_id, id, round(sum(0.5::DOUBLE / (60 + rank)), 6) AS rrf_score, min((li, rank)) AS f FROM a GROUP BY query_id, id) SELECT query_id, id, rrf_score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, f) AS INTEGER) AS position FROM f QUALIFY position <= 10")
def srt10(s, d):
    order = Window.partitionBy("query_id").orderBy(F.col("rrf_score").desc(), "first_list", "first_rank")
    return R.rrf(_lists(s, d)).withColumn("position", F.row_number().over(order)).where("position <= 10").select("query_id", "id", "rrf_score", "position")


@register("win1_rank_in_list", f"WITH {LISTS} SELECT query_id, id, CAST(rank AS INTEGER) AS rank, source FROM a")
def win1(s, d):
    a, b = _lists(s, d)
    return a.unionByName(b).select("query_id", "id", "rank", "source")


@register("mth3_reciprocal_rank", f"WITH {LISTS} SELECT query_id, id, source, round(0.7::DOUBLE / (60 + rank), 6) AS part FROM a")
def mth3(s, d):
    a, b = _lists(s, d)
    return a.unionByName(b).select("query_id", "id", "source", F.round(F.lit(0.7) / (R.RRF_K + F.col("rank")), 6).alias("part"))


@register("mth4_fusion_weights", f"WITH {LISTS} SELECT query_id, id, round(sum(CASE li WHEN 0 THEN 0.7::DOUBLE ELSE 0.18::DOUBLE END), 6) AS weight FROM a GROUP BY query_id, id")
def mth4(s, d):
    """The weights of the lists that hold a chunk; without a graph list they aren't scaled to one."""
    lists = [x.withColumn("w", F.lit(w)) for x, w in zip(_lists(s, d), R.fusion_weights(0.7, False))]
    return lists[0].unionByName(lists[1]).groupBy("query_id", "id").agg(F.round(F.sum("w"), 6).alias("weight"))


#: Each seed's neighbourhood of two hops; a seed is no hit of its own.
NEAR = """
both_ways AS (SELECT src AS a, dst AS b, rel_type FROM edge UNION ALL SELECT dst, src, rel_type FROM edge),
hop1 AS (SELECT z.id AS query_id, b AS id, min([rel_type]) AS types FROM both_ways JOIN seed z ON a = z.id WHERE b <> z.id GROUP BY z.id, b),
hop2 AS (SELECT query_id, b AS id, min(list_append(types, rel_type)) AS types FROM hop1 JOIN both_ways ON a = hop1.id WHERE b <> query_id GROUP BY query_id, b),
found AS (SELECT query_id, id, 1 AS hop, types FROM hop1 UNION ALL SELECT query_id, id, 2, types FROM hop2 ANTI JOIN hop1 USING (query_id, id))
"""


def _near(s, d, depth=2, most=None):
    return G.expand_many(S.links(s, d), S.seeds(s, d), depth, most)


@register("ret3_graph_expand", f"WITH {NEAR} SELECT query_id, id, CAST(hop AS INTEGER) AS hop, array_to_string(types, '>') AS path, round(1.0::DOUBLE / hop, 4) AS graph_score FROM found")
def ret3(s, d):
    return _near(s, d).select("query_id", "id", "hop", F.array_join("rel_types", ">").alias("path"), "graph_score")


@register("join8_variable_length_path", f"WITH {NEAR} SELECT query_id, CAST(hop AS INTEGER) AS hop, count(*) AS n FROM found GROUP BY query_id, hop")
def join8(s, d):
    return _near(s, d).groupBy("query_id", "hop").agg(F.count(F.lit(1)).alias("n"))


@register("srt4_hop_order", f"WITH {NEAR} SELECT query_id, id, CAST(hop AS INTEGER) AS hop FROM found QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY hop, id) <= 25")
def srt4(s, d):
    return _near(s, d, most=25).select("query_id", "id", "hop")


@register("agg8_first_path_types", f"WITH {NEAR} SELECT query_id, id, types[1] AS first_type, CAST(len(types) AS INTEGER) AS n_types FROM found")
def agg8(s, d):
    return _near(s, d).select("query_id", "id", F.get("rel_types", F.lit(0)).alias("first_type"), F.size("rel_types").alias("n_types"))


@register("flt16_endpoint_filter", "SELECT DISTINCT seed.id AS query_id, dst AS id FROM edge JOIN seed ON src = seed.id WHERE dst IS NOT NULL AND dst <> seed.id")
def flt16(s, d):
    return _near(s, d, 1).select("query_id", "id")


@register("join9_one_hop_directions", "SELECT seed.id AS center, rel_type AS relation, 'out' AS direction, dst AS other FROM edge JOIN seed ON seed.id = src UNION SELECT seed.id, rel_type, 'in', src FROM edge JOIN seed ON seed.id = dst")
def join9(s, d):
    return G.neighbours(S.links(s, d), S.seeds(s, d))


@register("ret5_related_documents", "SELECT c.id AS center, relation, direction, n.id AS doc_number, n.title, n.doc_type FROM (SELECT id, rel_type AS relation, 'out' AS direction, dst AS other FROM edge JOIN seed ON id = src UNION SELECT id, rel_type, 'in', src FROM edge JOIN seed ON id = dst) c JOIN node n ON n.id = other")
def ret5(s, d):
    nodes = S.edge_nodes(s, d).withColumnRenamed("id", "doc_number")
    return G.neighbours(S.links(s, d), S.seeds(s, d)).join(nodes, F.col("other") == F.col("doc_number")).select("center", "relation", "direction", "doc_number", "title", "doc_type")


@register("flt7_locate_document", "SELECT doc_id, title FROM doc WHERE lower(coalesce(title, '')) LIKE '%the%' OR doc_number = 'D1' ORDER BY length(coalesce(title, '')), doc_id LIMIT 1")
def flt7(s, d):
    return G.locate(S.documents(s, d), "D1", "the").select("doc_id", "title")


QUERIES["srt6_shortest_title"], ORACLES["srt6_shortest_title"] = flt7, ORACLES["flt7_locate_document"]


@register("ret4_document_chunks", "SELECT c.chunk_uid, c.chunk_order, 1.0::DOUBLE AS graph_score FROM (SELECT doc_id FROM doc WHERE doc_number = 'D3' ORDER BY length(coalesce(title, '')), doc_id LIMIT 1) g JOIN chk c ON c.doc_id = g.doc_id ORDER BY c.chunk_order LIMIT 400")
def ret4(s, d):
    one = G.locate(S.documents(s, d), "D3").select("doc_id")
    rows = S.chunks(s, d).join(one, "doc_id").orderBy("chunk_order").limit(400)
    return rows.select("chunk_uid", "chunk_order", F.lit(1.0).alias("graph_score"))


@register("srt5_chunks_in_order", "SELECT chunk_uid, chunk_order FROM chk ORDER BY doc_id, chunk_order LIMIT 400")
def srt5(s, d):
    return S.chunks(s, d).orderBy("doc_id", "chunk_order").limit(400).select("chunk_uid", "chunk_order")


@register("win2_first_chunks", "SELECT chunk_uid, CAST(rn AS INTEGER) AS rn FROM (SELECT chunk_uid, row_number() OVER (PARTITION BY doc_id ORDER BY chunk_order) AS rn FROM chk WHERE doc_id IN (SELECT doc_id FROM doc)) WHERE rn <= 3")
def win2(s, d):
    return G.first_chunks(S.chunks(s, d), S.documents(s, d).select("doc_id")).select("chunk_uid", "rn")


# Hybrid search for every question. A document's first chunk has the vector whose vec_id is the doc_id; other chunks have none. Relations tie documents.
HYBRID_K = 10
HYBRID = f"""
WITH {RELATIONS}, {KBEST},
dedge AS (SELECT DISTINCT r.source_doc_id AS src, g.doc_id AS dst, coalesce(nullif(replace(upper(trim(r.relation_type)), ' ', '_'), ''), 'REFERS_TO') AS rel_type FROM rel r JOIN doc g ON g.doc_number = r.target_doc_number),
sv AS (SELECT query_id, id, doc_id, {SIM["cosine"]} AS score FROM cvec, asks),
l0 AS (SELECT query_id, id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, id) AS rank FROM sv WHERE score >= 0.3 QUALIFY rank <= {2 * HYBRID_K}),
l1 AS (SELECT query_id, id, rank FROM kb WHERE rank <= {2 * HYBRID_K}),
z AS (SELECT query_id, doc_id AS id FROM (SELECT query_id, doc_id, min(rank) AS r FROM l0 GROUP BY query_id, doc_id) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY r) <= 20),
bw AS (SELECT src AS a, dst AS b, rel_type FROM dedge UNION ALL SELECT dst, src, rel_type FROM dedge),
h1 AS (SELECT DISTINCT query_id, b AS id FROM bw JOIN z ON a = z.id ANTI JOIN z y ON y.query_id = z.query_id AND y.id = b),
h2 AS (SELECT DISTINCT query_id, b AS id FROM h1 JOIN bw ON a = h1.id),
found AS (SELECT query_id, id, 1 AS hop FROM h1 UNION ALL SELECT query_id, id, 2 FROM h2 ANTI JOIN z USING (query_id, id) ANTI JOIN h1 USING (query_id, id)),
near AS (SELECT * FROM found QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY hop, id) <= {2 * HYBRID_K}),
l2 AS (SELECT query_id, chunk_uid AS id, row_number() OVER (PARTITION BY query_id ORDER BY hop, c.doc_id, c.chunk_order) AS rank FROM near n JOIN chk c ON c.doc_id = n.id WHERE c.chunk_order <= 3),
a AS (SELECT query_id, id, rank, 0 AS li FROM l0 UNION ALL SELECT query_id, id, rank, 1 FROM l1 UNION ALL SELECT query_id, id, rank, 2 FROM l2),
f AS (SELECT query_id, id, round(sum(CAST([0.7, 0.18, 0.12] AS DOUBLE[])[li + 1] / (60 + rank)), 6) AS rrf_score, min((li, rank)) AS first, string_agg(CASE li WHEN 0 THEN 'vector' WHEN 1 THEN 'keyword' ELSE 'graph' END, ',' ORDER BY li) AS sources FROM a GROUP BY query_id, id),
t AS (SELECT query_id, id, rrf_score, sources, row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, first) AS position FROM f QUALIFY position <= {HYBRID_K})
"""


def _hybrid_corpus(s, d):
    docs = S.documents(s, d)
    edges = G.merge_edges(relations(s, d), docs.select("doc_id", "doc_number")).where("dst_doc_id is not null")
    edges = edges.select(F.xxhash64("src", "rel_type", "dst_doc_id").alias("edge_id"), "src", F.col("dst_doc_id").alias("dst"), "rel_type")
    return H.Corpus(S.gold(s, d), docs, edges, "search_text", S.fulltext(s, d), S.first_vectors(s, d))


@register("ret7_hybrid_search", HYBRID + "SELECT query_id, CAST(position AS INTEGER) AS position, t.id, rrf_score, sources, doc_id, chunk_order, token_count FROM t JOIN chk ON chunk_uid = t.id")
def ret7(s, d):
    """Vectors, terms and relations, fused for every question in one plan over stored chunks and postings."""
    hits, _ = H.search_many(_hybrid_corpus(s, d), S.questions(s, d), HYBRID_K)
    return hits.select("query_id", "position", "id", "rrf_score", F.array_join("sources", ",").alias("sources"), "doc_id", "chunk_order", "token_count")


@register("ret10_hybrid_citations", HYBRID + "SELECT query_id, doc_id, min(position) AS position, title FROM t JOIN chk ON chunk_uid = t.id JOIN doc USING (doc_id) GROUP BY query_id, doc_id, title")
def ret10_hybrid(s, d):
    """Each question's documents, by their best hit, with titles."""
    hits, _ = H.search_many(_hybrid_corpus(s, d), S.questions(s, d), HYBRID_K)
    cited = A.citations(hits.withColumn("key", F.concat_ws(":", "query_id", "doc_id")), "key", "position")
    return cited.join(S.documents(s, d, labelled=False).select("doc_id", "title"), "doc_id").select("query_id", "doc_id", F.col("position").cast("long").alias("position"), "title")


@register("snk7_stored_postings", f"WITH {BM25_SQL}, tp AS (SELECT id, round(score, 6) AS score FROM bm ORDER BY score DESC, id LIMIT 20) SELECT * FROM tp")
def snk7(s, d):
    """The full-text index built as files and searched."""
    path = scratch_path(s, "postings")
    P.build(S.searched(s, d), path, "chunk_uid", "search_text")
    return P.search(s, path, _terms(s), 20).select("id", F.round("score", 6).alias("score"))


HITS = "h AS (SELECT chunk_uid, doc_id, text, row_number() OVER (ORDER BY token_count DESC, chunk_uid) AS rank FROM chk QUALIFY rank <= 30)"


def _hits(s, d):
    best = S.chunks(s, d).orderBy(F.col("token_count").desc(), "chunk_uid").limit(30)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.col("token_count").desc(), "chunk_uid")))  # thirty rows


@register("win3_citations", f"WITH {HITS} SELECT doc_id, chunk_uid, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY rank) AS rn FROM h) WHERE rn = 1")
def win3(s, d):
    return A.citations(_hits(s, d), "doc_id", "rank").select("doc_id", "chunk_uid", "rank")


@register("win4_related_citations", "SELECT dst AS doc_number, rel_type FROM (SELECT dst, rel_type, row_number() OVER (PARTITION BY dst ORDER BY rel_type, src) AS rn FROM edge) WHERE rn = 1")
def win4(s, d):
    e = S.edges(s, d).withColumn("rank", F.struct("rel_type", "src"))
    return A.citations(e, "dst", "rank").select(F.col("dst").alias("doc_number"), "rel_type")


@register("win5_char_budget", "WITH c AS (SELECT doc_id, chunk_uid, sum(length(text)) OVER (PARTITION BY doc_id ORDER BY chunk_order) AS cum, chunk_order FROM chk), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY chunk_order) AS rn FROM c) SELECT chunk_uid, CAST(cum AS BIGINT) AS cum FROM r WHERE cum <= 2400 OR rn = 1")
def win5(s, d):
    return A.within_budget(S.chunks(s, d), "doc_id", "chunk_order", "text", 2400).select("chunk_uid", "cum")


@register("win6_span_selection", """WITH f AS (SELECT doc_id, chunk_uid, chunk_order, regexp_extract(lower(text), '\\b(th[a-z]*)\\b', 1) AS k FROM chk),
a AS (SELECT *, max(CASE WHEN k = 'the' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY chunk_order) AS on_ FROM f),
b AS (SELECT *, max(CASE WHEN on_ = 1 AND k <> '' AND k <> 'the' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY chunk_order) AS off_ FROM a)
SELECT chunk_uid FROM b WHERE on_ = 1 AND off_ = 0""")
def win6(s, d):
    key = F.regexp_extract(F.lower("text"), r"\b(th[a-z]*)\b", 1)
    return A.span(S.chunks(s, d), "doc_id", "chunk_order", key, "the").select("chunk_uid")


@register("str23_chunk_header", "SELECT c.chunk_uid, coalesce(nullif(concat_ws(' | ', coalesce(nullif(g.doc_number, ''), substr(nullif(g.title, ''), 1, 60)), nullif(c.chapter, '')), ''), 'N/A') AS header FROM chk c LEFT JOIN doc g ON g.doc_id = c.doc_id")
def str23(s, d):
    none = F.lit(None).cast("string")
    rows = S.chunks(s, d).join(S.documents(s, d).select("doc_id", "doc_number", "title"), "doc_id", "left")
    return rows.select("chunk_uid", T.chunk_header("doc_number", "title", "chapter", none, none).alias("header"))


@register("str24_context", f"WITH {HITS} SELECT string_agg('[' || rank || '] ' || chunk_uid || ' (score: ' || printf('%.3f', 1.0::DOUBLE / rank) || ')' || chr(10) || trim(text), chr(10) ORDER BY rank) AS context FROM h WHERE rank <= 5")
def str24(s, d):
    hits = _hits(s, d).where("rank <= 5").select("rank", F.col("chunk_uid").alias("header"), (F.lit(1.0) / F.col("rank")).alias("score"), F.trim("text").alias("text"))
    return A.context(hits)


@register("str25_related_context", "SELECT src AS query_id, string_agg(src || ' ' || CASE rel_type WHEN 'MENTIONS' THEN 'nhắc đến' WHEN 'REFERS_TO' THEN 'tham chiếu' ELSE lower(replace(rel_type, '_', ' ')) END || ' ' || dst, chr(10) ORDER BY rel_type, dst) AS context FROM (SELECT * FROM edge JOIN seed ON seed.id = src QUALIFY row_number() OVER (PARTITION BY src ORDER BY rel_type, dst) <= 20) GROUP BY src")
def str25(s, d):
    """The first twenty relations of each seed, a line each."""
    order = Window.partitionBy("src").orderBy("rel_type", "dst")
    rows = S.edges(s, d).join(S.seeds(s, d), F.col("src") == F.col("id")).withColumn("n", F.row_number().over(order)).where("n <= 20")
    told = rows.groupBy(F.col("src").alias("query_id")).agg(F.array_sort(F.collect_list(F.struct("n", F.concat_ws(" ", "src", T.relation_label("rel_type"), "dst").alias("line")))).alias("rows"))
    return told.select("query_id", F.array_join("rows.line", "\n").alias("context"))


@register("ret10_citations_with_titles", f"WITH {HITS} SELECT doc_id, title, n FROM (SELECT h.doc_id, count(*) AS n FROM h GROUP BY h.doc_id) x JOIN doc USING (doc_id)")
def ret10(s, d):
    n = _hits(s, d).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    return n.join(S.documents(s, d).select("doc_id", "title"), "doc_id").select("doc_id", "title", "n")
