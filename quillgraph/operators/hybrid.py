"""Vector, keyword and graph search as one plan, for one question or a table of them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.config import check_search
from ..sources.io import scratch_path, stored
from . import graph as G
from . import postings as P
from . import retrieval as R

MAX_SEEDS = 20


@dataclass(frozen=True)
class Corpus:
    """gold(chunk_uid, doc_id, chunk_order, vector, and the searched ``text``), documents(doc_id, ...), edges(edge_id, src, dst, rel_type) between doc_ids, the
    path of stored postings over gold's text, if there are any, and vectors(chunk_uid, vector, and what filters name) where gold holds none."""

    gold: DataFrame
    documents: DataFrame
    edges: DataFrame
    text: str = "text"
    index: str | None = None
    vectors: DataFrame | None = None


def search(corpus: Corpus, query_vector: list[float], terms: list[str], top_k: int = 5, alpha: float = 0.7, threshold: float | None = 0.3, filters: dict | None = None, doc_type: str | None = None, depth: int = 2, max_related: int | None = None, graph: bool = True) -> tuple[DataFrame, DataFrame]:
    """One question -> (hits: id, rrf_score, sources and the chunk's columns, best first; one row of counts). See ``search_many``."""
    spark = corpus.gold.sparkSession
    one = spark.createDataFrame([(0, [float(x) for x in query_vector], terms)], "query_id int, query_vector array<double>, terms array<string>")
    hits, stats = search_many(corpus, one, top_k, alpha, threshold, filters, doc_type, depth, max_related, graph)
    return hits.drop("query_id").orderBy("position").drop("position"), stats.drop("query_id")


def search_many(corpus: Corpus, questions: DataFrame, top_k: int = 5, alpha: float = 0.7, threshold: float | None = 0.3, filters: dict | None = None, doc_type: str | None = None, depth: int = 2, max_related: int | None = None, graph: bool = True) -> tuple[DataFrame, DataFrame]:
    """questions(query_id, query_vector, terms) -> (hits: query_id, position, id, rrf_score, sources and the chunk's columns; a row of counts
    a question). One plan answers all of them.

    Each source gives a question 2 * top_k. Its traversal starts from at most ``MAX_SEEDS`` documents of its vector
    hits and gives the first three chunks of each document it reaches; a question without such chunks drops the graph's
    weight and keeps the others as they are. Words are looked up in ``corpus.index`` if there is one, which covers all
    chunks; a ``doc_type`` needs an index of its own, built here, as do chunks without one. Out of range requests raise.
    """
    check_search(top_k=top_k, alpha=alpha, depth=depth, top_k_graph=max_related)
    spark = corpus.gold.sparkSession
    vectors = (corpus.gold if corpus.vectors is None else corpus.vectors).where("vector is not null").withColumnRenamed("chunk_uid", "id")
    lists = [R.ranked(R.knn(vectors, questions, 2 * top_k, threshold, filters=filters), "vector", 0)]
    index = corpus.index
    if doc_type is not None or index is None:
        searched = corpus.gold if doc_type is None else corpus.gold.join(corpus.documents.where(F.col("doc_type") == doc_type).select("doc_id"), "doc_id", "left_semi")
        P.build(searched, index := scratch_path(spark, "postings"), "chunk_uid", corpus.text)
    said = P.search(spark, index, questions, 2 * top_k)
    said = said.withColumn("score", F.col("score") / F.max("score").over(Window.partitionBy("query_id")))  # 2 * top_k rows; BM25 is positive
    lists.append(R.ranked(said, "keyword", 1))
    lists = [stored(x, "list") for x in lists]
    if graph:
        place = corpus.gold.select(F.col("chunk_uid").alias("id"), "doc_id", "chunk_order")
        seeds = place.join(F.broadcast(lists[0]), "id") if _few(lists[0]) else place.join(lists[0], "id")
        by_rank = Window.partitionBy("query_id").orderBy("r")
        seeds = seeds.groupBy("query_id", "doc_id").agg(F.min("rank").alias("r")).withColumn("n", F.row_number().over(by_rank)).where(F.col("n") <= MAX_SEEDS)
        reached = stored(G.expand_many(corpus.edges, seeds.select("query_id", F.col("doc_id").alias("id")), depth, 2 * top_k if max_related is None else max_related), "reached").withColumnRenamed("id", "doc_id")
        docs = reached.select("doc_id").distinct()
        found = G.first_chunks(place, F.broadcast(docs) if _few(reached) else docs).join(reached, "doc_id")
        order = Window.partitionBy("query_id").orderBy("hop", "doc_id", "chunk_order")
        tied = found.select("query_id", "id", F.col("graph_score").alias("score"), F.lit("graph").alias("source"), F.lit(2).alias("list_idx"), F.row_number().over(order).alias("rank"))
        lists.append(stored(tied, "list"))
    weights: list = list(R.fusion_weights(alpha, False)[:2])
    if graph:
        whole, tied = R.fusion_weights(alpha, True), lists[2].select("query_id").distinct().withColumn("_tied", F.lit(True))
        lists[:2] = [x.join(tied, "query_id", "left") for x in lists[:2]]
        weights = [F.when(F.col("_tied"), F.lit(a)).otherwise(F.lit(b)) for a, b in zip(whole, weights)] + [whole[2]]
    fused = R.rrf(lists, weights)
    order = Window.partitionBy("query_id").orderBy(F.col("rrf_score").desc(), "first_list", "first_rank")
    best = stored(fused.withColumn("position", F.row_number().over(order)).where(F.col("position") <= top_k), "best")
    hits = corpus.gold.drop("vector").withColumnRenamed("chunk_uid", "id").join(F.broadcast(best) if _few(best) else best, "id")
    stats = fused.groupBy("query_id").agg(F.count(F.lit(1)).alias("total_unique"), *[F.count_if(F.array_contains("sources", name)).alias(f"{name}_count") for name in ("vector", "keyword", "graph")[: len(lists)]])
    return hits, stats.withColumn("alpha", F.lit(alpha))


#: Rows of a list, ids and ranks, up to which it is broadcast.
FEW = 100_000


def _few(rows: DataFrame) -> bool:
    return rows.count() <= FEW
