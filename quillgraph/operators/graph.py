"""Property-graph operators over nodes and edges tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.io import stored


def merge_edges(relations: DataFrame, documents: DataFrame) -> DataFrame:
    """relations(source_doc_id, target_doc_number, relation_type, relation_source), documents(doc_id, doc_number)
    -> src, dst, dst_doc_id, rel_type, relation_type, relation_source: one edge a (src, rel_type, dst).

    The target is found by its number (every document that has it); a number without a
    document becomes a stub, dst_doc_id NULL.
    """
    named = relations.withColumn("rel_type", T.relation_name("relation_type"))
    found = named.join(documents.select(F.col("doc_id").alias("dst_doc_id"), F.col("doc_number").alias("target_doc_number")), "target_doc_number", "left")
    return found.groupBy(F.col("source_doc_id").alias("src"), "rel_type", F.col("target_doc_number").alias("dst"), "dst_doc_id").agg(
        F.max(F.struct("relation_type", "relation_source")).alias("p")
    ).select("src", "dst", "dst_doc_id", "rel_type", "p.relation_type", "p.relation_source")


#: Frontier nodes up to which they are sent to the edges; a larger frontier is joined by a shuffle.
BROADCAST_NODES = 10_000


def expand(edges: DataFrame, seeds: DataFrame, depth: int = 2, max_related: int | None = None) -> DataFrame:
    """edges(src, dst, rel_type), seeds(id) -> id, hop, rel_types, graph_score, from all seeds as one set."""
    return expand_many(edges, seeds.select(F.lit(0).alias("query_id"), "id"), depth, max_related).drop("query_id")


def expand_many(edges: DataFrame, seeds: DataFrame, depth: int = 2, max_related: int | None = None) -> DataFrame:
    """edges(src, dst, rel_type), seeds(query_id, id) -> query_id, id, hop, rel_types, graph_score: every question's traversal in one.

    Undirected, breadth first: one row a question and node, with its least hop count up to ``depth`` and, of its shortest
    paths, the types that order first. A shortest path meets no node or edge twice, so nodes met before are dropped
    from each round, and a hub costs a question one row however many paths lead to it. A question's seeds are no results of it. Each
    frontier is written before the next round reads it. ``max_related`` keeps the first by hop and id.
    """
    if depth < 1 or max_related is not None and max_related < 0:
        raise ValueError("depth must be 1 or more and max_related 0 or more")
    both = edges.select(F.col("src").alias("a"), F.col("dst").alias("b"), "rel_type").unionByName(edges.select(F.col("dst").alias("a"), F.col("src").alias("b"), "rel_type"))
    both = both.where("a is not null and b is not null")
    met = stored(seeds.select("query_id", "id").where("id is not null").distinct(), "seeds")
    frontier, rounds = met.withColumn("types", F.array().cast("array<string>")), []
    for hop in range(1, depth + 1):
        from_here = frontier.select("query_id", F.col("id").alias("a"), "types")
        if frontier.count() <= BROADCAST_NODES:
            from_here = F.broadcast(from_here)
        step = both.join(from_here, "a")
        step = step.groupBy("query_id", F.col("b").alias("id")).agg(F.min(F.concat("types", F.array("rel_type"))).alias("types"))
        frontier = step.join(met, ["query_id", "id"], "left_anti")
        if hop < depth:
            frontier = stored(frontier, "frontier")
            met = met.unionByName(frontier.select("query_id", "id"))
        rounds.append(frontier.select("query_id", "id", F.lit(hop).alias("hop"), F.col("types").alias("rel_types"), F.lit(round(1.0 / hop, 4)).alias("graph_score")))
    out = reduce(DataFrame.unionByName, rounds)
    if max_related is None:
        return out
    order = Window.partitionBy("query_id").orderBy("hop", "id")
    return out.withColumn("_rn", F.row_number().over(order)).where(F.col("_rn") <= max_related).drop("_rn")


def neighbours(edges: DataFrame, center: DataFrame) -> DataFrame:
    """One hop either way: center(id) -> center, relation, direction, other."""
    out = edges.join(center.select(F.col("id").alias("src")), "src").select(F.col("src").alias("center"), F.col("rel_type").alias("relation"), F.lit("out").alias("direction"), F.col("dst").alias("other"))
    into = edges.join(center.select(F.col("id").alias("dst")), "dst").select(F.col("dst").alias("center"), F.col("rel_type").alias("relation"), F.lit("in").alias("direction"), F.col("src").alias("other"))
    return out.unionByName(into).distinct()


def first_chunks(chunks: DataFrame, docs: DataFrame, n: int = 3) -> DataFrame:
    """The first n chunks of each document in docs(doc_id)."""
    order = Window.partitionBy("doc_id").orderBy("chunk_order")
    return chunks.join(docs, "doc_id").withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= n)


def locate(documents: DataFrame, number: str | None = None, name: str | None = None) -> DataFrame:
    """At most one document: exact number, or a title that contains the name; shortest title, then doc_id."""
    test = F.lit(False)
    if number:
        test |= F.col("doc_number") == number
    if name:
        test |= F.contains(F.lower(F.coalesce("title", F.lit(""))), F.lit(name.lower()))
    return documents.where(test).orderBy(F.length(F.coalesce("title", F.lit(""))), "doc_id").limit(1)


def degrees(edges: DataFrame) -> DataFrame:
    """id, out_degree, in_degree, degree, by one union and one aggregate."""
    ends = edges.select(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(edges.select(F.col("dst").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    return ends.groupBy("id").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"), F.sum(F.col("o") + F.col("i")).alias("degree"))
