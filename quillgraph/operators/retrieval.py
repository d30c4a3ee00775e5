"""Vector search, keyword search, rank fusion and their composition."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vector as V

K1, B = 1.2, 0.75
RRF_K = 60
#: Hits that one ranked list holds.
MAX_LIST = 10_000
#: Bytes of query vectors that are sent to every task at once; more go in blocks of about this size.
QUERY_BYTES = 32 << 20
#: Scores computed at a time in a task; what it holds beside its batch is some ten times their bytes, whatever the number of queries.
SCORES = 500_000
#: Words that a task counts at a time.
WORDS = 2_000_000


def payload_filter(columns: list[str], filters: dict) -> Column:
    """Equality, or a range as {"gte","lte","gt","lt"}; AND-ed. An unknown field raises."""
    out = F.lit(True)
    ops = {"gte": Column.__ge__, "lte": Column.__le__, "gt": Column.__gt__, "lt": Column.__lt__}
    for field, wanted in filters.items():
        if field not in columns:
            raise ValueError(f"no such payload field: {field}")
        if isinstance(wanted, dict):
            for op, value in wanted.items():
                out &= ops[op](F.col(field), value)
        else:
            out &= F.col(field) == wanted
    return out


def knn(corpus: DataFrame, queries: DataFrame, k: int, threshold: float | None = None, metric: str = "cosine", filters: dict | None = None) -> DataFrame:
    """corpus(id, vector, ...), queries(query_id, query_vector) -> query_id, id, score, rank.

    Exact: filters reach the scan, then each query scores every row of its width. Scores are rounded to six digits for the
    order, ties go to the least id. Each task keeps its best ``k`` of a batch, and a ranked window merges
    them. Vectors that are null, empty or, for cosine, zero, that hold a null, NaN or infinity, and pairs of unlike widths
    have no score and are left out.
    """
    if k < 1:
        raise ValueError("k must be 1 or more")
    return best_of(similar(corpus, queries, threshold, metric, filters, k), k)


def best_of(scored: DataFrame, k: int) -> DataFrame:
    """scored(query_id, id, score, key) -> query_id, id, score, rank of each query's best ``k``."""
    order = Window.partitionBy("query_id").orderBy(F.col("key").desc(), "id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("key")


def blocks_of(queries: DataFrame) -> list[DataFrame]:
    """queries(query_id, query_vector), vectors as doubles, in blocks of about ``QUERY_BYTES``; their bytes are counted."""
    asked = queries.select("query_id", F.col("query_vector").cast("array<double>").alias("query_vector")).where("query_vector is not null and size(query_vector) > 0")
    held = asked.agg(F.coalesce(F.sum(F.size("query_vector")), F.lit(0))).first()[0]
    n = max(1, -(-8 * held // QUERY_BYTES))
    block = F.pmod(F.xxhash64("query_id", "query_vector"), F.lit(n))
    return [asked if n == 1 else asked.where(block == i) for i in range(n)]


def similar(corpus: DataFrame, queries: DataFrame, threshold: float | None = None, metric: str = "cosine", filters: dict | None = None, k: int | None = None) -> DataFrame:
    """query_id, id, score, key (the score rounded) of every pair, or of the best ``k`` of each batch.

    Blocks of queries, a matrix a width, are broadcast in turn; each task multiplies its rows with those of their width.
    """
    if filters:
        corpus = corpus.where(payload_filter(corpus.columns, filters))
    rows = corpus.select("id", F.col("vector").cast("array<double>").alias("vector")).where("vector is not null")
    return reduce(DataFrame.unionByName, [_by_matrix(rows, block, threshold, V.name_of(metric), k) for block in blocks_of(queries)])


def matrices(names: pa.Array, vectors: pa.Array) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """Lists of numbers as matrices, one a width, with the names of their rows."""
    vectors = vectors if isinstance(vectors, pa.Array) else vectors.combine_chunks()
    widths = pc.list_value_length(vectors).to_numpy(zero_copy_only=False)
    for width in np.unique(widths[widths > 0]) if len(widths) else ():
        own = widths == width
        held = vectors if own.all() else vectors.filter(pa.array(own))
        yield (names if own.all() else names.filter(pa.array(own))), np.asarray(held.flatten().to_numpy(zero_copy_only=False), float).reshape(-1, int(width))


def best_pairs(v: np.ndarray, ids: pa.Array, q: np.ndarray, metric: str, threshold: float | None, k: int | None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Places of rows and of queries, scores and rounded scores of the pairs to keep: all, or each query's best ``k``."""
    step, place = max(1, SCORES // max(1, len(v))), None
    for at in range(0, len(q), step):
        scores = V.scores(v, q[at : at + step], metric)
        keys = np.floor(np.abs(scores) * 1e6 + 0.5) * np.sign(scores) / 1e6
        kept = np.isfinite(scores)
        if threshold is not None:
            kept &= scores >= threshold
        if k is not None and len(v) > k:  # no row under a query's k-th score is looked at again
            held = np.where(kept, keys, -np.inf)
            kept &= keys >= np.partition(held, len(v) - k, axis=0)[len(v) - k]
        x, y = np.nonzero(kept)
        if k is not None and len(x):
            place = np.argsort(np.argsort(ids.to_numpy(zero_copy_only=False), kind="stable"), kind="stable") if place is None else place  # ties: least id
            order = np.lexsort((place[x], -keys[x, y], y))
            x, y = x[order], y[order]
            first = np.flatnonzero(np.concatenate([[True], y[1:] != y[:-1]]))
            rank = np.arange(len(y)) - np.repeat(first, np.diff(np.append(first, len(y))))
            x, y = x[rank < k], y[rank < k]
        yield x, y + at, scores[x, y], keys[x, y]


def _by_matrix(rows: DataFrame, asked: DataFrame, threshold: float | None, metric: str, k: int | None) -> DataFrame:
    table, by_width = asked.toArrow(), {}  # about QUERY_BYTES
    for names, matrix in matrices(table.column("query_id").combine_chunks(), table.column("query_vector")):
        width = matrix.shape[1]
        matrix, sound = V.prepared(matrix, metric)
        by_width[width] = names.filter(pa.array(sound)), matrix[sound]
    shared = rows.sparkSession.sparkContext.broadcast(by_width)
    kinds = {f.name: f.dataType.simpleString() for f in [asked.schema["query_id"], rows.schema["id"]]}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        for batch in batches:
            for ids, v in matrices(batch.column("id"), batch.column("vector")):
                names, q = held.get(v.shape[1], (None, ()))
                if not len(q):
                    continue
                v, sound = V.prepared(v, metric)
                ids, v = ids.filter(pa.array(sound)), v[sound]
                for x, y, scores, keys in best_pairs(v, ids, q, metric, threshold, k):
                    yield pa.RecordBatch.from_arrays([names.take(pa.array(y)), ids.take(pa.array(x)), pa.array(scores), pa.array(keys)], names=["query_id", "id", "score", "key"])

    return rows.mapInArrow(run, f"query_id {kinds['query_id']}, id {kinds['id']}, score double, key double")


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """words -> dl, terms, tfs: each row's distinct words and how often they stand."""
    for batch in batches:
        sizes = pc.list_value_length(batch.column("words")).to_numpy(zero_copy_only=False).astype(np.int64)
        block = np.cumsum(sizes) // WORDS
        for lo, hi in _runs(block):
            part, dl = batch.slice(lo, hi - lo), sizes[lo:hi]
            coded = part.column("words").flatten().dictionary_encode()
            width = max(1, len(coded.dictionary))
            keys, tfs = np.unique(np.repeat(np.arange(hi - lo), dl) * width + coded.indices.to_numpy(), return_counts=True)
            ends = pa.array(np.searchsorted(keys, np.arange(hi - lo + 1) * width).astype(np.int32))
            terms = pa.ListArray.from_arrays(ends, coded.dictionary.take(pa.array(keys % width)))
            names = [n for n in part.schema.names if n != "words"]
            yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), pa.array(dl.astype(np.int32)), terms, pa.ListArray.from_arrays(ends, pa.array(tfs.astype(np.int32)))], names=[*names, "dl", "terms", "tfs"])


def _runs(keys: np.ndarray) -> list[tuple[int, int]]:
    """Bounds of the runs of equal keys."""
    edges = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]])) if len(keys) else np.zeros(1, int)
    return list(zip(edges[:-1].tolist(), edges[1:].tolist()))


def postings(chunks: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Term frequencies and lengths: id, term, tf, dl. Tasks count; nothing moves. Ids are distinct."""
    said = chunks.select(F.col(id_col).alias("id"), T.words(text_col).alias("words"))
    counts = said.mapInArrow(counted, f"id {said.schema['id'].dataType.simpleString()}, dl int, terms array<string>, tfs array<int>")
    return counts.select("id", "dl", F.inline(F.arrays_zip(F.col("terms").alias("term"), F.col("tfs").alias("tf")))).select("id", "dl", "term", F.col("tf").cast("long").alias("tf"))


def bucket_of(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def write_postings(chunks: DataFrame, path: str, id_col: str = "chunk_uid", text_col: str = "chunk_text", buckets: int = 64) -> None:
    """The full-text index as files: postings by term bucket, sorted by term so that a search skips row groups, and one row of statistics."""
    said = chunks.select(F.size(T.words(text_col)).alias("dl"))
    said.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"), F.lit(buckets).alias("buckets")).write.mode("overwrite").parquet(f"{path}/stats")
    rows = postings(chunks, id_col, text_col).withColumn("bucket", bucket_of(F.col("term"), buckets))
    # A frequent term's list is split by id; sorted files keep each term's postings together.
    rows.repartition("bucket", F.pmod(F.xxhash64("id"), F.lit(4))).sortWithinPartitions("bucket", "term", "id").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")


def search_postings(spark: SparkSession, path: str, terms: list[str], k1: float = K1, b: float = B) -> DataFrame:
    """OR query over a stored index: id, score. Only the asked terms' buckets and row groups are read."""
    stats = spark.read.parquet(f"{path}/stats").first()
    terms = list(dict.fromkeys(terms))
    asked = spark.createDataFrame([(t,) for t in terms], "term string").select("term", bucket_of(F.col("term"), stats.buckets).alias("bucket")).collect()  # the asked terms
    rows = spark.read.parquet(f"{path}/postings").where(F.col("bucket").isin([r.bucket for r in asked]) & F.col("term").isin(terms))
    df = rows.groupBy("term").agg(F.count(F.lit(1)).alias("df"))  # a row an asked term
    part = _idf(F.lit(stats.n), F.col("df")) * _tf_part(F.col("tf"), F.col("dl"), F.lit(stats.avgdl), k1, b)
    return rows.join(F.broadcast(df), "term").groupBy("id").agg(F.sum(part).alias("score"))


def _idf(n: Column, df: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def _tf_part(tf: Column, dl: Column, avgdl: Column, k1: float, b: float) -> Column:
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl))


def bm25(chunks: DataFrame, terms: list[str], id_col: str = "chunk_uid", text_col: str = "chunk_text", k1: float = K1, b: float = B, carry: tuple[str, ...] = ()) -> DataFrame:
    """OR query: id, score, and the columns of ``carry``. Only words that were asked for move, counted a chunk;
    the statistics come from a pass of their own that reads the text column only. Ids are distinct."""
    terms = list(dict.fromkeys(terms))
    words = chunks.select(T.words(text_col).alias("words"))
    has = lambda t: F.array_contains("words", t)
    stats = words.agg(F.count(F.lit(1)).alias("n"), F.avg(F.size("words")).alias("avgdl"), *[F.count_if(has(t)).alias(f"df{i}") for i, t in enumerate(terms)]).first()
    said = chunks.select(F.col(id_col).alias("id"), *carry, T.words(text_col).alias("words")).withColumn("dl", F.size("words"))
    said = said.select("id", *carry, "dl", F.explode("words").alias("term")).where(F.col("term").isin(terms))
    counted = said.groupBy("id", *carry, "dl").agg(*[F.count_if(F.col("term") == t).alias(f"tf{i}") for i, t in enumerate(terms)])
    total = F.lit(0.0)
    for i in range(len(terms)):
        idf = F.log(F.lit(1 + (stats.n - stats[f"df{i}"] + 0.5) / (stats[f"df{i}"] + 0.5)))
        total = total + F.when(F.col(f"tf{i}") > 0, idf * _tf_part(F.col(f"tf{i}"), F.col("dl"), F.lit(stats.avgdl), k1, b)).otherwise(0.0)
    return counted.select("id", *carry, total.alias("score"))


def max_normalized(hits: DataFrame, score: str = "score") -> DataFrame:
    """Scores over the largest; zero when that isn't positive. The largest is one row, found by a partial aggregate."""
    top = hits.agg(F.max(score).alias("_top"))
    return hits.join(F.broadcast(top), F.lit(True)).withColumn(score, F.when(F.col("_top") > 0, F.col(score) / F.col("_top")).otherwise(0.0)).drop("_top")


def top(hits: DataFrame, k: int, score: str = "score", tie: str = "id") -> DataFrame:
    """Best k by the score rounded to six digits, then the tie column: a partial top-k a task."""
    return hits.orderBy(F.round(score, 6).desc_nulls_last(), tie).limit(k)


def ranked(hits: DataFrame, source: str, list_idx: int, k: int = MAX_LIST) -> DataFrame:
    """hits(id, score) -> id, score, source, list_idx, rank (1-based) of the best ``k``; with a query_id, of each question."""
    by = [c for c in ("query_id",) if c in hits.columns]
    best = hits.select(*by, "id", "score") if by else top(hits.select("id", "score"), k)
    order = Window.partitionBy(*by, "list_idx").orderBy(F.round("score", 6).desc(), "id")
    best = best.select(*by, "id", "score", F.lit(source).alias("source"), F.lit(list_idx).alias("list_idx"))
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def rrf(lists: list[DataFrame], weights: list[float | Column] | None = None, k: int = RRF_K) -> DataFrame:
    """Ranked lists -> id, rrf_score, first_list, first_rank, sources; best first. Lists with a query_id are fused for each question.

    Default weights are equal; a weight may be a column of its list. Ties keep insertion order: list, then rank.
    """
    weights = weights or [1.0 / len(lists)] * len(lists)
    by = [c for c in ("query_id",) if c in lists[0].columns]
    parts = []
    for w, hits in zip(weights, lists):
        part = (w if isinstance(w, Column) else F.lit(float(w))) / (k + F.col("rank"))
        parts.append(hits.select(*by, "id", "list_idx", "rank", "source", part.alias("part")))
    fused = reduce(DataFrame.unionByName, parts).groupBy(*by, "id").agg(
        F.round(F.sum("part"), 6).alias("rrf_score"),
        F.min(F.struct("list_idx", "rank")).alias("first"),
        F.array_sort(F.collect_set(F.struct("list_idx", "source"))).alias("sources"),
    )
    return fused.select(*by, "id", "rrf_score", F.col("first.list_idx").alias("first_list"), F.col("first.rank").alias("first_rank"), F.col("sources.source").alias("sources"))


def fusion_weights(alpha: float, graph: bool) -> list[float]:
    """Vector, keyword and graph weights; normalised only when the graph list is in play."""
    out = [alpha, 0.6 * (1 - alpha), 0.4 * (1 - alpha)]
    return [w / sum(out) for w in out] if graph else out
