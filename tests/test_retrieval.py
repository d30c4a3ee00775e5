"""Vector and keyword search: exact paths held against plain code."""

import math
import os
import random
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from conftest import SF  # noqa: E402

from quillgraph.operators import retrieval, vector_index  # noqa: E402
from quillgraph.sources.io import ship  # noqa: E402


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    ship(spark)


def plain_knn(corpus, queries, k, metric="cosine", threshold=None):
    """query -> its best ids, by loops."""
    out = {}
    for name, q in queries:
        hits = []
        for i, v in corpus:
            if v is None or q is None or len(v) != len(q) or not v or any(x is None or not math.isfinite(x) for x in [*v, *q]):
                continue
            dot = sum(a * b for a, b in zip(v, q))
            if metric == "cosine":
                size = math.sqrt(sum(a * a for a in v)) * math.sqrt(sum(b * b for b in q))
                score = dot / size if size else None
            else:
                score = dot if metric == "dot" else -math.sqrt(sum((a - b) ** 2 for a, b in zip(v, q)))
            if score is not None and (threshold is None or score >= threshold):
                hits.append((-round(score, 6), i))
        out[name] = [i for _, i in sorted(hits)[:k]]
    return {n: ids for n, ids in out.items() if ids}


NAN, INF = float("nan"), float("inf")
MIXED = [(i, [float(i % 3), float(i % 5)]) for i in range(6)] + [(10 + i, [float(i), 1.0, -1.0]) for i in range(5)] + [(20, None), (21, []), (22, [NAN, 1.0]), (23, [INF, 0.0]), (24, [None, 1.0]), (25, [0.0, 0.0]), (26, [0.0, 0.0, 0.0, 1.0])]
ASKED = [(1, [1.0, 2.0]), (2, [1.0, 0.0, 0.5]), (3, [NAN, 0.0]), (4, None), (5, []), (6, [0.0, 0.0]), (7, [1.0, 1.0, 1.0, 1.0]), (8, [2.0, None])]


@pytest.mark.parametrize("metric", ["cosine", "dot", "euclid"])
@pytest.mark.parametrize("bytes_held", [1 << 20, 8])
def test_every_width_in_one_block_or_many(spark, monkeypatch, metric, bytes_held):
    monkeypatch.setattr(retrieval, "QUERY_BYTES", bytes_held)
    corpus = spark.createDataFrame(MIXED, "id long, vector array<double>").repartition(3)
    queries = spark.createDataFrame(ASKED, "query_id long, query_vector array<double>")
    got = {}
    for r in retrieval.knn(corpus, queries, 3, metric=metric).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.id)
    assert got == plain_knn(MIXED, ASKED, 3, metric)
    assert got.keys() >= {1, 2, 7}


def rows_of(df):
    return sorted((r.query_id, r.id, r["rank"], round(r.score, 9)) for r in df.collect())


@pytest.mark.parametrize("metric", ["cosine", "euclid"])
def test_index_equals_the_scan(spark, tmp_path, monkeypatch, metric):
    rng = np.random.default_rng(5)
    groups = rng.normal(size=(12, 8)) * 4
    rows = [(int(i), [float(x) for x in groups[i % 12] + rng.normal(size=8)], int(i % 7)) for i in range(900)]
    rows += [(1000 + i, v, 0) for i, (_, v) in enumerate(MIXED)] + [(2000 + i, rows[5][1], 1) for i in range(9)]  # ties
    corpus = spark.createDataFrame(rows, "id long, vector array<double>, label int").repartition(4)
    path = str(tmp_path / "index")
    vector_index.build(corpus, path, metric, cells=20, sample=300)
    assert vector_index.read_rows(spark, path).where("vector is not null").count() == len([r for r in rows if r[1]])
    queries = corpus.where("id % 50 = 0").select(F.col("id").alias("query_id"), F.col("vector").alias("query_vector")).unionByName(spark.createDataFrame(ASKED, "query_id long, query_vector array<double>"))
    for k, threshold in ((5, None), (12, 0.4 if metric == "cosine" else -3.0), (2000, None)):
        whole = rows_of(retrieval.knn(corpus, queries, k, threshold, metric))
        assert rows_of(vector_index.search(spark, path, queries, k, threshold)) == whole and whole
    assert rows_of(vector_index.search(spark, path, queries, 4, filters={"label": 3})) == rows_of(retrieval.knn(corpus, queries, 4, metric=metric, filters={"label": 3}))
    read = vector_index.cells_read(spark, path, queries, 5).agg(F.sum("cells").alias("c"), F.sum("of_cells").alias("o"), F.sum("rows").alias("r"), F.sum("of_rows").alias("n")).first()
    assert read.c < 0.5 * read.o and read.r < 0.5 * read.n
    monkeypatch.setattr(retrieval, "QUERY_BYTES", 8 * 8 * 5)
    assert rows_of(vector_index.search(spark, path, queries, 5)) == rows_of(retrieval.knn(corpus, queries, 5, metric=metric))


def test_index_of_few_rows(spark, tmp_path):
    schema = "id long, vector array<double>"
    for i, rows in enumerate(([], [(1, None)], [(1, [0.0, 0.0])], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [1.0, 2.0])])):
        corpus, path = spark.createDataFrame(rows, schema), str(tmp_path / f"i{i}")
        vector_index.build(corpus, path)
        queries = spark.createDataFrame([(9, [2.0, 1.0]), (8, [1.0])], "query_id long, query_vector array<double>")
        assert rows_of(vector_index.search(spark, path, queries, 3)) == rows_of(retrieval.knn(corpus, queries, 3))
    with pytest.raises(ValueError):
        vector_index.build(corpus, path, "dot")


# ---- postings in blocks


def chunks_of(n, seed=1):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(30)]
    return [(f"c{i:04}", f"d{i % 9}", " ".join(rng.choices(words, [1 / (j + 1) for j in range(30)], k=rng.choice([1, 3, 8, 20, 60])))) for i in range(n)] + [("n", "d", None), ("e", "d", ""), ("t1", "d", "w3 w4"), ("t2", "d", "w3 w4")]


def plain_bm25(rows, terms):
    import re
    from collections import Counter

    said = {i: Counter(re.findall(r"\w+", (t or "").lower())) for i, _, t in rows}
    n, mean = len(said), sum(sum(c.values()) for c in said.values()) / len(said)
    out = {}
    for t in dict.fromkeys(terms):
        df = sum(1 for c in said.values() if c[t])
        for i, c in said.items():
            if c[t]:
                dl = sum(c.values())
                out[i] = out.get(i, 0) + math.log(1 + (n - df + 0.5) / (df + 0.5)) * c[t] * 2.2 / (c[t] + 1.2 * (0.25 + 0.75 * dl / mean))
    return out


@pytest.mark.parametrize("segment", [1, 4, 64])
def test_blocks_equal_the_scan(spark, tmp_path, segment):
    from quillgraph.operators import postings

    rows = chunks_of(400)
    chunks = spark.createDataFrame(rows, "chunk_uid string, doc_id string, chunk_text string").repartition(5)
    path = str(tmp_path / "index")
    postings.build(chunks, path, carry=("doc_id",), segment=segment, buckets=7)
    asked = [(1, ["w0", "w1"]), (2, ["w3", "w25", "w3"]), (3, ["absent"]), (4, ["w29", "absent"]), (5, []), (6, None), (7, ["w0", "w9", "w17", None])]
    questions = spark.createDataFrame(asked, "query_id long, terms array<string>")
    for k in (1, 5, 1000):
        got = {}
        for r in postings.search(spark, path, questions, k, ("doc_id",)).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append((r.id, r.doc_id, round(r.score, 6)))
        docs = {i: d for i, d, _ in rows}
        want = {q: [(i, docs[i], round(s, 6)) for i, s in sorted(plain_bm25(rows, [t for t in terms or [] if t]).items(), key=lambda x: (-round(x[1], 6), x[0]))[:k]] for q, terms in asked}
        assert got == {q: hits for q, hits in want.items() if hits}
    assert {r.query_id: r.n for r in postings.matching(spark, path, questions).collect()} == {q: len(plain_bm25(rows, [t for t in terms or [] if t])) for q, terms in asked if plain_bm25(rows, [t for t in terms or [] if t])}
    if segment == 4:
        read = {r.query_id: r.postings / r.of_postings for r in postings.postings_read(spark, path, questions, 1).collect()}
        assert read[1] < 0.4 and read[2] < 0.4


def test_blocks_of_an_empty_table(spark, tmp_path):
    from quillgraph.operators import postings

    path = str(tmp_path / "none")
    postings.build(spark.createDataFrame([], "chunk_uid string, chunk_text string"), path)
    assert postings.search(spark, path, spark.createDataFrame([(1, ["a"])], "query_id long, terms array<string>"), 3).count() == 0
