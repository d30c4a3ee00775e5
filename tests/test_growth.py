"""What moves, and what a task holds, grows no faster than the input."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from quillgraph.sources.io import ship  # noqa: E402


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    ship(spark)


def test_a_search_writes_a_row_a_question(spark, tmp_path, monkeypatch):
    """Not one for each question and segment."""
    from quillgraph.operators import postings

    chunks = spark.createDataFrame([(f"c{i:03}", "the " * (1 + i % 9) + f"w{i % 50}") for i in range(400)], "chunk_uid string, chunk_text string")
    postings.build(chunks, path := str(tmp_path / "index"), segment=4)
    questions = spark.createDataFrame([(i, ["the", f"w{i}"]) for i in range(60)], "query_id long, terms array<string>")
    written, stored = [], postings.stored

    def counted(rows, name):
        written.append((out := stored(rows, name)).count())
        return out

    monkeypatch.setattr(postings, "stored", counted)
    hits = postings.search(spark, path, questions, 3).collect()
    assert len(hits) == 180 and sum(written) <= 60
    monkeypatch.setattr(postings, "QUESTION_BYTES", 200)  # the same in many blocks of questions
    assert sorted(postings.search(spark, path, questions, 3).collect()) == sorted(hits)


def test_index_is_built_without_a_shuffle(spark, tmp_path):
    from quillgraph.operators import retrieval

    chunks = spark.createDataFrame([("a", "x y x"), ("b", None)], "chunk_uid string, chunk_text string")
    rows = retrieval.postings(chunks, "chunk_uid", "chunk_text")
    assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, rows.select("id", "term", "tf", "dl").collect())) == [("a", "x", 2, 3), ("a", "y", 1, 3)]


def test_knn_holds_no_more_with_more_queries():
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    from quillgraph.operators import retrieval

    rng = np.random.default_rng(3)
    v, ids, q = rng.normal(size=(5000, 8)), pa.array(range(5000)), rng.normal(size=(800, 8))
    for metric in ("dot", "manhattan"):
        tracemalloc.start()
        n = sum(len(x) for x, _, _, _ in retrieval.best_pairs(v, ids, q, metric, None, 3))
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert n == 2400 and most < 60 << 20


def test_chunker_hands_on_before_a_batch_ends(spark, monkeypatch):
    from quillgraph.functions import chunker

    docs = spark.createDataFrame([(f"d{i}", "n", "t", "a b c.\n" * 50) for i in range(40)], "doc_id string, doc_number string, doc_title string, content_text string").coalesce(1)
    whole = sorted(map(tuple, chunker.chunk_documents(docs).select("chunk_uid", "chunk_text", "token_count").collect()))
    assert chunker.HELD <= 2_000_000
    monkeypatch.setattr(chunker, "HELD", 400)
    assert sorted(map(tuple, chunker.chunk_documents(docs).select("chunk_uid", "chunk_text", "token_count").collect())) == whole and len(whole) == 40


def test_embedding_hands_on_before_a_batch_ends(spark, monkeypatch):
    import pyarrow as pa

    from quillgraph.operators import etl

    chunks, caught = spark.createDataFrame([("c", "t")], "chunk_uid string, chunk_text string"), []
    monkeypatch.setattr(type(chunks), "mapInArrow", lambda self, run, schema: caught.append(run))
    etl.gold(chunks, lambda texts: [[float(len(t))] for t in texts], batch=8)
    rows = pa.RecordBatch.from_pydict({"chunk_uid": [f"c{i}" for i in range(20)], "chunk_text": [None] + ["t"] * 19})
    out = list(caught[0](iter([rows])))
    assert [b.num_rows for b in out] == [8, 8, 4] and out[0].column("embedding").to_pylist()[:2] == [[0.0], [1.0]]


def test_lookup_moves_no_text(spark):
    from quillgraph.operators import lookup

    names = spark.createDataFrame([(1, "abc"), (2, "a long name that ends so"), (1, "b")], "key long, name string")
    texts = spark.createDataFrame([(9, "xx ABC"), (8, "abcabc"), (7, "A long name that ends so, it says"), (6, None)], "id long, text string")
    found = lookup.shortest(names, texts)
    assert "text" not in [c for line in found._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange" in line for c in line.split()]
    assert sorted(map(tuple, found.collect())) == [(1, 8), (2, 7)]


def test_answers_of_every_turn_and_case(spark):
    from quillgraph.plans import catalog, surrogates
    from conftest import SF

    assert catalog.QUERIES["ret11_answers"](spark, SF).count() == 3 * surrogates.raw(spark, SF, "conversations").count()
    assert {r.step: r.n for r in catalog.QUERIES["snk4_schema_and_truncate"](spark, SF).collect()}["absent"] == -1
    e = surrogates.raw(spark, SF, "embeddings")
    assert catalog.QUERIES["join17_query_by_corpus"](spark, SF).count() == e.where("label = 1").count() * e.where("vec_id % 100 = 0").count()


def moved(spark, query, d, out):
    """Bytes shuffled by a query over the tables in ``d``, its index included."""
    store = spark.sparkContext._jsc.sc().statusStore()
    bus, total = spark.sparkContext._jsc.sc().listenerBus(), []
    for run in (lambda: None, lambda: query(spark, d).write.parquet(out)):
        run()
        bus.waitUntilEmpty(30_000)
        held = store.executorList(False)
        total.append(sum(held.apply(i).totalShuffleWrite() for i in range(held.size())))
    return total[1] - total[0]


@pytest.mark.parametrize("name", ["win1_rank_in_list", "agg11_weighted_sum", "srt10_fused_order", "join18_rank_fusion", "mth3_reciprocal_rank", "mth4_fusion_weights"])
def test_fused_lists_move_no_words(spark, tmp_path, name):
    """Chunks of fifty more words each move as much as before: neither index nor lists shuffle postings."""
    from pyspark.sql import functions as F

    from conftest import SF
    from quillgraph.plans import catalog, surrogates

    docs, vectors = surrogates.raw(spark, SF, "documents"), surrogates.raw(spark, SF, "embeddings")
    more = F.concat(F.lit(" "), F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(50)), lambda i: F.concat(F.lit("q"), F.col("doc_id").cast("string"), F.lit("x"), i.cast("string")))))
    longer = docs.withColumn("text", F.array_join(F.transform(F.split("text", "\n"), lambda x: F.when(F.trim(x) != "", F.concat(x, more)).otherwise(x)), "\n"))
    bytes_moved = {}
    for kind, rows in (("short", docs), ("long", longer)):
        rows.write.parquet(f"{tmp_path}/{kind}/documents.parquet")
        vectors.write.parquet(f"{tmp_path}/{kind}/embeddings.parquet")
        bytes_moved[kind] = moved(spark, catalog.QUERIES[name], f"{tmp_path}/{kind}", f"{tmp_path}/out-{kind}")
    assert spark.read.parquet(f"{tmp_path}/out-long").count() > 0
    assert 0 < bytes_moved["long"] < 1.3 * bytes_moved["short"], bytes_moved
