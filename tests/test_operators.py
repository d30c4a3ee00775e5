import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from quillgraph.functions import embedding
from quillgraph.operators import answer, etl, graph, retrieval, tables
from quillgraph.sources import io
from quillgraph.streaming import state

CONTENT = "id string, content_html string, content string, title string"
META = "id string, title string, so_ky_hieu string, n int"


def test_auxiliary_maps(spark):
    content = spark.createDataFrame([(" 1", None, "", None), ("2", None, "x", "kept"), ("3", None, "y", "")], CONTENT)
    meta = spark.createDataFrame([("1", "old", "a", 1), ("1 ", "new", "b", 2), ("", "none", "c", 3), ("2", "other", "d", 4), ("3", "filled", "e", 5)], META)
    rows = {r.id: r for r in etl.with_auxiliary(content, meta, "n").collect()}
    assert rows["1"].title == "new" and rows["1"].content == "" and rows["1"].so_ky_hieu == "b"
    assert rows["2"].title == "kept" and rows["3"].title == ""
    rel = spark.createDataFrame([("1", "2", "cites", 1), ("1", "9", "amends", 2)], "doc_id string, other_doc_id string, relationship string, n int")
    got = etl.relation_lists(rel, meta, "n").first().relations
    assert [(x.target_so_ky_hieu, x.type) for x in got] == [("d", "cites"), ("", "amends")]


def test_etl_end_to_end(spark, tmp_path):
    raw = spark.createDataFrame([("1", "<p>Điều 1. Theo 45/2019/QH14</p>", None, "Luật A"), ("1", "<p>Điều 1. Theo 45/2019/QH14</p>", None, "Luật A"), (None, None, "tự do", None)], CONTENT)
    bronze = etl.bronze(raw)
    assert bronze.where("status = 'active'").count() == 3
    docs = etl.silver_documents(bronze)
    assert docs.count() == 2  # equal raw records are one
    chunks = etl.silver_chunks(docs)
    rel = etl.silver_relations(chunks).collect()
    assert [(r.source_doc_id, r.target_doc_number) for r in rel] == [("1", "45/2019/QH14")]
    gold = etl.gold(chunks, embedding.hashing_embedder(8), dim=8)
    io.append(gold, str(tmp_path / "gold"))
    done = spark.read.parquet(str(tmp_path / "gold"))
    assert done.count() == chunks.count() and etl.gold(chunks, embedding.hashing_embedder(8), done).count() == 0
    assert etl.bronze(raw, keywords=["luật"]).count() == 2 and etl.bronze(raw, cap=1).count() == 1


def test_keyed_tables(spark):
    cur = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k int, v string, ver int")
    new = spark.createDataFrame([(2, "c", 1), (3, "d", 1)], "k int, v string, ver int")
    out = tables.upsert(cur, new, ["k"], "ver")
    assert sorted((r.k, r.v) for r in out.collect()) == [(1, "a"), (2, "c"), (3, "d")]
    assert sorted((r.k, r.v) for r in tables.insert_absent(cur, new, ["k"]).collect()) == [(1, "a"), (2, "b"), (3, "d")]


def test_graph_edges_and_paths(spark):
    docs = spark.createDataFrame([("a", "N1"), ("b", "N2"), ("c", "N2")], "doc_id string, doc_number string")
    rel = spark.createDataFrame([("a", "N2", " ", "x"), ("a", "N2", "", "y"), ("a", "N9", "sửa đổi", "x")], "source_doc_id string, target_doc_number string, relation_type string, relation_source string")
    edges = graph.merge_edges(rel, docs).collect()
    assert sorted((e.dst, e.dst_doc_id or "", e.rel_type) for e in edges) == [("N2", "b", "REFERS_TO"), ("N2", "c", "REFERS_TO"), ("N9", "", "SỬA_ĐỔI")]
    e = spark.createDataFrame([(1, "s", "s", "L"), (2, "s", "x", "A"), (3, "s", "x", "B"), (4, "x", "y", "C"), (5, "y", "t", "D")], "edge_id long, src string, dst string, rel_type string")
    got = {r.id: (r.hop, r.rel_types, r.graph_score) for r in graph.expand(e, spark.createDataFrame([("s",)], "id string"), 3).collect()}
    assert got == {"x": (1, ["A"], 1.0), "y": (2, ["A", "C"], 0.5), "t": (3, ["A", "C", "D"], 0.3333)}


def test_rrf(spark):
    hits = lambda ids, i: retrieval.ranked(spark.createDataFrame([(x, float(-k)) for k, x in enumerate(ids)], "id string, score double"), f"s{i}", i)
    lists = [hits("abc", 0), hits("cd", 1)]
    rows = retrieval.rrf(lists).orderBy(F.col("rrf_score").desc(), "first_list", "first_rank").collect()
    assert [r.id for r in rows] == ["c", "a", "b", "d"]
    assert rows[0].sources == ["s0", "s1"] and rows[0].rrf_score == round(0.5 / 63 + 0.5 / 61, 6)
    assert retrieval.fusion_weights(0.7, False) == pytest.approx([0.7, 0.18, 0.12])


def test_payload_filter_unknown_field():
    with pytest.raises(ValueError):
        retrieval.payload_filter(["label"], {"year": 2020})


def test_spans_and_budgets(spark):
    c = spark.createDataFrame([("d", i, k, "x" * 10) for i, k in enumerate(["", "5", "", "6", "5"])], "doc_id string, o int, k string, t string")
    assert [r.o for r in answer.span(c, "doc_id", "o", F.col("k"), "5").orderBy("o").collect()] == [1, 2]
    assert [r.o for r in answer.within_budget(c, "doc_id", "o", "t", 25).orderBy("o").collect()] == [0, 1]
    assert [r.o for r in answer.within_budget(c, "doc_id", "o", "t", 5).orderBy("o").collect()] == [0]


def _events(n=60):
    t = dt.datetime(2024, 1, 1)
    return [(k % 3, k, t + dt.timedelta(seconds=(k * 37) % 300 + 200 * (k // 20))) for k in range(n)]


def test_rate_limit_stream_equals_batch(spark, tmp_path):
    schema = "user_id long, event_id long, ts timestamp"
    rows = sorted(_events(), key=lambda r: r[2])
    for i in range(3):
        spark.createDataFrame(rows[i * 20 : i * 20 + 20], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    twin = state.rate_limit(spark.createDataFrame(rows, schema), 2, 60)
    want = sorted((r.event_id, r.n, r.allowed) for r in twin.collect())
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = io.file_stream(spark, str(tmp_path / "in"), schema)
        query = state.rate_limit_stream(stream, 2, 60).writeStream.format("memory").queryName("limited").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    assert sorted((r.event_id, r.n, r.allowed) for r in spark.table("limited").collect()) == want


def test_windowed_stream_equals_batch(spark, tmp_path):
    schema = "user_id long, event_id long, ts timestamp, value double"
    rows = [(*r, 1.0) for r in _events()] + [(9, 99, dt.datetime(2025, 1, 1), 1.0), (9, 100, dt.datetime(2026, 1, 1), 1.0)]
    df = spark.createDataFrame(rows, schema)
    df.where("event_id < 99").write.mode("append").parquet(str(tmp_path / "in"))
    got = []

    def handle(batch, _):
        got.extend((r.start, r.n) for r in batch.collect())

    for last in ("event_id = 99", "event_id = 100"):
        df.where(last).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        io.consume(state.windowed_counts(io.file_stream(spark, str(tmp_path / "in"), schema), [], "1 minute", watermark="1 minute"), str(tmp_path / "cp"), handle)
    want = [(r.start, r.n) for r in state.windowed_counts(df.where("event_id < 100"), [], "1 minute").collect()]
    assert sorted(got) == sorted(want)


def test_cache_misses_stream(spark, tmp_path):
    rows = [("a", 1, dt.datetime(2024, 1, 1)), ("a", 2, dt.datetime(2024, 1, 1, 0, 1)), ("b", 3, dt.datetime(2024, 1, 1))]
    spark.createDataFrame(rows, "key string, request_id long, ts timestamp").coalesce(1).write.parquet(str(tmp_path / "in"))
    got = []
    stream = io.file_stream(spark, str(tmp_path / "in"), "key string, request_id long, ts timestamp")
    io.consume(state.cache_misses_stream(stream, "5 minutes"), str(tmp_path / "cp"), lambda b, _: got.extend(r.key for r in b.collect()))
    assert sorted(got) == ["a", "b"]


def test_sources(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"documents": [{"id": 1}, {"id": 2}]}))
    (tmp_path / "b.json").write_text(json.dumps([{"id": 3}]))
    assert io.json_documents(spark, str(tmp_path / "a.json")).count() == 2 and io.json_documents(spark, str(tmp_path / "b.json")).first().id == 3
    spark.range(3).write.parquet(str(tmp_path / "set" / "content" / "train"))
    assert io.open_first(spark, str(tmp_path / "set"), ["given", "content"], ["data", "train"]).count() == 3
    with pytest.raises(FileNotFoundError):
        io.open_first(spark, str(tmp_path / "none"), ["a"], ["b"])
    io.csv_sink(spark.range(2), str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).columns == ["id"]
    io.swap_in(spark, spark.range(4), "qg_swap")
    io.swap_in(spark, spark.table("qg_swap").where("id < 2"), "qg_swap")
    assert spark.table("qg_swap").count() == 2
    spark.sql("ALTER TABLE qg_swap RENAME TO qg_swap__old")  # as a swap leaves it that is stopped between the two names
    assert io.recover(spark, "qg_swap") and spark.table("qg_swap").count() == 2 and not io.recover(spark, "qg_swap")
    spark.sql("DROP TABLE qg_swap")


def test_uuid5_and_composed_text(spark):
    import uuid

    from quillgraph.functions import text as T

    df = spark.createDataFrame([("d__00001",), ("đ é",)], "x string").select("x", T.uuid5("x").alias("u"))
    assert all(r.u == str(uuid.uuid5(uuid.NAMESPACE_URL, r.x)) for r in df.collect())
    parts = [("I", "Điều 1", "1.", " a "), ("I", "Điều 1", "2.", "b"), ("I", "Điều 2", None, "c"), ("II", "Điều 2", "", None)]
    schema = "p array<struct<chapter: string, article: string, clause: string, content: string>>"
    assert spark.createDataFrame([(parts,)], schema).select(T.composed_text("p").alias("t")).first().t == "I\nĐiều 1\n1.\na\n2.\nb\nĐiều 2\nc\nII\nĐiều 2"


def test_structured_retrieval_and_answers(spark):
    docs = spark.createDataFrame([("a", "1/2020/X", "Luật Thuế"), ("b", "2/2020/X", "Luật Thuế sửa đổi"), ("c", "3/2020/X", None)], "doc_id string, doc_number string, title string")
    chunks = spark.createDataFrame([(d, f"{d}{i}", i, "t" * 10, f"dieu {i}") for d in "abc" for i in range(1, 4)], "doc_id string, chunk_uid string, chunk_order int, text string, article string")
    edges = spark.createDataFrame([("1/2020/X", "2/2020/X", "AMENDS"), ("3/2020/X", "1/2020/X", "CITES")], "src string, dst string, rel_type string")
    ref = lambda n=None, name=None, art=None: (n, name, art, None, None)
    asked = [(1, "explain_article", [ref(name="luật thuế", art="2")]), (2, "summarize_doc", [ref("2/2020/X")]), (3, "list_related", [ref("1/2020/X")]), (4, "compare", [ref("1/2020/X", art="1"), ref("3/2020/X", art="9")])]
    schema = "question_id int, intent string, references array<struct<doc_number: string, doc_name: string, article: string, clause: string, point: string>>"
    got = {}
    for r in answer.structured(spark.createDataFrame(asked, schema), docs, chunks, edges).collect():
        got.setdefault((r.question_id, r.ref), set()).add(r.item)
    assert got == {(1, 0): {"a2"}, (2, 0): {"b1", "b2", "b3"}, (3, 0): {"AMENDS out 2/2020/X", "CITES in 3/2020/X"}, (4, 0): {"a1"}}  # no chunk of c has, or names, article 9
    rows = spark.createDataFrame([("q", "ctx", "compare")], "question string, context string, intent string")
    assert answer.synthesize(rows).first().answer == "ctx"

    def model(p):
        raise RuntimeError("down")

    failed = answer.synthesize(rows, model).first()
    assert failed.failed and failed.answer == "down\n\nctx"
    assert answer.synthesize(rows, lambda p: p[:7]).first().answer == "Compare"


def test_hybrid_search(spark):
    from quillgraph.operators import hybrid

    embed = embedding.hashing_embedder(16)
    texts = {"a1": "tax law of income", "a2": "tax on land", "b1": "rules for ships", "c1": "ships at sea", "d1": "other words here"}
    gold = spark.createDataFrame([(u, u[0], int(u[1]), t, embed([t])[0]) for u, t in texts.items()], "chunk_uid string, doc_id string, chunk_order int, text string, vector array<double>")
    docs = spark.createDataFrame([(d, "law" if d == "a" else "note") for d in "abcd"], "doc_id string, doc_type string")
    edges = spark.createDataFrame([(1, "a", "b", "CITES"), (2, "b", "c", "CITES")], "edge_id long, src string, dst string, rel_type string")
    corpus = hybrid.Corpus(gold, docs, edges)
    hits, stats = hybrid.search(corpus, embed(["tax law of income"])[0], ["tax", "income"], top_k=4)
    rows, s = hits.collect(), stats.first()
    assert rows[0].id == "a1" and set(rows[0].sources) == {"vector", "keyword"}
    assert {r.id for r in rows} >= {"a1", "a2", "b1"} and s.keyword_count == 2 and s.graph_count >= 1
    alone, s = hybrid.search(corpus, embed(["tax"])[0], ["ships"], top_k=2, doc_type="note", graph=False, threshold=None)
    s = s.first()
    assert "graph_count" not in s.asDict() and s.keyword_count == 2


def test_knn_takes_more_queries_than_a_block(spark, monkeypatch):
    from conftest import SF

    v = spark.read.parquet(f"{SF}/embeddings.parquet")
    corpus, queries = v.selectExpr("vec_id AS id", "embedding AS vector"), v.where("vec_id < 40").selectExpr("vec_id AS query_id", "embedding AS query_vector")
    whole = retrieval.knn(corpus, queries, 4, 0.1).collect()
    monkeypatch.setattr(retrieval, "QUERY_BYTES", 64 * 8 * 10)
    rounded = lambda rows: sorted((r.query_id, r.id, round(r.score, 9), r["rank"]) for r in rows)
    assert rounded(retrieval.knn(corpus, queries, 4, 0.1).collect()) == rounded(whole) and {r.query_id for r in whole} == set(range(40))


@pytest.mark.parametrize("metric", ["cosine", "dot", "euclid", "manhattan", "unknown"])
def test_knn_by_matrix_equals_expressions(spark, monkeypatch, metric):
    rows = [(i, [float(i % 3), float(i % 5), 1.0]) for i in range(40)] + [(40, [0.0, 0.0, 0.0]), (41, None), (42, [1.0]), (43, [])]
    corpus = spark.createDataFrame(rows, "id long, vector array<double>")
    queries = spark.createDataFrame([("a", [1.0, 2.0, 3.0]), ("b", [0.0, 0.0, 1.0]), ("c", None)], "query_id string, query_vector array<double>")
    found = lambda: sorted((r.query_id, r.id, round(r.score, 9), r["rank"]) for r in retrieval.knn(corpus, queries, 7, metric=metric).collect())
    whole = found()
    assert len(whole) == 14
    monkeypatch.setattr(retrieval, "QUERY_BYTES", 8)
    assert found() == whole
    assert retrieval.knn(corpus, queries.limit(0), 7).count() == 0 and retrieval.knn(corpus.limit(0), queries, 7).count() == 0


def test_stored_postings_equal_the_scan(spark, tmp_path):
    rows = [(f"c{i}", f"tax law {'income ' * (i % 4)} word{i % 7} end") for i in range(60)] + [("n", None), ("e", "")]
    chunks = spark.createDataFrame(rows, "chunk_uid string, chunk_text string")
    retrieval.write_postings(chunks, str(tmp_path / "index"), buckets=5)
    for terms in (["income"], ["income", "word3", "income"], ["absent"], ["tax", "absent"]):
        scan = {r.id: round(r.score, 9) for r in retrieval.bm25(chunks, terms).collect()}
        assert scan == {r.id: round(r.score, 9) for r in retrieval.search_postings(spark, str(tmp_path / "index"), terms).collect()}


def test_expand_equals_all_paths(spark, monkeypatch):
    import random

    rng = random.Random(7)
    rows = [(i, f"n{rng.randrange(25)}", f"n{rng.randrange(25)}", rng.choice("ABC")) for i in range(45)] + [(100 + i, "hub", f"leaf{i}", "A") for i in range(30)] + [(200, "n1", "hub", "B")]
    seeds = {"n1", "n2"}
    best: dict[str, tuple] = {}
    paths = [((x,), (), ()) for x in seeds]
    for hop in (1, 2, 3):
        longer = []
        for nodes, used, types in paths:
            for e, a, b, t in rows:
                for x, y in {(a, b), (b, a)}:
                    if x == nodes[-1] and e not in used:
                        longer.append(((*nodes, y), (*used, e), (*types, t)))
        for nodes, _, types in longer:
            if nodes[-1] not in seeds:
                best[nodes[-1]] = min(best.get(nodes[-1], (9, ())), (hop, types))
        paths = longer
    e, s = spark.createDataFrame(rows, "edge_id long, src string, dst string, rel_type string"), spark.createDataFrame([(x,) for x in seeds], "id string")
    found = lambda: {r.id: (r.hop, tuple(r.rel_types)) for r in graph.expand(e, s, 3).collect()}
    assert found() == best
    monkeypatch.setattr(graph, "BROADCAST_NODES", 1)
    assert found() == best


def test_names_meet_titles_by_a_word(spark):
    titles = [("a", "1", "Luật Thuế thu nhập cá nhân"), ("b", "2", "Luật Thuế thu nhập cá nhân sửa đổi"), ("c", "3", "Bộ luật dân sự"), ("d", "4", None), ("e", "5", "Nghị định thuế")]
    docs = spark.createDataFrame(titles, "doc_id string, doc_number string, title string")
    names = ["luật thuế thu nhập cá nhân", "uế thu nhập cá nh", "dân sự", "thuế", "không có gì cả", " ", None]
    refs = spark.createDataFrame([(i, "explain_article", 0, None, n, None) for i, n in enumerate(names)], "question_id int, intent string, ref int, doc_number string, doc_name string, article string")
    got = {r.question_id: r.doc_id for r in answer.found_documents(refs, docs).collect()}
    want = {}
    for i, n in enumerate(names):
        fits = sorted((len(t), d) for d, _, t in titles if t and n and n.strip() and n.lower() in t.lower())
        want |= {i: fits[0][1]} if fits else {}
    assert got == want


def test_sinks_and_queue(spark, tmp_path):
    from quillgraph.streaming import queue

    io.csv_sink(spark.createDataFrame([("đ", 1)], "ten string, n int").coalesce(1), str(tmp_path / "csv"))
    (part,) = [p for p in (tmp_path / "csv").iterdir() if p.name.startswith("part")]
    assert part.read_bytes().startswith(b"\xef\xbb\xbften,n")
    with pytest.raises(ValueError, match="not unique"):
        io.check_unique(spark.createDataFrame([(1,), (1,), (2,), (None,), (None,)], "k int"), "k")
    io.check_unique(spark.createDataFrame([(1,), (None,), (None,)], "k int"), "k")
    log = spark.range(50).selectExpr("id", "'view' AS event_type", "struct(id) AS data")
    assert sorted(r.id for r in queue.analytics(log, "id", 3).collect()) == [47, 48, 49]
    r = queue.results(spark.createDataFrame([("c", "m", "x" * 600, 1.5)], "conversation_id string, assistant_message_id string, answer string, latency_ms double")).first()
    assert len(r.answer) == 500 and r.latency_ms == "1.5" and r.metadata == "{}"


def test_questions_are_embedded_once(spark):
    calls = spark.sparkContext.accumulator(0)

    def embed(texts):
        calls.add(len(texts))
        return [[float(len(t))] for t in texts]

    rows = spark.createDataFrame([(i, "abc"[: 1 + i % 3] if i else None) for i in range(10)], "id int, question string")
    got = {r.id: r.embedding for r in etl.embed_questions(rows, embed).collect()}
    assert len(got) == 10 and got[0] is None and got[4] == [2.0] and calls.value == 3
