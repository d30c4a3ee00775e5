"""Lookup by runs of characters, scans in two passes, stored tables by key, clustered pages and the cache as a stream, against plain code."""

import os
import random
import sys

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from quillgraph.functions import chunker  # noqa: E402
from quillgraph.operators import answer, keyed, lookup, scan  # noqa: E402
from quillgraph.sources.io import file_stream, settings, ship  # noqa: E402
from quillgraph.streaming import state  # noqa: E402


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    ship(spark)


def test_lookup_equals_brute_force(spark):
    rng = random.Random(4)
    text = lambda n: "".join(rng.choice("abcđé ") for _ in range(n))
    texts = [(i, text(rng.randint(0, 25))) for i in range(120)] + [(200, None), (201, ""), (202, "ABC"), (203, "日本 abc")]
    names = [(f"k{i}", text(rng.choice([1, 1, 2, 2, 3, 4, 6]))) for i in range(60)] + [("n", None), ("e", ""), ("u", "Bc"), ("j", "日"), ("k0", "a"), ("u", "Bc"), ("long", "abc" * 30)]
    want = sorted((k, i) for k, n in names if n for i, t in texts if t is not None and n.lower() in t.lower())
    n, t = spark.createDataFrame(names, "key string, name string"), spark.createDataFrame(texts, "id long, text string")
    assert sorted((r.key, r.id) for r in lookup.containing(n, t).collect()) == want and len(want) > 300
    once = {k: m for k, m in names if m and k not in ("u", "k0")}
    near = {k: min((len(x), i) for i, x in texts if x is not None and m.lower() in x.lower()) for k, m in once.items() if any(k == kk for kk, _ in want)}
    assert {r.key: r.id for r in lookup.shortest(n.where("key not in ('u', 'k0')"), t).collect()} == {k: i for k, (_, i) in near.items()}
    assert lookup.containing(n.limit(0), t).count() == 0 == lookup.containing(n, t.limit(0)).count()


def test_scan_of_a_group_larger_than_a_part(spark):
    rng = random.Random(2)
    rows = [(("hot" if i % 3 else rng.choice(["a", "b", None])), i, rng.choice([None, 1, 2, 5]), rng.choice(["x", "the", "", "thy"])) for i in range(900)]
    df = spark.createDataFrame(rows, "g string, o long, v long, t string").repartition(6)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r.o: (r.s, r.n) for r in scan.running(df, "g", ["o"], {"s": F.col("v"), "n": F.lit(1)}).collect()}
        parts = scan.running(df, "g", ["o"], {"s": F.col("v")}).where("g = 'hot'").select(F.spark_partition_id().alias("p")).distinct().count()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want, sums = {}, {}
    for g, o, v, _ in sorted(rows, key=lambda r: r[1]):
        s, n = sums.get(g, (0, 0))
        sums[g] = want[o] = (s + (v or 0), n + 1)
    assert got == want and parts >= 1
    for mine, whole in ((scan.within_budget(df, "g", "o", "t", 40), answer.within_budget(df.where("g is not null"), "g", "o", "t", 40)), (scan.span(df, "g", "o", F.col("t"), "the"), answer.span(df.where("g is not null"), "g", "o", F.col("t"), "the"))):
        assert sorted(r.o for r in mine.where("g is not null").collect()) == sorted(r.o for r in whole.collect())


def files(path):
    return {str(p): p.stat().st_mtime_ns for p in path.rglob("*.parquet")}


def test_upsert_writes_only_what_it_touches(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"v{i}", 1) for i in range(200)] + [(None, "none", 1)], "k long, v string, version int")
    path = tmp_path / "t"
    table = keyed.create(rows, str(path), ["k"], buckets=16)
    before = files(path)
    assert len({p.split("_bucket=")[1].split("/")[0] for p in before}) == 16
    changed = spark.createDataFrame([(3, "new", 2), (None, "some", 2), (5, "old", 0), (999, "added", 1)], "k long, v string, version int")
    assert table.upsert(changed, "version") <= 4
    after = files(path)
    assert len(set(before.items()) & set(after.items())) >= 12
    got = {r.k: r.v for r in table.read().collect()}
    assert got == {i: f"v{i}" for i in range(200)} | {3: "new", None: "some", 999: "added"}
    assert table.upsert(changed.limit(0), "version") == 0 and files(path) == after
    table.insert_absent(spark.createDataFrame([(3, "ignored", 9), (1000, "x", 1), (1000, "y", 1)], "k long, v string, version int"))
    got = {r.k: r.v for r in table.read().collect()}
    assert got[3] == "new" and got[1000] == "x" and len(got) == 203


def test_view_stays_right_when_a_batch_comes_again(spark, tmp_path):
    empty = spark.createDataFrame([], "k long, n long, last long, batch long")
    view = keyed.create(empty, str(tmp_path / "v"), ["k"], buckets=4)
    rng = random.Random(1)
    rows, want = [], {}
    for batch in (0, 1, 1, 2, 0):
        if len(rows) <= batch:
            rows.append([(rng.randint(0, 9), 1, rng.randint(0, 99)) for _ in range(30)])
            for k, n, t in rows[batch]:
                want[k] = (want.get(k, (0, 0))[0] + n, max(want.get(k, (0, 0))[1], t))
        partial = spark.createDataFrame(rows[batch], "k long, n long, last long").groupBy("k").agg(F.sum("n").alias("n"), F.max("last").alias("last"))
        keyed.maintain(view, partial, batch, ["n"], ["last"])
    assert {r.k: (r.n, r.last) for r in view.read().collect()} == want


def test_pages_read_only_their_files(spark, tmp_path):
    rows = [(i % 40, i, "x") for i in range(1000)]
    random.Random(5).shuffle(rows)
    path = str(tmp_path / "c")
    keyed.write_clustered(spark.createDataFrame(rows, "a long, b long, c string"), path, ["a", "b"], 8)
    order, after, got = ["a", "b"], None, []
    for _ in range(7):
        page = [tuple(r) for r in keyed.page(spark, path, order, after, 170).collect()]
        if not page:
            break
        assert len(keyed.files_of_page(spark, path, order, after, 170)) <= 4
        got += page
        after = page[-1][:2]
    assert got == sorted(rows)
    assert keyed.page(spark, path, order, (39, 10**9), 5).count() == 0


def test_cache_stream_equals_batch(spark, tmp_path):
    from datetime import datetime, timedelta

    rng = random.Random(6)
    start = datetime(2024, 1, 1)
    rows = sorted((f"k{rng.randrange(5)}", i, start + timedelta(seconds=rng.randrange(6000))) for i in range(120))
    rows.sort(key=lambda r: (r[2], r[1]))
    schema = "key string, request_id long, ts timestamp"
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    try:
        source = str(tmp_path / "in")
        for i in range(3):
            spark.createDataFrame(rows[40 * i : 40 * i + 40], schema).coalesce(1).write.mode("append").parquet(source)
        out = str(tmp_path / "out")
        state.cache_stream(file_stream(spark, source, schema, 1), 300).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
        spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")
    got = sorted(map(tuple, spark.read.parquet(out).collect()))
    assert got == sorted(map(tuple, state.cache_hits(spark.createDataFrame(rows, schema), 300).collect())) and len(got) == 120 and len({h for _, _, h in got}) == 2


def test_chunker_in_sql(spark):
    chunker.register_chunker(spark)
    rows = [("a", "n", "t", "Điều 5. Phạm vi\n1. một hai\n2. ba bốn"), ("b", "n", "t", None), ("c", None, "t", "x y. " * 200)]
    docs = spark.createDataFrame(rows, "doc_id string, doc_number string, doc_title string, content_text string")
    docs.createOrReplaceTempView("some_docs")
    got = spark.sql("SELECT c.* FROM some_docs d, LATERAL chunk_document(d.doc_id, d.doc_number, d.doc_title, d.content_text, 220, 300, 30) c")
    want = chunker.chunk_documents(docs)
    key = lambda r: (r.chunk_uid, r.chunk_order, r.chunk_text, r.token_count, r.article, r.clause)
    assert sorted(map(repr, map(key, got.collect()))) == sorted(map(repr, map(key, want.collect()))) and got.count() == 4


def test_bursts_of_a_user_larger_than_a_part(spark):
    rng = random.Random(9)
    rows, t = [], 0
    for i in range(1200):  # a third of all rows and more are one user's
        t += rng.choice([0, 1, 1, 2, 59, 60, 61])
        rows.append((rng.choice([7, 7, 7, 1, 2, None]), i, None if i % 97 == 0 else f"2024-01-01 {t // 3600 % 24:02d}:{t // 60 % 60:02d}:{t % 60:02d}", "x"))
    events = spark.createDataFrame(rows, "user_id long, event_id long, at string, _group string").withColumn("ts", F.col("at").cast("timestamp"))
    events = events.drop("at").withColumnRenamed("_group", "n_extra")
    for gap, parts in ((60, 7), (2, 7), (100_000, 40)):
        with_parts = {"spark.sql.shuffle.partitions": str(parts), "spark.sql.adaptive.coalescePartitions.enabled": "false"}
        with settings(spark, with_parts):
            got = sorted((r.event_id, r.n) for r in scan.bursts(events, "user_id", "ts", "event_id", gap).collect())
            want = sorted((r.event_id, r.n) for r in state.rate_limit(events, 1, gap).collect())
        assert got == want and len(got) == 1200
    assert max(n for _, n in got) > 100
    assert scan.bursts(events.limit(0), "user_id", "ts", "event_id", 60).collect() == []


def test_batches_fill_up_whatever_the_cut(spark):
    ids = [i * i for i in range(1003)]
    for parts in (1, 5):
        rows = spark.createDataFrame([(i, "b") for i in ids], "id long, batch_of string").repartition(parts)
        got = {r.id: r.batch for r in scan.batches_of(rows, ["id"], 200).collect()}
        assert got == {v: k // 200 for k, v in enumerate(ids)}
    assert scan.batches_of(rows.limit(0), ["id"], 200).collect() == []
