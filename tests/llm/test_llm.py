import hashlib
import os
import pickle
import random
import sys
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from conftest import SF, same  # noqa: E402

from quillgraph.llm import _tokens, chat, components, decontaminate, exact_dedup, html_extract, line_dedup, lm_scoring, packing, queries, sharding, simhash, toxicity  # noqa: E402
from quillgraph.llm._common import ship  # noqa: E402
from quillgraph.sources.io import settings  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    ship(spark)


def docs(spark, rows, extra=False):
    """rows of (doc_id, text[, source]); extra columns that clash with internal names on demand."""
    df = spark.createDataFrame([(r[0], r[1], "en", r[2] if len(r) > 2 else "s", 0) for r in rows], SCHEMA)
    return df.withColumns({c: F.lit(1) for c in ("gid", "fp", "n", "key", "bucket", "score", "ids", "shard", "term", "pos")}) if extra else df


ODD = [(1, None), (2, ""), (None, "a b c d"), (4, " \t\n"), (5, "x" * 300_000), (6, "word " * 60_000), (7, "a b  c\nd"), (7, "a b  c\nd"), (8, "Ünï côdé ’ 日本"), (9, "a")]


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_against_sql(spark, duck, name):
    same(queries.QUERIES[name](spark, SF), duck, queries.ORACLES[name])


def every_operator(spark, rows):
    d = docs(spark, rows, extra=True)
    empty_bench = spark.createDataFrame([], "item_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0), (6, 0, 1)], "doc_id long, quality int, toxic int")
    yield exact_dedup.exact_groups(d)
    yield simhash.near_components(d)
    yield sharding.shard_documents(d)
    yield packing.pack(d).select("doc_id", "start").where("start = 0")
    yield decontaminate.contamination(d, empty_bench)
    yield lm_scoring.score_documents(d)
    yield toxicity.toxicity(d, labels)


def test_odd_rows_and_empty_tables(spark):
    for out in every_operator(spark, ODD):
        assert out.count() == len(ODD)
    for out in every_operator(spark, []):
        assert out.count() == 0
    pages = spark.createDataFrame([(1, None, None), (None, "http://a.b/c", ""), (3, "x", "<p>y"), (3, "x", "<p>y")], "page_id long, url string, html string")
    for f in (html_extract.extract_pages, line_dedup.dedup_page_lines):
        assert f(pages).count() == 4 and f(pages.limit(0)).count() == 0
    turns = spark.createDataFrame([(1, 0, "user", None), (None, None, None, "x"), (1, 0, "user", None)], "conv_id long, turn long, role string, text string")
    assert chat.parse(turns).count() == 3 and chat.parse(turns.limit(0)).count() == 0


# ---- exact dedup


def test_exact_dedup_collisions_and_splits(spark):
    rows = [(i, f"text {i % 37}" + " " * (i % 3)) for i in range(300)]
    want = {}
    for i, t in rows:
        n = "".join(t.split())
        want.setdefault(n, []).append((-len(t), i))
    clash = exact_dedup.exact_groups(docs(spark, rows), hasher=lambda b: len(b) % 2, capacity=1)
    usual = exact_dedup.exact_groups(docs(spark, rows), capacity=4)
    for out in (clash, usual):
        got = {r.doc_id: r for r in out.collect()}
        for n, group in want.items():
            for _, i in group:
                r = got[i]
                assert (r.keep_id, r.group_size, r.kept) == (min(group)[1], len(group), i == min(group)[1])
                assert r.text_sha256 == hashlib.sha256(n.encode()).hexdigest()


def test_exact_dedup_splits_a_text_that_stands_in_every_task(spark, monkeypatch):
    hot = "hot " * 100
    rows = [(i, hot + " " * (i % 5) if i % 3 else f"t{i % 50}") for i in range(600)] + [(900, "u" * 299), (901, "v" * 299)]
    d = docs(spark, rows).repartition(60)
    seen, true = [], exact_dedup.cooled

    def watched(placed, sizes, room):
        out, told = true(placed, sizes, room)
        body = F.octet_length("body") > 100
        seen.append((placed.where(body).count(), out.where(body).count(), len(told)))
        return out, told

    monkeypatch.setattr(exact_dedup, "cooled", watched)
    with settings(spark, {"spark.sql.files.maxPartitionBytes": "20000"}):  # a file of rows a task
        usual = sorted(exact_dedup.exact_groups(d).collect())
        split = sorted(exact_dedup.exact_groups(d, room=2000).collect())
        clash = sorted(exact_dedup.exact_groups(d, hasher=lambda b: 1 if len(b) > 50 else len(b), room=2000).collect())
    want = usual
    assert split == clash == want and len(want) == 602
    assert want[1].group_size == 400 and {r.keep_id for r in want if r.group_size == 400} == {4}
    (before, left, none), (first, after, told), (_, clashed, rounds) = seen
    assert before == left == first > 40 and none == 0  # an entry a task
    assert told >= 1 and after <= first / 4  # an entry a run of LEAST_RUN entries or more
    assert rounds >= 1 and clashed <= first / 2  # texts that clash are kept apart in each run


def test_directory_doubles_only_where_full():
    slots, depth = exact_dedup.directory(np.array([9, 0, 0, 0, 1, 1, 1, 1]), 4)
    assert depth == 3 and len(set(slots[:4])) == 3 and len(set(slots[4:])) == 1
    assert exact_dedup.directory(np.array([1, 1]), 4) == (np.zeros(1), 0)


# ---- SimHash


def brute_components(prints, radius):
    f = np.array(sorted({p for _, p in prints}), np.uint64)
    first = np.array([min(d for d, p in prints if p == x) for x in f.tolist()])
    near = np.bitwise_count(f[:, None] ^ f[None, :]) <= radius
    while True:
        new = np.array([first[near[i]].min() for i in range(len(f))])
        if (new == first).all():
            return dict(zip(f.tolist(), first.tolist()))
        first = new


@pytest.mark.parametrize("tile,cuts", [(4096, (16, 16, 16, 16)), (7, (16, 16, 16, 16)), (5, (11, 11, 11, 11, 10, 10))])
def test_simhash_links_equal_brute_force(spark, tile, cuts):
    rng = random.Random(5)
    prints = []
    for i in range(40):
        p = rng.getrandbits(64)
        for k in range(6):
            prints.append((len(prints), p))
            p ^= 1 << rng.randrange(64)
            p ^= (1 << rng.randrange(64)) if k % 2 else 0
    want = brute_components(prints, 2)
    df = spark.createDataFrame([(simhash._signed(p),) for p in {p for _, p in prints}], "fp long")
    ties = simhash.links(df, 2, tile, cuts)
    roots = {r.node: r.root for r in components.components(ties, "a", "b").collect()}
    groups = {}
    for p in {p for _, p in prints}:
        groups.setdefault(roots.get(simhash._signed(p), simhash._signed(p)), set()).add(p)
    truth = {}
    for p, c in want.items():
        truth.setdefault(c, set()).add(p)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, truth.values()))


@pytest.mark.parametrize("tile,cuts", [(4096, 4), (7, 4), (5, 6), (3, 8)])
def test_simhash_rows_are_as_predicted(spark, tile, cuts):
    rng = random.Random(8)
    # Two sets of bits by turns, so that some tiles hold many fingerprints.
    prints = {sum(1 << b for b in rng.sample(range(64), k)) for k in (1, 2, 32) for _ in range(150)}
    df = spark.createDataFrame([(simhash._signed(p),) for p in prints], "fp long")
    n, rows = simhash.predicted_rows(df, 2, tile, simhash.widths(cuts))
    assert n == len(prints) and rows == simhash.dealt(df, 2, tile, simhash.widths(cuts)).count()


def test_simhash_takes_more_sub_words_where_tiles_are_large(spark):
    df = spark.range(40_000).select(F.xxhash64("id").alias("fp"))
    assert [len(simhash.choose_cuts(df, 2, tile)) for tile in (4096, 1)] == [4, 6]
    assert simhash.choose_cuts(df.limit(0)) == simhash.widths(4)


def test_simhash_fingerprints(spark):
    import xxhash

    rows = [(1, "The quick BROWN fox jumps over"), (2, "one two"), (3, ""), (4, "É é a b c")]
    got = {r.doc_id: r for r in simhash.near_components(docs(spark, rows)).collect()}
    for i, t in rows:
        w = "".join(c.lower() if c.isascii() else c for c in t).split()
        h = [xxhash.xxh64_intdigest(" ".join(w[k : k + 3]), 42) for k in range(max(1, len(w) - 2))] if w else []
        bits = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
        assert got[i].fingerprint == f"{bits:016x}"


def test_components_long_chain(spark):
    edges = spark.range(200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    rows = components.components(edges, "a", "b").collect()
    assert len(rows) == 201 and {r.root for r in rows} == {0}


# ---- packing


def test_plan_covers_every_token_without_padding():
    rng = random.Random(1)
    for n in (0, 1, 5, 200):
        lengths = [rng.choice([rng.randrange(1, 50), rng.randrange(1, 9000)]) for _ in range(n)]
        seen = [np.zeros(x, int) for x in lengths]
        for seq in packing.plan(lengths):
            size = sum(k for _, _, k in seq)
            assert 0 < size <= 4096 and (size == 4096 or size & (size - 1) == 0)
            for i, start, k in seq:
                seen[i][start : start + k] += 1
        assert all((s == 1).all() for s in seen)


def test_fill_is_the_best_subset():
    from itertools import combinations

    rng = random.Random(2)
    for _ in range(40):
        items = [rng.randrange(1, 60) for _ in range(9)]
        cap = rng.randrange(20, 200)
        counts = {x: items.count(x) for x in items}
        took = packing.fill(counts, cap)
        assert all(took[k] <= counts[k] for k in took)
        best = max(sum(c) for r in range(10) for c in combinations(items, r) if sum(c) <= cap)
        assert sum(k * v for k, v in took.items()) == best


def test_packed_ids_are_the_tokenizers(spark):
    from tokenizers import Tokenizer

    path = packing.default_tokenizer()
    tok = Tokenizer.from_file(path)
    odd = ["Hello... world!! it's 'S we'LL 12,345.67 a.b,c. x,", "<|endoftext|>x <|y", "ÀÉÎ ñandú Straße ΑΣ Σ ﬁ İstanbul café́ é Å", "日本語, ok. nb\xa0sp \x1c\x1d a\x01b \x85z", "́x ́", "a.\nb,\tc.", "½ ² 10² ٣", ""]
    rows = list(enumerate(odd)) + [(100 + r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect()]
    got = packing.pack(docs(spark, rows)).orderBy("doc_id", "start").collect()
    for i, t in rows:
        ids = np.frombuffer(b"".join(r.ids for r in got if r.doc_id == i), "<u4").tolist()
        assert ids == tok.encode(t, add_special_tokens=False).ids + [2]
    digest = packing.packed_digest(packing.pack(docs(spark, rows))).first()
    assert digest.ids_crc32 >= 0


# ---- decontamination


def test_short_items_and_proximity(spark):
    items = spark.createDataFrame([(1, "Alpha beta"), (2, "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"), (3, None), (4, "...")], "item_id long, text string")
    near = "one two three four x six SEVEN eight nine ten eleven twelve thirteen"
    rows = [(1, "zz ALPHA, beta zz alpha"), (2, "q " * 5 + "one two three four five six seven eight nine ten eleven twelve thirteen"), (3, near), (4, None), (5, "five " * 4)]
    got = {r.doc_id: r for r in decontaminate.contamination(docs(spark, rows), items).collect()}
    assert (got[1].n_words, got[1].n_hit, got[1].n_items, got[1].contaminated) == (5, 2, 1, True)
    assert (got[2].n_hit, got[2].n_words) == (13, 18)
    assert (got[3].n_hit, got[3].n_near, got[3].contaminated) == (0, 1, False)
    assert (got[4].n_words, got[4].contaminated) == (0, False)
    assert got[1].items_sha256 == hashlib.sha256(b"1").hexdigest()


def test_near_passages_equal_sql(spark):
    import duckdb
    import pandas as pd

    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(40)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([3, 13, 20, 30])))) for i in range(12)]
    rows = []
    for i in range(150):
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(0, 30))]
        for _ in range(rng.randrange(0, 3)):
            passage = rng.choice(items)[1].split()
            for _ in range(rng.randrange(0, 4)):
                passage[rng.randrange(len(passage))] = rng.choice(vocabulary)
            words[rng.randrange(len(words) + 1) :][:0] = passage
            words += passage
        rows.append((i, " ".join(words)))
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(rows, columns=["doc_id", "text"]))
    con.register("benchmark", pd.DataFrame(items, columns=["item_id", "text"]))
    out = decontaminate.contamination(docs(spark, rows), spark.createDataFrame(items, "item_id long, text string"))
    assert same(out, con, decontaminate.ORACLE) == 150
    assert out.where("n_near > 0").count() > 10 and out.where("n_hit > 0").count() > 10


# ---- language model


def test_word_hashes():
    text = "The the THE É é\x1c a\x0bb  ".encode()
    low, s, e, h, owner = _tokens.words(np.frombuffer(text + b"the x", np.uint8), np.array([0, len(text), len(text) + 5]))
    words = [low[a:b].tobytes() for a, b in zip(s, e)]
    assert words == (text.lower().split() + [b"the", b"x"])
    assert h[0] == h[1] == h[2] == h[words.index(b"the", 3)] and len({*h.tolist()}) == len(set(words))
    assert owner.tolist() == [0] * (len(words) - 2) + [1, 1]


def test_word_hashes_keep_nothing_of_long_texts():
    """Before, powers for every byte of the longest text stayed in the worker: 67 MB here."""
    import tracemalloc

    text = (b"x" * 300_000 + b" some Words ") * 2 + b"some words here " * 250_000
    tracemalloc.start()
    try:
        low, s, e, h, owner = _tokens.words(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
        by = {}
        for a, b, x in zip(s[:5000].tolist() + s[-5000:].tolist(), e[:5000].tolist() + e[-5000:].tolist(), h[:5000].tolist() + h[-5000:].tolist()):
            by.setdefault(low[a:b].tobytes(), set()).add(x)
        assert sorted(map(len, by)) == [4, 4, 5, 300_000] and all(len(x) == 1 for x in by.values())
        del low, s, e, h, owner, by
        assert tracemalloc.get_traced_memory()[0] < 1_000_000
    finally:
        tracemalloc.stop()


def test_lm_units_hold_no_more_tokens_where_words_are_short(monkeypatch):
    from types import SimpleNamespace

    import pyarrow as pa
    import pyspark

    monkeypatch.setattr(lm_scoring, "UNIT", 1000)
    monkeypatch.setattr(pyspark.TaskContext, "get", lambda: SimpleNamespace(partitionId=lambda: 0))
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(40)), "text": ["a b\t" * 50] * 40})
    rows = [r for x in lm_scoring._gather(10, 16)(iter([batch])) for r in x.to_pylist() if r["kind"] == 0]
    per = [pickle.loads(r["payload"])["per"] for r in rows]
    assert sum(map(len, per)) == 40 and max(x.sum() for x in per) <= 1000 + 101


def test_lm_scores_one_unit_at_a_time(spark):
    """Before, all units of a task, each with a list of its counts, went to the worker as one batch."""
    plan = lm_scoring.score_documents(docs(spark, [(i, f"t {i}") for i in range(30)]).select("doc_id", "text"))._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInArrow" in plan and "collect_list" not in plan


def test_lm_base_and_gain(spark):
    df = spark.read.parquet(f"{SF.replace('0.001', '0.01')}/documents.parquet")
    got = {r.doc_id: r for r in lm_scoring.score_documents(df).collect()}
    import math
    from collections import Counter

    tokens = {r.doc_id: r.text.encode().lower().split() + [None] for r in df.collect()}
    c = Counter(w for i, t in tokens.items() if zlib.crc32(str(i).encode()) % 10 for w in t)
    n, v = sum(c.values()), len(c)
    for i, t in tokens.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (zlib.crc32(str(i).encode()) % 10 == 0, len(t), sum(w in c for w in t), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t))
        assert r.score < 0
    held = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held) * 0.99


def test_lm_contexts_learn_from_every_training_document(spark):
    import pickle

    rows = [(i, f"the word {i} of {i % 7} is here".encode()) for i in range(200)]
    d = docs(spark, [(i, t.decode()) for i, t in rows]).select("doc_id", "text")
    learns = np.array([not lm_scoring.held_out(i, 10) for i, _ in rows])
    per = lm_scoring._unit(rows, learns)[0]["per"]
    cells = lm_scoring._unit(rows, learns)[4]
    rows = d.repartition(3).mapInArrow(lm_scoring._gather(10, 16), lm_scoring.MIXED).where("kind = 2").collect()
    table = np.zeros(lm_scoring.CONTEXTS * lm_scoring.CLASSES * lm_scoring.BUCKETS, np.int32)
    step = -(-len(table) // lm_scoring.PARTS)
    for r in rows:
        if r.kind == 2:
            at, n = pickle.loads(r.payload)
            table[r.part * step + lm_scoring._sorted_in(at).astype(np.int64)] += lm_scoring._swell(n)
    assert table.sum() == lm_scoring.CONTEXTS * per[learns].sum()
    np.subtract.at(table, cells, 1)
    assert not table.any()


def test_lm_takes_no_sample(spark, monkeypatch):
    """One model, built from the counts of all training documents; every lane starts from the same weights."""
    rows = [(i, f"the word {i} of {i % 7} is here") for i in range(300)]
    tables, starts, build, mix = [], [], lm_scoring.build, lm_scoring.mix_bits
    monkeypatch.setattr(lm_scoring, "build", lambda mass, table, *rest: tables.append(int(table.sum())) or build(mass, table, *rest))
    monkeypatch.setattr(lm_scoring, "mix_bits", lambda *a: starts.append(a[6]) or mix(*a))
    df = docs(spark, rows).select("doc_id", "text")
    tokens = {r.train_tokens for r in lm_scoring.score_documents(df).collect()}
    assert [x // lm_scoring.CONTEXTS for x in tables] == list(tokens)
    assert not starts  # the driver scores no documents of its own


def test_lm_code_is_a_distribution():
    rng = np.random.default_rng(0)
    mass = rng.integers(0, 50, lm_scoring.BUCKETS).astype(float)
    table = np.zeros(lm_scoring.CONTEXTS * lm_scoring.CLASSES * lm_scoring.BUCKETS, np.int32)
    table[rng.integers(0, len(table), 20000)] += 3
    model = lm_scoring.build(mass, table, np.zeros(lm_scoring.SPELL_CELLS, np.int32), 1000, 5)
    b = np.arange(lm_scoring.BUCKETS)
    near = np.full((lm_scoring.CONTEXTS, len(b)), 3)
    none = np.full(len(b), -1)
    order = np.arange(len(b))
    code, _ = lm_scoring.mix_bits(model, b, near, (none, none), order, np.ones(len(b), int), lm_scoring.first_weights())
    assert (10.0 ** code.astype(float)).sum() == pytest.approx(1, abs=1e-3)
    words = [bytes([x]) for x in range(256) if x != 32]
    assert (10 ** lm_scoring.spelling_cost(model, words)).sum() < 1


# ---- toxicity


def test_toxicity_held_out_accuracy(spark):
    rng = random.Random(3)
    common = [f"w{rng.randrange(10**6)}" for _ in range(400)]
    rows, marks = [], []
    for i in range(1500):
        words = [rng.choice(common) for _ in range(rng.randrange(20, 120))]
        bad = i % 6 == 0
        for _ in range(2 * bad):
            words.insert(rng.randrange(len(words)), rng.choice(["blockhead", "nitwit", f"snarg{rng.randrange(999)}"]))
        rows.append((i, " ".join(words)))
        marks.append((i, 1, int(bad)))
    d, labels = docs(spark, rows), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    got = toxicity.toxicity(d, labels).where("held_out").collect()
    assert {r.doc_id for r in got} == {i for i in range(1500) if zlib.crc32(str(i).encode()) % 5 == 0}
    assert sum(r.predicted == int(r.doc_id % 6 == 0) for r in got) / len(got) > 0.97
    assert all(0 <= r.score <= 1 for r in got)


def test_toxicity_of_phrases_whose_words_are_ordinary():
    rng = random.Random(4)
    common = [f"{rng.choice('bcdfgklmnprst')}{rng.choice('aeiou')}{rng.choice('bcdfgklmnprst')}{rng.choice('aeiou')}{i:02d}" for i in range(60)]
    phrases = [(common[i], common[i + 30]) for i in range(3)]

    def text(bad):
        words = [rng.choice(common) for _ in range(60)]
        for a, b in [] if bad else phrases:  # the words alone are as common in ordinary text
            words += [a, rng.choice(common), b, rng.choice(common)] * 2
        for _ in range(4 * bad):
            at = rng.randrange(len(words))
            words[at:at] = rng.choice(phrases)
        return " ".join(words).encode()

    marks = [int(i % 3 == 0) for i in range(600)]
    texts = [text(k) for k in marks]
    model = toxicity.fit(texts[:400], marks[:400])
    score, windows = toxicity.WindowScorer(model), toxicity.PhraseScorer(model)
    right = sum((toxicity.document_score(x, model, score, windows) >= 0.5) == bool(k) for x, k in zip(texts[400:], marks[400:]))
    assert right >= 0.85 * 200


def test_toxicity_features_equal_a_plain_loop():
    import zstandard

    rng = random.Random(5)
    texts = [" ".join(rng.choice(["sun", "moon", "star", "cloud", "rain", "x" * 90, "é"]) for _ in range(rng.randrange(0, 90))).encode() for _ in range(60)]
    texts = [x + b" nasty brute" * (i % 2) for i, x in enumerate(texts)]
    model = toxicity.fit(texts, [i % 2 for i in range(60)])

    def size(content, window, level):
        more = {"min_match": toxicity.GRAM} if level == toxicity.PHRASE_LEVEL else {}
        p = zstandard.ZstdCompressionParameters.from_level(level, **more, write_content_size=False, write_checksum=False, write_dict_id=False, format=zstandard.FORMAT_ZSTD1_MAGICLESS)
        return len(zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=p).compress(window))

    a, b = model["phrases"]
    for x in [b"", b"one", *texts[:8]]:
        words = x.split()
        pairs = [u + b" " + v + b" " for u, v in zip(words, words[1:])] or [w + b" " for w in words]
        extra = size(model["toxic"], model["carrier"] + toxicity.STRANGE, toxicity.LEVEL) - len(toxicity.STRANGE)
        single = [min(size(model["ordinary"], model["carrier"] + w + b" ", toxicity.LEVEL), len(w) + 1 + extra) - size(model["toxic"], model["carrier"] + w + b" ", toxicity.LEVEL) for w in words]
        extra = size(b + toxicity.MARK, toxicity.MARK + toxicity.STRANGE, toxicity.PHRASE_LEVEL) - len(toxicity.STRANGE)
        shown = [min(size(a + toxicity.MARK, toxicity.MARK + w, toxicity.PHRASE_LEVEL), len(w) + extra) for w in pairs]
        strange = {b[i : i + toxicity.GRAM] for i in range(len(b))}
        met = [any(w[i : i + toxicity.GRAM] in strange for i in range(len(w) - toxicity.GRAM + 1)) for w in pairs]
        double = [m * (n - size(b + toxicity.MARK, toxicity.MARK + w, toxicity.PHRASE_LEVEL)) for n, w, m in zip(shown, pairs, met)]
        got = toxicity.document_features(x, toxicity.WindowScorer(model), toxicity.PhraseScorer(model))
        n, k = len(words), toxicity.CLASSES
        reach = [sum(g >= c for g in single) for c in range(2, k + 2)]
        above = [sum(g >= c for g in double) for c in range(2, k + 2)]
        want = [1.0, *[min(r, 1) for r in reach], *np.log1p(reach), np.log1p(n), np.log1p(1000 * reach[1] / max(1, n)), *[min(r, 1) for r in above], *np.log1p(above), *np.log1p(1000 * np.array(above) / max(1, n))]
        assert np.allclose(got, want)


# ---- pages, lines, chats, shards


def test_html_blocks():
    page = (
        '<html><body class="page"><header class="site-header"><h1>Site</h1></header><div id="sidebar"><ul><li><a href=x>one</a><li><a href=y>two</a></ul></div><main><h2>Title here</h2>'
        "<p>The quick brown fox is on the way to the house of the people &amp; it was not in vain.<p>Short.<div class='ad-box'>Buy now</div><form><input name=a>Search</form>"
        '<section class="comments"><p>I think that this is the best of all the articles that I have read in my life</p></section></main><footer>&copy; me</footer><script>var x="<p>no</p>"</script>'
    )
    assert html_extract.extract(page) == "Title here The quick brown fox is on the way to the house of the people & it was not in vain. Short."
    assert html_extract.extract("<nav>a b<article><p>The text of the page is here, and it is not long.</article>") == "The text of the page is here, and it is not long."
    assert html_extract.extract("<" * 5000 + "q='" * 5000) == ""


STORY = "The quick brown fox is on the way to the house of the people and it was not in vain, as we all know."


@pytest.mark.parametrize("inner", ["<option>x", "<ul><li>x", "<b>x", "<dl><dd>x<dt>y", "<table><tr><td>x"])
@pytest.mark.parametrize("outer", ["nav", "form", "aside", "footer"])
def test_html_closes_over_unclosed_tags(outer, inner):
    head, _, item = inner.rpartition("<")
    many = head + f"<{item}" * 300
    assert html_extract.extract(f"<body><{outer}>{many}</{outer}><div>{STORY}</div>") == STORY
    assert html_extract.extract(f"<article>{STORY}{'<b>' * 300}</article><div>short tail<div><p>home</p>") == f"{STORY} short tail home"


def test_html_omitted_end_tags():
    assert html_extract.extract(f"<ul><li class=ad>Buy<li>{STORY}</ul>") == STORY
    assert html_extract.extract(f"<ul><li class=ad><ul><li>Buy</ul>Sell<li>{STORY}</ul>") == STORY
    assert html_extract.extract(f"<table><tr class=ad><td>Buy<td>Sell<tr><td>{STORY}</table>") == STORY
    assert html_extract.extract(f"<dl><dd class=ad>Buy<dt>{STORY}</dl>") == STORY
    assert html_extract.extract(f"<p class=ad>Buy <b>now<div>{STORY}</div>") == STORY


@pytest.mark.parametrize("piece", ["<a ", '<a x="', '<a =">" ', "<script></script ", "<a x='>", "</a ", "<div>", "<li>", "<p>", "<a><p>", "<table><tr><td>", "<!-- ", "&#", '<p class="a b" '])
def test_html_is_linear(piece):
    import time

    took = []
    for size in (250_000, 1_000_000):
        page = piece * (size // len(piece))
        began = time.perf_counter()
        html_extract.extract(page)
        took.append(time.perf_counter() - began)
    assert took[1] < 5 and took[1] < 12 * max(took[0], 0.02)


def test_html_keeps_articles():
    assert html_extract.extract("<nav>" + "<div>" * 250 + f"</nav><article><p>{STORY}</p></article>") == STORY
    for name in ("social-history", "notice-period", "search-methods", "share-prices", "related-work"):
        assert html_extract.extract(f"<article><h1>Title</h1><div class='{name}' id={name}-1><p>{STORY}</p></div></article>") == f"Title {STORY}"
    for name in ("share", "share-box", "related-posts", "comment-body", "ad_slot-3", "story newsletter"):
        assert html_extract.extract(f"<article><h1>Title</h1><p>{STORY}</p><div class='{name}'><p>{STORY}</p></div></article>") == f"Title {STORY}"
    assert html_extract.extract(f"<p>{STORY}</p><p title=\"never closed>{STORY}</p>") == f"{STORY} {STORY}"
    assert html_extract.extract(f"<p title='it>s' data=don't>{STORY}</p><!--><p>{STORY}</p><!-- x --!><p>{STORY}") == f"{STORY} {STORY} {STORY}"


def plain_extract(page):
    """The rules said again over the standard library's parser, without care for speed."""
    from html.parser import HTMLParser

    H = html_extract
    blocks, stack = [], []

    class Reader(HTMLParser):
        buffer, linked = "", 0

        def cut(self):
            t = " ".join(self.buffer.split())
            if t:
                blocks.append((t, min(1.0, self.linked / len(t)), any(x in ("article", "main") and not out for x, out in stack)))
            self.buffer, self.linked = "", 0

        def handle_starttag(self, tag, attrs):
            if tag == "br":
                self.buffer += " " * (not any(out for _, out in stack))
                return
            if tag in H.BLOCK:
                self.cut()
            if tag in H.VOID or tag in H.RAW and tag not in ("script", "style", "title", "textarea"):
                return
            own = {k: (v or "").lower() for k, v in attrs}
            for targets, limits in [(("p",), H.KEEPS_P)] * (tag in H.ENDS_P) + ([H.IMPLIED[tag]] if tag in H.IMPLIED else []):
                names = [x for x, _ in stack]
                limit = max((i for i, x in enumerate(names) if x in limits), default=-1)
                found = [max(i for i, x in enumerate(names) if x == t) for t in targets if t in names]
                found = [i for i in found if i > limit]
                if found:
                    del stack[min(found) :]
            if tag == "a" and any(x == "a" for x, _ in stack):
                k = max(i for i, (x, _) in enumerate(stack) if x == "a")
                stack[k] = ("", stack[k][1])
            if tag in ("article", "main") and any(out for _, out in stack) and not H._furniture(tag, own, False):
                stack.clear()
            stack.append((tag, H._furniture(tag, own, any(x in ("article", "main") and not out for x, out in stack))))

        def handle_endtag(self, tag):
            if tag in H.BLOCK:
                self.cut()
            if any(x == tag for x, _ in stack):
                del stack[max(i for i, (x, _) in enumerate(stack) if x == tag) :]

        def handle_data(self, data):
            if not any(out for _, out in stack) and not any(x in H.RAW for x, _ in stack):
                self.buffer += data
                if any(x == "a" for x, _ in stack):
                    self.linked += len("".join(data.split()))

    reader = Reader(convert_charrefs=True)
    reader.feed(page)
    reader.close()
    reader.cut()
    labels = [H.classify(*b) for b in blocks]
    out = []
    for i, (t, _, inside) in enumerate(blocks):
        decided = [k for k in range(len(blocks)) if labels[k] is not None]
        before, after = [k for k in decided if k <= i][-1:], [k for k in decided if k >= i][:1]
        near = sorted((abs(i - k), -labels[k]) for k in before + after)
        good = near[0][1] == -H.GOOD if near else inside
        out += [t] * good
    return " ".join(out)


def test_html_equals_plain_rules(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    assert len(pages) > 40
    got = {r.page_id: (r.text, r.n_chars) for r in queries.op4_html_extraction(spark, SF).collect()}
    for r in pages:
        want = plain_extract(r.html)
        assert got[r.page_id] == (want, len(want))


def test_html_undecided_blocks_of_an_article_take_the_nearest_label():
    links = "<p><a href=x>one more story of the site</a></p>"
    assert html_extract.extract(f"<article><p>{STORY}</p><p>Short end.</p>{links * 2}<p>Read more</p>{links}</article>") == f"{STORY} Short end."
    assert html_extract.extract("<article><p>Only short.</p></article>") == "Only short."


def test_line_dedup_small(spark):
    pages = spark.createDataFrame([(i, "h", ["menu", f"own {i}", "menu"]) for i in range(4)] + [(9, "z", ["menu"])], "page_id long, host string, lines array<string>")
    got = {r.page_id: r for r in line_dedup.drop_boilerplate(pages).collect()}
    assert got[0].text == "own 0" and got[0].n_dropped == 2 and got[9].text == "menu"


def test_line_dedup_keeps_unrepeated_lines_of_small_hosts(spark):
    pages = spark.createDataFrame([(i, "three.example", ["menu", f"story {i}", *(["twice"] if i else [])]) for i in range(3)], "page_id long, host string, lines array<string>")
    got = {r.page_id: (r.text, r.n_dropped) for r in line_dedup.drop_boilerplate(pages).collect()}
    assert got == {0: ("story 0", 1), 1: ("story 1", 2), 2: ("story 2", 2)}


TURNS = "conv_id long, turn long, role string, text string"


def test_chat_roles_and_chunks(spark, monkeypatch):
    rows = [(c, t, ("user", "assistant")[t % 2], ("What is it, then?" if t % 2 == 0 else "It is an answer. " * 20)) for c in range(30) for t in range(8)]
    d = spark.createDataFrame(rows, TURNS)
    whole = {(r.conv_id, r.turn): (r.role, r.rendered) for r in chat.parse(d).collect()}
    assert all(whole[c, t][0] == role for c, t, role, _ in rows)
    monkeypatch.setattr(chat, "CHUNK", 3)
    for bits in (10, 1, 0):  # a run of all chunks, of two, of one
        monkeypatch.setattr(chat, "RUN_BITS", bits)
        assert whole == {(r.conv_id, r.turn): (r.role, r.rendered) for r in chat.parse(d).collect()}
    # One conversation and one turn number for all rows, no ids: chunks stay small and every row comes back.
    lost = d.selectExpr("cast(null as long) conv_id", "cast(0 as long) turn", "text", "role")
    from quillgraph.llm._common import numbered

    sizes = [len(r.rows) for r in chat.chunks_of(numbered(lost)).collect()]
    assert max(sizes) <= 3 and sum(sizes) == len(rows) == chat.parse(lost).count()


def test_chat_markers_without_known_roles(spark):
    rows = [
        (1, 0, "User: hi there\nmore\nAssistant: hello"), (2, 0, "[System] : be kind"), (2, 1, "**Human:** what?"), (2, 2, "AI: that"), (3, 0, "Q: how?\nA: so"),
        (4, 0, "user: what is it"), (4, 1, "Answer: 42"), (5, 0, "human> see"), (5, 1, "bot> Note: well\nme: too"), (6, 0, None), (7, 0, ""),
    ]
    got = {(r.conv_id, r.turn): r for r in chat.parse(spark.createDataFrame(rows, "conv_id long, turn long, text string")).collect()}
    assert got[1, 0].rendered == "<|user|>\nhi there\nmore\n<|end|>\n<|assistant|>\nhello\n<|end|>" and got[1, 0].roles == ["user", "assistant"]
    assert [got[2, t].role for t in range(3)] == ["system", "user", "assistant"]
    assert got[3, 0].rendered == "<|user|>\nhow?\n<|end|>\n<|assistant|>\nso\n<|end|>"
    assert got[4, 1].rendered == "<|assistant|>\nAnswer: 42\n<|end|>"
    assert got[5, 0].rendered == "<|user|>\nsee\n<|end|>" and got[5, 1].rendered.startswith("<|assistant|>\nNote: well\n")
    assert got[6, 0].n_lines == 1 and got[6, 0].rendered.endswith("|>\n\n<|end|>")
    clash = spark.createDataFrame(rows, "conv_id long, turn long, text string").withColumns({c: F.lit(1) for c in ("chunk", "rows", "codes", "lines", "states", "tie", "starts")})
    assert {(r.conv_id, r.turn): r for r in chat.parse(clash).collect()} == got


def test_viterbi_and_chunks_equal_enumeration():
    from itertools import product

    rng = np.random.default_rng(3)
    n, width = len(chat.ROLES), int(np.prod(chat.SIZES))
    for _ in range(25):
        model = chat.model_of(rng.random((n, width)) + 0.01, rng.random((n, n)) + 0.01, rng.random(n) + 0.01)
        rows = [rng.integers(0, width, rng.integers(1, 4)).tolist() for _ in range(4)]
        lines = [(c, i == 0 or c >= int(np.prod(chat.SIZES[1:]))) for codes in rows for i, c in enumerate(codes)]

        def score(path, model=model, lines=lines):
            total = model["start"][path[0]]
            for k, (c, free) in enumerate(lines):
                total += model["emit"][path[k], c] + ((model["turn"] if free else model["line"])[path[k - 1], path[k]] if k else 0)
            return total

        best = max(product(range(n), repeat=len(lines)), key=score)
        assert chat.viterbi(model, rows) == list(best)
        cuts = [rows[:1], rows[1:3], rows[3:]]
        ends = chat.chain([chat.chunk_matrix(model, c) for c in cuts], chat.first_scores(model, cuts[0]))
        assert [s for c, (a, b) in zip(cuts, ends) for s in chat.viterbi(model, c, a, b)] == list(best)
        # The same by runs: the first two chunks, and the last one.
        ms, first = [chat.chunk_matrix(model, c) for c in cuts], chat.first_scores(model, cuts[0])
        upto = (first[:, None] + ms[1]).max(axis=0)
        (_, middle), (since, until) = chat.chain([chat.product(ms[:2]), ms[2]], upto)
        assert since == middle and chat.chain(ms[:2], first, None, middle) + chat.chain(ms[2:], first, since, until) == ends


def test_chat_model_counts_the_same_moves_by_runs(spark, monkeypatch):
    from quillgraph.llm._common import numbered

    rng = random.Random(4)
    rows = [(None if c == 0 else c, t, rng.choice(chat.ROLES), "x") for c in range(4) for t in range(60)]
    d = numbered(spark.createDataFrame(rows, TURNS))
    monkeypatch.setattr(chat, "CHUNK", 2)
    models = []
    for bits in (10, 1):
        monkeypatch.setattr(chat, "RUN_BITS", bits)
        models.append(chat.fit(chat.chunks_of(d)))
    assert all((models[0][k] == models[1][k]).all() for k in models[0])
    # Against a plain count: every known role and the one before it in its conversation.
    kept = [c for c in range(4) if c == 0 or zlib.crc32(str(c).encode()) % 5]
    moves, starts = np.ones((3, 3)), np.ones(3)
    for c in kept:
        own = [chat.ROLES.index(r) for k, _, r, _ in rows if k == (c or None)]
        starts[own[0]] += 1
        for a, b in zip(own, own[1:]):
            moves[a, b] += 1
    assert np.allclose(models[0]["turn"], np.log(moves / moves.sum(axis=1, keepdims=True))) and np.allclose(models[0]["start"], np.log(starts / starts.sum()))


def test_chat_held_out_accuracy(spark):
    truth = spark.read.parquet(f"{SF.replace('0.001', '0.01')}/conversations.parquet")
    got = chat.parse(truth).where("held_out").withColumnRenamed("role", "found").join(truth, ["conv_id", "turn"]).collect()
    assert len(got) > 50 and sum(r.found == r.role for r in got) / len(got) > 0.9
    assert {r.conv_id for r in got} == {r.conv_id for r in truth.collect() if zlib.crc32(str(r.conv_id).encode()) % 5 == 0}


def test_shards_are_even_and_mixed(spark):
    rows = [(i, "x" * (i % 50), "big" if i % 3 else f"s{i % 7}") for i in range(2000)]
    out = sharding.shard_documents(docs(spark, rows)).toPandas()
    sizes = out.groupby("shard").size()
    assert sizes.max() - sizes.min() <= 1 and len(sizes) == 16
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in out.groupby("shard"))
    big = out[out.source == "big"].groupby("shard").size()
    assert big.max() - big.min() <= 2


# ---- rows that share an id or have none, and the pipeline against plain code

CLASHES = [
    (None, "one  two three four five six seven"), (None, "eight nine ten eleven twelve thirteen"), (5, "one two three four five six seven"), (5, "eight nine ten eleven twelve thirteen"),
    (7, "a b  c\nd"), (7, "a b  c\nd"), (7, "a b c d"), (None, None), (None, ""), (3, " \t"), (8, "z" * 50), (8, "z" * 50), (-5, "a b c d"),
    (9, "x one two three four five six seven eight nine ten eleven twelve thirteen y"), (9, "one two three four five six seven eight nine ten eleven twelve thirteen"),
]
ITEM = "one two three four five six seven eight nine ten eleven twelve thirteen"


def brute_exact(rows):
    """Indices of the rows that stay."""
    best = {}
    for i, (d, t) in enumerate(rows):
        key = "".join(c for c in t or "" if c not in " \t\n\v\f\r")
        rank = (-len(t or ""), -(2**63) if d is None else d, i)
        best[key] = min(best.get(key, rank), rank)
    return {r[2] for r in best.values()}


def brute_words(text):
    import re

    return [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if w]


def brute_hits(text, items):
    words, hit, found = brute_words(text), set(), set()
    for item_id, item in items:
        own = brute_words(item)
        n = min(13, len(own))
        windows = {tuple(own[s : s + n]) for s in range(len(own) - n + 1)} if own else set()
        for s in range(len(words) - n + 1):
            if own and tuple(words[s : s + n]) in windows:
                hit.update(range(s, s + n))
                found.add(str(item_id))
    return len(words), len(hit), sorted(found)


def test_rows_that_share_an_id_are_rows_of_their_own(spark):
    d = docs(spark, CLASHES, extra=True)
    kept = brute_exact(CLASHES)
    got = exact_dedup.exact_groups(d).collect()
    assert len(got) == len(CLASHES) and sum(r.kept for r in got) == len(kept) == exact_dedup.drop_copies(d).count()
    assert exact_dedup.drop_copies(d).columns == d.columns
    facts = decontaminate.contamination(d, spark.createDataFrame([(1, ITEM)], "item_id long, text string")).collect()
    want = sorted((str(i), *brute_hits(t, [(1, ITEM)])[:2]) for i, t in CLASHES)
    assert sorted((str(r.doc_id), r.n_words, r.n_hit) for r in facts) == want
    near = simhash.near_components(d).collect()
    prints = [(r.doc_id, int(r.fingerprint, 16)) for r in near]
    roots = brute_components([(-(2**63) if i is None else i, p) for i, p in prints], 2)
    assert [r.component_id for r in near] == [None if roots[p] == -(2**63) else roots[p] for _, p in prints]
    groups = brute_components(list(enumerate(p for _, p in prints)), 2)
    assert sum(r.keep for r in near) == len(set(groups.values())) == simhash.drop_near_copies(d).count()


def test_row_numbers_survive_a_shuffle(spark):
    from quillgraph.llm import _common

    for df in (docs(spark, CLASHES).repartition(3), spark.read.parquet(f"{SF}/documents.parquet").where("doc_id % 2 = 0")):
        rows = _common.numbered(df)
        first = {r[_common.ROW]: r.text for r in rows.select(_common.ROW, "text").collect()}
        assert spark.conf.get(_common.CUTS) and len(first) == df.count() and first == {r[_common.ROW]: r.text for r in rows.select("text", _common.ROW, "doc_id").collect()}


def test_no_local_scratch_on_a_cluster(spark):
    from types import SimpleNamespace

    from quillgraph.llm import _common

    session = SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: d), sparkContext=SimpleNamespace(getConf=lambda: {}, master="spark://host:7077"))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        _common.scratch(session, "x")


def test_lm_scores_do_not_depend_on_partitions(spark):
    d = docs(spark, [(i, f"the {'word ' * (i % 9)} {i} of {i % 7} is {'x' * (i % 5)}q") for i in range(300)] + ODD)
    score = lambda df: sorted((str(r.doc_id), r.n_tokens, r.base_score, r.score) for r in lm_scoring.score_documents(df).collect())
    assert score(d.coalesce(1)) == score(d.repartition(8)) == score(d.repartition(3, "text"))


def test_shards_of_rows_without_ids(spark):
    rows = [(None, f"t{i}") for i in range(400)] + [(7, f"u{i}") for i in range(400)] + [(None, None)] * 40
    out = sharding.shard_documents(docs(spark, rows, extra=True)).toPandas()
    sizes = out.groupby("shard").size()
    assert len(out) == len(rows) and sizes.max() - sizes.min() <= 1 and all(sorted(g.slot) == list(range(len(g))) for _, g in out.groupby("shard"))


def test_lines_keep_a_bare_angle(spark):
    pages = spark.createDataFrame([(1, "http://a.b/", "<p>a < b and c > d<br>x<b>z</b>")], "page_id long, url string, html string").withColumns({c: F.lit(1) for c in ("host", "lines", "bad", "n", "kept")})
    assert line_dedup.dedup_page_lines(pages).first().text == "a < b and c > d\nxz"
    assert html_extract.extract_pages(pages.withColumn("text", F.lit(1))).first().page_id == 1


def test_pipeline_equals_plain_code(spark, tmp_path):
    import xxhash

    import corpus_pipeline

    base = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rows = base + [(i, t and t.replace(ITEM, items[0][1])) for i, t in CLASHES] + [base[3], base[4]]
    docs(spark, rows).coalesce(3).write.parquet(str(tmp_path / "documents.parquet"))
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(str(tmp_path / f"{name}.parquet"))
    table = spark.read.parquet(str(tmp_path / "documents.parquet"))
    model = toxicity.fit(*toxicity.training_sample(table, spark.read.parquet(f"{SF}/labels.parquet")))
    score, phrases = toxicity.WindowScorer(model), toxicity.PhraseScorer(model)
    left = [(d, t) for d, t in rows if toxicity.document_score((t or "").encode(), model, score, phrases) < 0.5]
    # No two ties in full differ, so the row numbers of the files don't matter.
    left = [left[i] for i in sorted(brute_exact(left))]

    def fingerprint(text):
        words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
        h = [xxhash.xxh64_intdigest(b" ".join(words[k : k + 3]), 42) for k in range(max(1, len(words) - 2))] if words else []
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    left.sort(key=lambda r: -(2**63) if r[0] is None else r[0])
    prints = [fingerprint(t) for _, t in left]
    roots = brute_components(list(enumerate(prints)), 2)
    near = [left[i] for i in sorted({roots[p] for p in prints})]
    clean = []
    for d, t in near:
        n, hit, _ = brute_hits(t, items)
        if not (hit and 20 * hit >= n):
            clean.append((d, t))
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    got = sorted(str(r.doc_id) for r in packed if r.start == 0)
    assert got == sorted(str(d) for d, _ in clean) and 0 < len(clean) < len(rows)
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.default_tokenizer())
    ids = sorted(tuple([*tok.encode(t or "", add_special_tokens=False).ids, 2]) for _, t in clean)
    assert sum(r.length for r in packed) == sum(map(len, ids))


def test_pipeline_of_nothing(spark, tmp_path):
    import corpus_pipeline

    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_context_tables_are_summed_in_a_tree(spark, monkeypatch):
    d = docs(spark, [(i, f"the {'cat' if i % 3 else 'dog'} sat on mat {i % 7}") for i in range(120)]).repartition(9)
    rows = d.mapInArrow(lm_scoring._gather(10, 16), lm_scoring.MIXED).where("kind = 2").cache()
    most = max(r["count"] for r in rows.groupBy("part").count().collect())
    assert most == 9
    tree = lm_scoring.summed(rows, most, 2)
    assert max(r["count"] for r in tree.groupBy("part").count().collect()) <= 2
    last = lambda x: sorted((r.part, zlib.decompress(r.payload)) for r in x.groupBy("kind", "part").applyInArrow(lm_scoring._merge_cells, lm_scoring.MIXED).collect())
    assert last(tree) == last(rows)
    rows.unpersist()
    want = sorted(map(tuple, lm_scoring.score_documents(d).collect()))
    monkeypatch.setattr(lm_scoring, "MERGED", 2)
    assert sorted(map(tuple, lm_scoring.score_documents(d).collect())) == want
