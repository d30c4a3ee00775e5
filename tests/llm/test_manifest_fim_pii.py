"""Manifest, fill-in-the-middle and personal data, held against plain code."""

import hashlib
import os
import random
import re
import sys
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from quillgraph.llm import _boost, fim, merkle, pii  # noqa: E402
from quillgraph.llm._common import ship  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, root string, path int, tree string, size int, output string, spans string, base int"
ODD = [
    (1, None, "en", "s", None), (2, "", None, "s", 0), (None, "a\nb\nc", "en", None, 5), (None, "a\nb\nc", "en", None, 5), (4, "\n\n\n", "en", "s", 3), (5, "x" * 9_000, "de", "s", 9_000), (6, "word " * 40_000 + "\n" * 5000, "", "s", 2**63 - 1),
    (7, "a <P> b\nc", "en", "s", 9), (7, "d\ne\n", "en", "s", 4), (7, "d\ne\n", "en", "s", 4), (8, "Ünï\ncôdé\n’ 日本", "fr", "s", 13), (9, "no end", "en", "s", 6), (-3, "minus\n", "en", "s", 6),
]


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    ship(spark)


def docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, source, n, "r", 1, "t", 2, "o", "s", 3) for i, t, lang, source, n in rows], SCHEMA)


# ---- manifest


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(i, text, lang, source, n):
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (i, source, lang, n, text)))


def plain_tree(leaves):
    """Root, and for each leaf the siblings with their sides."""
    paths, nodes, holds = [[] for _ in leaves], list(leaves), [[i] for i in range(len(leaves))]
    while len(nodes) > 1:
        new, kept = [], []
        for i in range(0, len(nodes), 2):
            run = nodes[i : i + 2]
            if len(run) == 2:
                for k in holds[i]:
                    paths[k].append(("R", run[1]))
                for k in holds[i + 1]:
                    paths[k].append(("L", run[0]))
            else:
                for k in holds[i]:
                    paths[k].append(("", ""))
            new.append(H(*run))
            kept.append(sum(holds[i : i + 2], []))
        nodes, holds = new, kept
    return nodes[0], paths


def plain_manifest(rows):
    order = sorted(rows, key=lambda r: ((r[2] is not None, (r[2] or "").encode()), (r[0] is not None, r[0] or 0), plain_leaf(*r)))
    langs = list(dict.fromkeys(r[2] for r in order))
    trees = {lang: plain_tree([plain_leaf(*r) for r in order if r[2] == lang]) for lang in langs}
    root, over = plain_tree([trees[lang][0] for lang in langs])
    out, seen = [], dict.fromkeys(langs, 0)
    for r in order:
        k = seen[r[2]]
        seen[r[2]] += 1
        path = trees[r[2]][1][k] + over[langs.index(r[2])]
        digest = plain_leaf(*r)
        if r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0:
            digest = plain_leaf(*r[:4], r[4] + 1)
        for side, sibling in path:
            digest = H(sibling, digest) if side == "L" else H(digest, sibling)
        out.append((r[0], plain_leaf(*r), trees[r[2]][0], root, H(*(x for _, x in path)), digest, digest == root))
    return out


def told(df):
    return sorted(map(repr, (tuple(r) for r in df.collect())))


@pytest.mark.parametrize("bits", [2, 10])
def test_manifest_of_odd_rows(spark, bits):
    out = merkle.tamper_report(docs(spark, ODD), bits)
    assert told(out) == sorted(map(repr, plain_manifest(ODD)))


@pytest.mark.parametrize("n", [0, 1, 9, 70])
def test_manifest_of_every_shape(spark, n):
    rng = random.Random(n)
    rows = [(i, f"t{i}", rng.choice(["en", "en", "en", "de", None]), "s", i) for i in rng.sample(range(1000), n)]
    out = merkle.tamper_report(docs(spark, rows).repartition(5), 2)
    assert told(out) == sorted(map(repr, plain_manifest(rows) if rows else []))
    assert n < 70 or {r.verified for r in out.collect()} == {True, False}


def test_manifest_keeps_real_proofs(spark):
    made = merkle.manifest_of(docs(spark, [(i, str(i), "en" if i % 3 else "de", "s", 1) for i in range(40)]), bits=2)
    good = merkle.verified(made, ("doc_id",)).collect()
    assert len(good) == 40 and all(r.verified for r in good)
    bad = merkle.verified(made.withColumn("leaf", F.unhex(F.sha2("tree", 256))), ("doc_id",)).collect()
    assert not any(r.verified for r in bad)


def test_one_tree_is_split_over_blocks_and_parts(spark):
    rows = docs(spark, [(i, "t", "en", "s", 1) for i in range(3000)]).repartition(8)
    nodes = merkle.placed(rows.select(F.lit("t").alias("tree"), "doc_id"), ["doc_id"])
    got = nodes.orderBy("pos").collect()
    assert [r.pos for r in got] == list(range(3000)) == [r.doc_id for r in got] and {r.size for r in got} == {3000}


# ---- fill in the middle


def plain_fim(i, text):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(m in text for m in fim.MARKS) or h3 % 100 >= 100:
        return i, len(units), "plain", None, None, text
    if h4 % 100 < 50:
        return i, len(units), "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return i, len(units), "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def texts(n):
    rng = random.Random(n)
    return [(i, "".join(rng.choice(["a", "é", "日", "\n", "\n", " ", "\r", "<", "P", ">", "<M>"] if i % 5 else ["ab", "\n", "x"]) for _ in range(rng.randint(0, 60))), "en", "s", 1) for i in range(n)]


def test_fim_equals_plain_code(spark):
    rows = ODD + texts(200)
    got = fim.round_trip(docs(spark, rows)).collect()
    want = [plain_fim(r[0], r[1]) for r in rows]
    assert sorted(map(repr, ((*tuple(r)[:6],) for r in got))) == sorted(map(repr, want))
    for r in got:
        assert r.output_sha256 == hashlib.sha256(r.output.encode()).hexdigest()
    kept = sorted(hashlib.sha256((r[1] or "").encode()).hexdigest() for r in rows)
    assert sorted(r.restored_sha256 for r in got) == kept
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_fim_parameters_and_inverse(spark):
    rows = docs(spark, texts(100))
    none = fim.fill_in_middle(rows, rate=0)
    assert {r.form for r in none.collect()} == {"plain"}
    assert {r.form for r in fim.fill_in_middle(rows, spm=100).collect()} == {"plain", "spm"}
    marks = ("[PRE]", "[SUF]", "[MID]")
    back = fim.restore(fim.fill_in_middle(rows, marks=marks, seed="x"), marks)
    assert dict(back.select("doc_id", "text").collect()) == {r[0]: r[1] for r in texts(100)}
    assert fim.fill_in_middle(rows.limit(0)).count() == 0 == fim.round_trip(rows.limit(0)).count()
    with pytest.raises(ValueError):
        fim.fill_in_middle(rows, marks=("<P>", "<P>", "<M>"))


# ---- personal data

PLAIN = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def plain_spans(text):
    out = []
    for kind, p in enumerate(PLAIN):
        for m in re.finditer(p, text):
            x, d = m.group(), re.sub("[^0-9]", "", m.group())
            total = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) if d else 1
            if kind == 0 or kind == 1 and all(int(v) <= 255 for v in x.split(".")) or kind == 2 and 13 <= len(d) <= 19 and total % 10 == 0 or kind == 3 and 9 <= len(d) <= 15:
                out.append((kind, m.start(), m.end()))
    return out


@settings(max_examples=600, deadline=None)
@given(st.lists(st.sampled_from(["a", "b.c", "@", "@", ".", "x-y", "%", "+", "1", "25", "255", "256", "0", "4111111111111111", "4111 1111 1111 1111", "-", " ", "  ", "(", ")", "\n", "é", "+1 (555) 555-0100", "１"]), max_size=14))
def test_rules_equal_the_plain_patterns(parts):
    text = "".join(parts)
    assert pii.rule_spans(text) == plain_spans(text)


def test_long_texts_take_linear_time():
    import time

    for text in ("x" * 400_000, "1" * 400_000, "1 " * 30_000, "a@" * 60_000, "+1" * 60_000, "1." * 30_000, "a at " * 40_000, "::" * 60_000, "((" * 60_000, "0" * 9000 + ".1.1.1"):
        began = time.perf_counter()
        assert isinstance(pii.told(pii._kept(pii.rule_spans(text), [(0.5, s) for s in pii.candidates(text)])), str)
        assert time.perf_counter() - began < 8, text[:10]


def prose(seed, n=60):
    rng = random.Random(seed)
    words = ["the", "at", "of", "dot", "and", "No", "call", "it.", "That,", "was"] + ["".join(rng.choice("aeinorst") for _ in range(rng.randint(2, 9))) for _ in range(200)]
    return [" ".join(rng.choice(words) for _ in range(80)) for _ in range(n)]


@pytest.fixture(scope="module")
def model():
    return pii.learn(prose(1), 4000)


def test_held_out_examples(model):
    x, y = pii.examples(prose(2), 2500, seed=77)
    picked = model.chances(x) >= np.array(model.least)[x[:, :4].argmax(1)]
    assert (picked & y).sum() >= 0.93 * y.sum() and (picked & ~y).sum() <= 0.03 * picked.sum()


def test_added_spans(spark, model):
    rows = [(1, "reach me: ann.b (at) host (dot) org please", "en", "s", 1), (2, "he looked at the moon. It was late", "en", "s", 1), (3, "see 2353820953013749 4845168114407329 there", "en", "s", 1), (4, "call (243) 555-5526 now", "en", "s", 1), (5, None, "en", "s", 1), (6, "mail x@y.zz and 1.2.3.4, 2024-01-30 12:00:00", "en", "s", 1)]
    got = {r.doc_id: r for r in pii.detect(docs(spark, rows), model=model).collect()}
    assert got[1].spans == "email:10:35" and got[1].n_email == 0 and got[1].redacted == "reach me: [EMAIL] please"
    assert got[2].spans == "" and got[5].spans == "" and got[5].redacted == ""
    assert got[3].spans == "card:21:37" and got[3].base == "" and got[4].spans == "phone:5:19"
    assert got[6].spans == got[6].base == "email:5:11,ip:16:23" and got[6].redacted.startswith("mail [EMAIL] and [IP],")


def test_report_holds_the_rules_and_scores_alike_however_cut(spark):
    rng = random.Random(3)
    rows = ODD + [(100 + i, " ".join(rng.choice(["w", "ann@b.org", "+1 (243) 555-5526", "4417744280351547", "1.2.3.4", "12", "x at y dot com"]) for _ in range(12)), "en", "s", 1) for i in range(60)]
    one, many = pii.report(docs(spark, rows)).collect(), pii.report(docs(spark, rows).repartition(7)).collect()
    assert sorted(map(repr, one)) == sorted(map(repr, many)) and len(one) == len(rows)
    for r, want in zip(sorted(one, key=lambda r: (r.doc_id or 0, r.base_sha256)), sorted(((r[0] or 0, hashlib.sha256(pii.told(plain_spans(r[1] or "")).encode()).hexdigest(), plain_spans(r[1] or "")) for r in rows), key=lambda x: x[:2])):
        assert r.base_sha256 == want[1]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in want[2]) for k in range(4)]
        every = [s for s in r.spans.split(",") if s]
        assert set(pii.told(want[2]).split(",")) - {""} <= set(every)
    assert pii.report(docs(spark, [])).count() == 0


def test_trees_learn_and_calibrate():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 4))
    y = (x[:, 0] > 0) ^ (x[:, 1] > 0.3)
    t = _boost.fit(x[:2000], y[:2000])
    m = t.margins(x[2000:])
    assert ((m > 0) == y[2000:]).mean() > 0.95
    c = _boost.chances(m, _boost.calibrated(m, y[2000:]))
    assert (np.diff(c[np.argsort(m)]) >= -1e-12).all() and c.min() >= 0 and c.max() <= 1
    assert len(_boost.fit(np.zeros((0, 2)), np.zeros(0)).margins(np.zeros((3, 2)))) == 3
