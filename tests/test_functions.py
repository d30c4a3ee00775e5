import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillgraph.functions import chunker, embedding, html, intent
from quillgraph.functions import text as T
from quillgraph.sources import config


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first().y


def test_text_rules(spark):
    assert one(spark, "  a\r\n\n  b ", T.normalize_lines) == "a\nb"
    assert one(spark, "111/2013/TT-BTC và 45/2019/QH14", T.doc_references) == ["111/2013/TT-BTC", "45/2019/QH14"]
    assert one(spark, "65/2013/NĐ-CP", lambda x: T.doc_references(x, wide=True)) == ["65/2013/NĐ-CP"]
    assert one(spark, "12/2020/NQ-HĐND", T.doc_references) == ["12/2020/NQ-"]
    assert one(spark, "  ", T.blank_to_null) is None
    assert one(spark, " sửa đổi ", T.relation_name) == "SỬA_ĐỔI"
    assert one(spark, " ", T.relation_name) == "REFERS_TO"
    assert one(spark, "VĂN_BẢN_CĂN_CỨ", T.relation_label) == "căn cứ"
    assert one(spark, "2020-06-05", T.iso_date).isoformat() == "2020-06-05"
    assert one(spark, "15/06/2020", T.iso_date) is None
    assert one(spark, None, T.token_count) == 0


def test_html_to_text():
    assert html.text_of("<p>x<br/>y<meta/>z") == "x\nyz"
    assert html.text_of("<head><meta charset=u></head><body><p>hi &amp; bye</p>") == "hi & bye"
    assert html.text_of("a<script>var x = '<p>'</script><style>p{}</style>b") == "ab"
    assert html.text_of(" ") is None and html.text_of(None) is None


LAW = "Chương I\nMục 1\nĐiều 5. Phạm vi\n1. Khoản một.\na) điểm a\nđ) điểm đ\nKhoản 2. Theo 111/2013/TT-BTC;"


def test_chunker_headings_and_flags():
    chunks = chunker.split(LAW, overlap=0)
    assert [c.place["article"] for c in chunks][-1] == "dieu 5"
    assert chunks[-1].place["clause"].startswith("khoan 2") and chunks[-1].place["point"] is None
    assert chunks[-1].references == ["111/2013/TT-BTC"]
    compat = chunker.split(LAW, overlap=0, fold_d=False)
    assert all(c.place["article"] is None for c in compat)
    with pytest.raises(ValueError):
        chunker.split("x", target=10, limit=5)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab .;1)", min_size=0, max_size=30), max_size=40), st.integers(3, 9))
def test_chunker_bounds(lines, limit):
    chunks = chunker.split("\n".join(lines), target=3, limit=limit, overlap=2)
    assert [x for c in chunks for x in c.lines] == [s for s in (x.strip() for x in lines) if s]
    for before, c in zip([None, *chunks], chunks):
        n = sum(len(chunker.TOKEN.findall(x)) for x in c.lines)
        assert len(c.lines) == 1 or n <= limit
        assert before is None or c.text.startswith(" ".join(before.tokens[-2:]))


def test_chunk_rows(spark):
    docs = spark.createDataFrame([("d 1", "n", "t", LAW), ("e", None, None, None)], "doc_id string, doc_number string, doc_title string, content_text string")
    rows = chunker.chunk_documents(docs).orderBy("chunk_order").collect()
    assert rows[0].chunk_uid == "d_1__00001" and {r.doc_id for r in rows} == {"d 1"}


QUESTIONS = {
    "Thuế thu nhập cá nhân được tính như thế nào?": ("general_qa", []),
    "Giải thích chi tiết Điều 8 Luật Thuế thu nhập cá nhân": ("explain_article", [(None, "Luật Thuế thu nhập cá nhân", "8")]),
    "Phân tích Điều 12 Khoản 2 của 45/2019/QH14": ("explain_article", [("45/2019/QH14", None, "12")]),
    "Tóm tắt Nghị định 65/2013/NĐ-CP": ("summarize_doc", [("65/2013/NĐ-CP", None, None)]),
    "Văn bản nào sửa đổi Luật Thuế thu nhập cá nhân?": ("list_related", [(None, "Luật Thuế thu nhập cá nhân", None)]),
    "So sánh Điều 8 Luật Thuế thu nhập cá nhân và Điều 9 Luật Thuế giá trị gia tăng": ("compare", None),
    "Giải thích giúp tôi": ("general_qa", []),
}


def test_intents(spark):
    df = spark.createDataFrame([(q,) for q in QUESTIONS], "question string")
    for r in intent.classify(df).collect():
        kind, refs = QUESTIONS[r.question]
        assert r.intent == kind and not r.used_model
        if refs is not None:
            assert [(x.doc_number, x.doc_name, x.article) for x in r.references] == refs
    assert intent.parse_reply('```json\n{"intent": "compare", "references": [{"article": 8}]}\n```') == ("compare", [dict(doc_number=None, doc_name=None, article="8", clause=None, point=None)])
    assert intent.parse_reply('{"intent": "dance"}') is None and intent.parse_reply(None) is None


def test_intent_model_fallback(spark):
    model = lambda prompt: '{"intent": "explain_article", "references": [{"doc_number": "1/2020/QH1"}]}'
    r = intent.classify(spark.createDataFrame([("Giải thích giúp tôi",)], "question string"), model=model).first()
    assert r.intent == "explain_article" and r.used_model and r.references[0].doc_number == "1/2020/QH1"


def test_embedding_helpers():
    assert list(embedding.batches(["a" * 40] * 5, most=2)) == [["a" * 40] * 2, ["a" * 40] * 2, ["a" * 40]]
    assert list(embedding.batches(["x" * 100, "y"], most_tokens=5)) == [["x" * 100], ["y"]]
    now = [0.0]
    buckets = embedding.TokenBuckets(60, 600, 1.0, lambda: now[0], lambda s: now.__setitem__(0, now[0] + s))
    for _ in range(61):
        buckets.acquire(1)
    assert now[0] == pytest.approx(1.0)
    with pytest.raises(ValueError):
        buckets.acquire(601)
    calls = []

    def flaky(texts):
        calls.append(1)
        if len(calls) < 3:
            raise RuntimeError("429 quota")
        return [[0.0]] * len(texts)

    assert embedding.retrying(flaky, sleep=lambda s: None)(["a"]) == [[0.0]] and len(calls) == 3
    assert embedding.hashing_embedder(8)(["a b"]) == embedding.hashing_embedder(8)(["A  B"])


def test_settings():
    s = config.from_mapping({"QUILLGRAPH_TOP_K": "7", "QUILLGRAPH_FOLD_D_BAR": "'no'", "QUILLGRAPH_SCHEMA": " "})
    assert s.top_k == 7 and s.fold_d_bar is False and s.table("x") == "default.x"
    with pytest.raises(ValueError):
        config.from_mapping({"QUILLGRAPH_TOP_K": "many"})
    with pytest.raises(ValueError):
        config.from_mapping({"QUILLGRAPH_CHUNK_TARGET": "900"})
