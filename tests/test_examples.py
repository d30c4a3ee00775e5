"""Operators that read no table, on literal input: the SQL lists the rows that the rule gives, worked out by hand."""

import os
import sys

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from conftest import SF, same  # noqa: E402

from quillgraph.functions import chunker as K  # noqa: E402
from quillgraph.functions import embedding as EM  # noqa: E402
from quillgraph.functions import html as H  # noqa: E402
from quillgraph.functions import intent as I  # noqa: E402
from quillgraph.operators import answer as A  # noqa: E402
from quillgraph.sources import config as C  # noqa: E402
from quillgraph.sources import io as IO  # noqa: E402
from quillgraph.streaming import queue as Q  # noqa: E402


def values(columns: str, *rows: tuple) -> str:
    """Literal rows as SQL."""
    literal = lambda v: "NULL" if v is None else str(v).upper() if isinstance(v, bool) else str(v) if isinstance(v, int) else f"{v!r}::DOUBLE" if isinstance(v, float) else "'" + str(v).replace("'", "''") + "'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(literal, r)) + ')' for r in rows)}) v({columns})"


EXAMPLES: dict = {}


def register(name, sql):
    def keep(f):
        EXAMPLES[name] = f, sql
        return f

    return keep


HEADINGS = ["Chương I", "Mục 2", "Điều 5. Phạm vi", "Dieu 6a", "1. Nội dung", "Khoản 2. Khác", "a) điểm", "đ) điểm", "Điều này", "12.5 m", "chuong"]

QUESTIONS = [
    ("Thuế thu nhập cá nhân được tính như thế nào?", "general_qa", 0), ("Giải thích chi tiết Điều 8 Luật Thuế thu nhập cá nhân", "explain_article", 1), ("Phân tích Điều 12 Khoản 2 của 45/2019/QH14", "explain_article", 1),
    ("Tóm tắt Nghị định 65/2013/NĐ-CP", "summarize_doc", 1), ("Văn bản nào sửa đổi Luật Thuế thu nhập cá nhân?", "list_related", 1), ("So sánh Điều 8 Luật Thuế thu nhập cá nhân và Điều 9 Luật Thuế giá trị gia tăng", "compare", 2),
]


@register("snk4_schema_and_truncate", values("step, n", ("written", 3), ("truncated", 0), ("absent", -1)))
def snk4(s, d):
    import uuid

    schema = f"qg_{uuid.uuid4().hex}"
    IO.create_schema(s, schema)
    IO.create_schema(s, schema)
    s.range(3).write.format("parquet").saveAsTable(f"{schema}.t")
    rows = [("written", s.table(f"{schema}.t").count())]
    IO.truncate(s, f"{schema}.t")
    rows += [("truncated", s.table(f"{schema}.t").count()), ("absent", 0 if IO.truncate(s, f"{schema}.none") else -1)]
    s.sql(f"DROP SCHEMA {schema} CASCADE")
    return s.createDataFrame(rows, "step string, n int")


@register("snk5_collection", values("asked, width, metric", ("cosine", "64", "cosine"), ("dot", "64", "dot"), ("made-up", "64", "cosine")))
def snk5(s, d):
    import uuid

    rows = []
    for asked in ("cosine", "dot", "made-up"):
        name = f"qg_{uuid.uuid4().hex}"
        IO.ensure_collection(s, name, 64, asked)
        found = IO.ensure_collection(s, name, 64, "euclid")  # it is there: stays as it was
        rows.append((asked, found["width"], found["metric"]))
        s.sql(f"DROP TABLE {name}")
    return s.createDataFrame(rows, "asked string, width string, metric string")


SETTINGS = {"QG_TOP_K": '"7"', "QG_ALPHA": " ", "QG_FOLD_D_BAR": "Yes", "QG_SCHEMA": "'gold'", "QG_METRIC": ""}


@register("src13_settings", values("name, value", ("top_k", "7"), ("alpha", "0.7"), ("fold_d_bar", "True"), ("schema", "gold"), ("metric", "cosine"), ("table", "gold.chunks")))
def src13(s, d):
    c = C.from_mapping(SETTINGS, "QG_")
    rows = [(n, str(getattr(c, n))) for n in ("top_k", "alpha", "fold_d_bar", "schema", "metric")] + [("table", c.table("chunks"))]
    return s.createDataFrame(rows, "name string, value string")


def _refused(call, *args, **kw) -> bool:
    try:
        call(*args, **kw)
    except ValueError:
        return True
    return False


@register("flt14_request_checks", values("asked, refused", ("top_k 0", True), ("top_k 20", False), ("top_k 21", True), ("top_k_graph 0", False), ("question of 2", True), ("question of 2000", False), ("rating 6", True), ("rating 5", False), ("limit 101", True), ("limit 100", False)))
def flt14(s, d):
    rows = [
        ("top_k 0", _refused(C.check_search, top_k=0)), ("top_k 20", _refused(C.check_search, top_k=20)), ("top_k 21", _refused(C.check_search, top_k=21)), ("top_k_graph 0", _refused(C.check_search, top_k_graph=0)),
        ("question of 2", _refused(C.check_search, question="ab")), ("question of 2000", _refused(C.check_search, question="x" * 2000)), ("rating 6", _refused(C.check_feedback, 6)), ("rating 5", _refused(C.check_feedback, 5)),
        ("limit 101", _refused(C.check_page, 101)), ("limit 100", _refused(C.check_page, 100)),
    ]
    return s.createDataFrame(rows, "asked string, refused boolean")


@register("flt15_settings_checks", values("asked, refused", ("target 300 limit 200", True), ("alpha 2", True), ("top_k x", True), ("defaults", False)))
def flt15(s, d):
    bad = {"target 300 limit 200": {"QG_CHUNK_TARGET": "300", "QG_CHUNK_LIMIT": "200"}, "alpha 2": {"QG_ALPHA": "2"}, "top_k x": {"QG_TOP_K": "x"}, "defaults": {}}
    return s.createDataFrame([(k, _refused(C.from_mapping, v, "QG_")) for k, v in bad.items()], "asked string, refused boolean")


@register("dt2_current_time", "SELECT TRUE AS one_time, TRUE AS utc FROM range(1)")
def dt2(s, d):
    """All rows of one query carry one time."""
    rows = IO.stamp(s.range(100, numPartitions=4))
    return rows.agg((F.countDistinct("transform_ts") == 1).alias("one_time"), (F.max("transform_ts") <= F.current_timestamp()).alias("utc"))


@register("str3_folded_accents", values("x, folded, kept", ("Điều khoản", "Dieu khoan", "Đieu khoan"), ("Thuế thu nhập cá nhân", "Thue thu nhap ca nhan", "Thue thu nhap ca nhan"), ("đường", "duong", "đuong"), ("éa", "ea", "ea"), ("plain", "plain", "plain"), ("", "", "")))
def str3(s, d):
    rows = [(x, K.fold(x), K.fold(x, False)) for x in ("Điều khoản", "Thuế thu nhập cá nhân", "đường", "éa", "plain", "")]
    return s.createDataFrame(rows, "x string, folded string, kept string")


@register("str8_headings", values("line, level, label", ("Chương I", "chapter", "chuong i"), ("Mục 2", "section", "muc 2"), ("Điều 5. Phạm vi", "article", "dieu 5"), ("Dieu 6a", "article", "dieu 6a"), ("1. Nội dung", "clause", "1. "), ("Khoản 2. Khác", "clause", "khoan 2. "), ("a) điểm", "point", "a) "), ("đ) điểm", "point", "d) "), ("Điều này", None, None), ("12.5 m", None, None), ("chuong", None, None)))
def str8(s, d):
    return s.createDataFrame([(x, *(K.heading(x) or (None, None))) for x in HEADINGS], "line string, level string, label string")


PAGES = [(1, "<p>x<br/>y</p><p>z"), (2, "<head><meta charset=u></head><body><p>hi &amp; bye</p></body>"), (3, "a<script>var x='<p>'</script>b<style>p{}</style>c"), (4, None), (5, "  "), (6, "<ul><li>one</li><li>two</li></ul>")]


def _html(s):
    return s.createDataFrame(PAGES, "id int, html string").select("id", F.coalesce(H.html_to_text("html"), F.lit("")).alias("text"))


# Line ends stand as chr(10) in the SQL.
HTML_ROWS = values("id, text", (1, "x\ny\nz"), (2, "hi & bye"), (3, "abc"), (4, ""), (5, ""), (6, "one\ntwo")).replace("\n", "' || chr(10) || '")


@register("str9_html_to_text", HTML_ROWS)
def str9(s, d):
    return _html(s).withColumn("text", F.regexp_replace("text", "\n+", "\n"))


LAW = "Chương I\nĐiều 1. Theo 45/2019/QH14\n1. một hai ba bốn\n2. năm sáu\nĐiều 2. bảy tám"


@register("udf2_chunker", values("chunk_order, article, clause, n_references", (1, None, None, 0), (2, "dieu 1", None, 1), (3, "dieu 1", "1. ", 0), (4, "dieu 1", "2. ", 0), (5, "dieu 2", None, 0)))
def udf2(s, d):
    law = s.createDataFrame([("x", "n", "t", LAW)], "doc_id string, doc_number string, doc_title string, content_text string")
    return K.chunk_documents(law, overlap=0).select("chunk_order", "article", "clause", F.size("references_to").alias("n_references"))


OVERLAP = "a b.\nc d.\ne f."


@register("win8_overlap", values("chunk_order, text", (1, "a b."), (2, "a b .|c d."), (3, ". c d .|e f.")))
def win8(s, d):
    """Each chunk is prefixed by the last four tokens of the one before, itself already prefixed."""
    text = s.createDataFrame([("x", "n", "t", OVERLAP)], "doc_id string, doc_number string, doc_title string, content_text string")
    return K.chunk_documents(text, target=2, limit=3, overlap=4).select("chunk_order", F.replace("chunk_text", F.lit("\n"), F.lit("|")).alias("text"))


@register("win10_embedding_batches", values("batch, texts, tokens", (1, 3, 9), (2, 1, 20), (3, 3, 5), (4, 3, 3)))
def win10(s, d):
    """In order; a batch closes before it passes three texts or ten tokens; a text over the bound goes alone."""
    sizes = [3, 3, 3, 20, 2, 2, 1, 1, 1, 1]
    got = list(EM.batches(["x" * n for n in sizes], 3, 10, len))
    return s.createDataFrame([(i + 1, len(b), sum(map(len, b))) for i, b in enumerate(got)], "batch int, texts int, tokens int")


@register("stm6_token_buckets", values("request, waited", (1, 0), (2, 0), (3, 30), (4, 60)))
def stm6(s, d):
    """Two requests a minute and a hundred tokens, by a clock that sleep moves."""
    now = [0.0]
    bucket = EM.TokenBuckets(2, 100, 1.0, lambda: now[0], lambda t: now.__setitem__(0, now[0] + t))
    rows = []
    for i, cost in enumerate((10, 10, 10, 10), 1):
        bucket.acquire(cost)
        rows.append((i, round(now[0])))
    return s.createDataFrame(rows, "request int, waited int")


@register("mth5_backoff", "SELECT CAST(n AS INTEGER) AS attempt, least(60.0, 2.0 ** (n - 1))::DOUBLE AS least, least(60.0, 2.0 ** (n - 1) + 5)::DOUBLE AS most, TRUE AS inside FROM range(1, 11) t(n)")
def mth5(s, d):
    rows = []
    for n in range(1, 11):
        found = [EM.backoff(n) for _ in range(50)]
        low, high = EM.backoff(n, jitter=0.0), min(60.0, 2.0 ** (n - 1) + 5)
        rows.append((n, float(low), float(high), all(low <= x <= high for x in found)))
    return s.createDataFrame(rows, "attempt int, least double, most double, inside boolean")


class _Reply:
    def __init__(self, **fields):
        self.__dict__.update(fields)


@register("ret12_embedding_replies", values("shape, task, total", ("object", "RETRIEVAL_QUERY", 3.0), ("mapping", "RETRIEVAL_DOCUMENT", 3.0), ("single", "RETRIEVAL_QUERY", 3.0), ("list", "RETRIEVAL_DOCUMENT", 3.0), ("to_dict", "RETRIEVAL_QUERY", 3.0)))
def ret12(s, d):
    """One text, answered in each shape that services use."""
    shapes = {
        "object": _Reply(embeddings=[_Reply(values=[1, 2])]), "mapping": {"embeddings": [{"values": [1, 2]}]}, "single": {"embedding": [1, 2]}, "list": [[1, 2]], "to_dict": _Reply(to_dict=lambda: {"embeddings": [{"embedding": [1, 2]}]}),
    }
    rows = []
    for i, (name, reply) in enumerate(shapes.items()):
        said = []
        vectors = EM.client(lambda texts, task, reply=reply, said=said: said.append(task) or reply, "document" if i % 2 else "query")(["text"])
        rows.append((name, said[0], sum(map(sum, vectors))))
    return s.createDataFrame(rows, "shape string, task string, total double")


@register("ret8_intents", values("question, intent, n", *QUESTIONS))
def ret8(s, d):
    asked = s.createDataFrame([(q,) for q, _, _ in QUESTIONS], "question string")
    return I.classify(asked).select("question", "intent", F.size("references").alias("n"))


@register("udf5_model_reply", values("question, intent, used_model", ("Giải thích giúp tôi", "general_qa", False), ("Tóm tắt giúp tôi", "summarize_doc", True)))
def udf5(s, d):
    """A structured intent without its references asks a model; a reply without any leaves a general question."""
    asked = s.createDataFrame([("Giải thích giúp tôi",), ("Tóm tắt giúp tôi",)], "question string")
    reply = '```json\n{"intent": "summarize_doc", "references": [{"doc_number": "1/2020/X"}]}\n```'
    return I.classify(asked, model=lambda p: reply if "Tóm tắt" in p else "{}").select("question", "intent", "used_model")


@register("str19_document_names", values("name, cleaned", ("Luật Thuế thu nhập cá nhân", "Luật Thuế thu nhập cá nhân"), ("Luật", None), ("", None)))
def str19(s, d):
    names = s.createDataFrame([("Luật Thuế thu nhập cá nhân",), ("Luật",), ("",)], "name string")
    return names.select("name", I.clean_name("name").alias("cleaned"))


@register("ret11_answers", values("case_name, answer, failed", ("second model", "Answer", False), ("error", "503 down||ctx", True), ("no model", "ctx", False)))
def ret11(s, d):
    """The next model answers where one isn't found; other errors give the error and the context."""

    def _missing(prompt):
        raise RuntimeError("404 NOT_FOUND: no such model")

    def _down(prompt):
        raise RuntimeError("503 down")

    asked = s.createDataFrame([("q", "ctx", "general_qa")], "question string, context string, intent string")
    cases = {"second model": [_missing, lambda p: p[:6]], "error": [_missing, _down, lambda p: "never"], "no model": None}
    out = None
    for name, models in cases.items():
        one = A.synthesize(asked, models).select(F.lit(name).alias("case_name"), F.replace("answer", F.lit("\n"), F.lit("|")).alias("answer"), "failed")
        out = one if out is None else out.unionByName(one)
    return out


ARTICLES = [(1, "Điều 7 mở đầu"), (2, "theo Điều 08 và điều 7"), (3, "tiếp theo"), (4, "Điều 8 nữa, Điều 9"), (5, "Điều 9. khác"), (6, "Điều 8 sau")]
SPAN_SQL = """WITH c(position, text) AS (VALUES (1, 'Điều 7 mở đầu'), (2, 'theo Điều 08 và điều 7'), (3, 'tiếp theo'), (4, 'Điều 8 nữa, Điều 9'), (5, 'Điều 9. khác'), (6, 'Điều 8 sau')),
o AS (SELECT *, max(CASE WHEN regexp_matches(text, '(?i)điều\\s+0*8\\b') THEN 1 ELSE 0 END) OVER (ORDER BY position) AS on_, try_cast(nullif(regexp_extract(text, '(?i)điều\\s+0*(\\d+)\\b', 1), '') AS INTEGER) AS m FROM c),
p AS (SELECT *, lag(on_, 1, 0) OVER (ORDER BY position) AS was FROM o),
f AS (SELECT *, max(CASE WHEN was = 1 AND m IS NOT NULL AND m <> 8 THEN 1 ELSE 0 END) OVER (ORDER BY position) AS off_ FROM p)
SELECT 1 AS question_id, 'chunk' AS kind, 'c' || position AS item FROM f WHERE on_ = 1 AND off_ = 0
UNION ALL SELECT 2, 'fallback', 'h1' UNION ALL SELECT 3, 'related', 'CITES out N2'"""


@register("ret9_structured", SPAN_SQL)
def ret9(s, d):
    """The span of an article that no chunk has as its own; hybrid hits where nothing is found; related documents."""
    docs = s.createDataFrame([("a", "N1", "Luật Thuế thu nhập cá nhân"), ("b", "N2", "Khác")], "doc_id string, doc_number string, title string")
    chunks = s.createDataFrame([("a", f"c{i}", i, t, None) for i, t in ARTICLES], "doc_id string, chunk_uid string, chunk_order int, text string, article string")
    edges = s.createDataFrame([("N1", "N2", "CITES")], "src string, dst string, rel_type string")
    ref = lambda number, name, article: [(number, name, article, None, None)]
    asked = [(1, "explain_article", ref(None, "thuế thu nhập cá", "8")), (2, "summarize_doc", ref("N9", None, None)), (3, "list_related", ref("N1", None, None))]
    intents = s.createDataFrame(asked, "question_id int, intent string, references array<struct<doc_number: string, doc_name: string, article: string, clause: string, point: string>>")
    hits = s.createDataFrame([(i, "h1", 1) for i in (1, 2, 3)], "question_id int, item string, position int")
    return A.structured(intents, docs, chunks, edges, fallback=hits).select("question_id", "kind", "item")


@register("stm9_events", values("kind", ("progress",), ("started",), ("terminated",)))
def stm9(s, d):
    """What a listener hears of one stream."""
    import time

    heard: list[str] = []
    listener = Q.EventListener(lambda e: heard.append(e["kind"]))
    s.streams.addListener(listener)
    try:
        source = IO.scratch_path(s, "stream")
        s.range(5).write.parquet(source)
        IO.consume(IO.file_stream(s, source, "id bigint"), IO.scratch_path(s, "checkpoint"), lambda batch, _: batch.count())
        for _ in range(100):
            if "terminated" in heard:
                break
            time.sleep(0.1)
    finally:
        s.streams.removeListener(listener)
    return s.createDataFrame([(k,) for k in sorted(set(heard) - {"idle"})], "kind string")


@pytest.mark.parametrize("name", sorted(EXAMPLES))
def test_example(spark, duck, name):
    IO.ship(spark)
    query, sql = EXAMPLES[name]
    same(query(spark, SF), duck, sql)
