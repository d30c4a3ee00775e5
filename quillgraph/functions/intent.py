"""Question intent and reference extraction: expressions where SQL can say it, and a row function with a pluggable model."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GENERAL, EXPLAIN, SUMMARIZE, COMPARE, RELATED = "general_qa", "explain_article", "summarize_doc", "compare", "list_related"
INTENTS = (GENERAL, EXPLAIN, SUMMARIZE, COMPARE, RELATED)

# The phrases that name an intent, in order of priority, and what may trail a document's name.
KEYWORDS = {
    COMPARE: ("so sánh", "đối chiếu", "phân biệt", "khác nhau", "khác biệt"),
    RELATED: ("liên quan", "sửa đổi", "thay thế", "bổ sung", "hướng dẫn", "căn cứ", "hết hiệu lực", "văn bản nào", "dẫn chiếu"),
    SUMMARIZE: ("tóm tắt", "tóm lược", "tổng quan", "khái quát", "tóm gọn", "nội dung chính"),
    EXPLAIN: ("giải thích", "giải nghĩa", "phân tích", "làm rõ", "nói rõ", "diễn giải", "giải đáp chi tiết"),
}
READING = ("chi tiết", "đọc")
FILLERS = ("hiện hành", "này", "đó", "trên", "là gì", "ra sao", "như thế nào", "quy định gì", "không", "ạ", "nhé")
ARTICLE = r"(?iu)điều\s+(\d+)"
CLAUSE = r"(?iu)khoản\s+(\d+)"
POINT = r"(?iu)điểm\s+([a-zđ])(?![\p{L}\p{N}_])"
NUMBER = r"(?iu)\d+\s*/\s*\d{2,4}\s*/\s*[0-9a-zđ\-]+"
NAME = r"(?iu)(?:bộ luật|luật|nghị định|thông tư|nghị quyết|quyết định|pháp lệnh|hiến pháp)\s+[^,.;?\n]+"

REFERENCE = "struct<doc_number: string, doc_name: string, article: string, clause: string, point: string>"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def articles(q: Column | str) -> Column:
    return F.regexp_extract_all(_c(q), F.lit(ARTICLE), F.lit(1))


def intent(q: Column | str) -> Column:
    """The first intent whose phrases occur, by priority; reading words explain when an article is named."""
    low = F.lower(_c(q))
    said = lambda phrases: low.rlike("|".join(map(re.escape, phrases)))
    out = F.when(said(KEYWORDS[COMPARE]), COMPARE)
    for name in (RELATED, SUMMARIZE, EXPLAIN):
        out = out.when(said(KEYWORDS[name]), name)
    return out.when(said(READING) & low.rlike(ARTICLE), EXPLAIN).otherwise(GENERAL)


def clean_name(name: Column | str) -> Column:
    """A document name less trailing fillers; NULL if one word or none is left."""
    tail = "|".join(map(re.escape, FILLERS))
    s = F.btrim(F.regexp_replace(F.trim(_c(name)), rf"(?iu)(?:[ ,]*(?:{tail}))+$", ""), F.lit(" ,"))
    return F.when(F.size(F.split(F.trim(s), r"\s+")) > 1, s)


def references(q: Column | str, kind: Column) -> Column:
    """Array of references: document by number, else by name, with the article, clause and point that belong to it."""
    q = _c(q)
    numbers = F.transform(F.regexp_extract_all(q, F.lit(NUMBER), F.lit(0)), lambda x: F.regexp_replace(x, r"\s+", ""))
    names = F.filter(F.transform(F.regexp_extract_all(q, F.lit(NAME), F.lit(0)), clean_name), lambda x: x.isNotNull())
    none = F.lit(None).cast("string")
    docs = F.concat(
        F.transform(numbers, lambda x: F.struct(x.alias("doc_number"), none.alias("doc_name"))),
        F.transform(names, lambda x: F.struct(none.alias("doc_number"), x.alias("doc_name"))),
    )
    arts = articles(q)
    clauses = F.regexp_extract_all(q, F.lit(CLAUSE), F.lit(1))
    points = F.transform(F.regexp_extract_all(q, F.lit(POINT), F.lit(1)), F.lower)
    first = lambda a: F.get(a, F.lit(0))

    def ref(doc, article, clause=none, point=none):
        return F.struct(doc["doc_number"].alias("doc_number"), doc["doc_name"].alias("doc_name"), article.alias("article"), clause.alias("clause"), point.alias("point"))

    two_docs = F.transform(F.slice(docs, 1, 2), lambda x, i: ref(x, F.get(arts, i)))
    one_doc_two_articles = F.transform(F.slice(arts, 1, 2), lambda a: ref(first(docs), a))
    plain = F.array(ref(first(docs), first(arts)))
    full = F.array(ref(first(docs), first(arts), first(clauses), first(points)))
    empty = F.slice(full, 1, 0)
    compared = F.when(F.size(docs) >= 2, two_docs).when((F.size(docs) == 1) & (F.size(arts) >= 2), one_doc_two_articles).otherwise(plain)
    return F.when(F.size(docs) == 0, empty).when(kind == COMPARE, compared).when(kind != GENERAL, full).otherwise(empty)


def sufficient(kind: Column, refs: Column) -> Column:
    return F.when(kind == COMPARE, F.size(refs) >= 2).when(kind == GENERAL, True).otherwise(F.size(refs) >= 1)


def reply_intent(reply: Column | str) -> Column:
    """Intent named by a model's reply, fenced or not; NULL if it names none that exists."""
    body = F.regexp_extract(F.coalesce(_c(reply), F.lit("")), r"\{[\s\S]*\}", 0)
    name = F.lower(F.trim(F.variant_get(F.try_parse_json(F.nullif(body, F.lit(""))), "$.intent", "string")))
    return F.when(name.isin(*INTENTS), name)


def parse_reply(reply: str | None) -> tuple[str, list[dict]] | None:
    """(intent, references with string values) of a model's reply, or None."""
    found = re.search(r"\{[\s\S]*\}", reply or "")
    try:
        data = json.loads(found[0]) if found else None
    except ValueError:
        return None
    if not isinstance(data, dict) or (name := str(data.get("intent", "")).strip().lower()) not in INTENTS:
        return None
    keys = ("doc_number", "doc_name", "article", "clause", "point")
    refs = [{k: None if r.get(k) is None else str(r[k]) for k in keys} for r in data.get("references") or [] if isinstance(r, dict)]
    return name, refs


PROMPT = "Classify the question as one of {intents} and list the documents it refers to. Answer with JSON: {{\"intent\": ..., \"references\": [{{\"doc_number\", \"doc_name\", \"article\", \"clause\", \"point\"}}]}}.\nQuestion: {question}"


def classify(questions: DataFrame, column: str = "question", model: Callable[[str], str] | None = None) -> DataFrame:
    """``questions`` plus intent, references and used_model.

    Phrases decide first. A structured intent without its references asks ``model``, when given,
    for those rows only; without a usable reply the question is a general one.
    """
    kind = intent(column)
    out = questions.withColumn("intent", kind).withColumn("references", references(column, F.col("intent"))).withColumn("_ok", sufficient(F.col("intent"), F.col("references")))
    if model is not None:
        schema = f"struct<intent: string, references: array<{REFERENCE}>>"

        @F.pandas_udf(schema)
        def ask(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                rows = []
                for q in batch:
                    try:
                        got = None if q is None else parse_reply(model(PROMPT.format(intents=", ".join(INTENTS), question=q)))
                    except Exception:  # a failed call counts as no reply
                        got = None
                    usable = got and len([r for r in got[1] if r["doc_number"] or r["doc_name"]]) >= {COMPARE: 2, GENERAL: 0}.get(got[0], 1)
                    rows.append(got if usable else (None, None))
                yield pd.DataFrame(rows, columns=["intent", "references"])

        out = out.withColumn("_reply", ask(F.when(~F.col("_ok"), F.col(column))))
        got = F.col("_reply.intent").isNotNull() & ~F.col("_ok")
    else:
        out, got = out.withColumn("_reply", F.lit(None).cast(f"struct<intent: string, references: array<{REFERENCE}>>")), F.lit(False)
    nothing = F.slice(F.col("references"), 1, 0)
    return out.withColumns(
        {
            "used_model": got,
            "references": F.when(F.col("_ok"), F.col("references")).when(got, F.col("_reply.references")).otherwise(nothing),
            "intent": F.when(F.col("_ok"), F.col("intent")).when(got, F.col("_reply.intent")).otherwise(GENERAL),
        }
    ).drop("_ok", "_reply")
