"""What is built from hits: citations, budgets, spans and context strings."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import lookup as L


def citations(hits: DataFrame, key: str, rank: str) -> DataFrame:
    """The best-ranked hit of each key; hits with a blank key go."""
    order = Window.partitionBy(key).orderBy(rank)
    kept = hits.where(F.col(key).isNotNull() & (F.trim(F.col(key).cast("string")) != ""))
    return kept.withColumn("_rn", F.row_number().over(order)).where("_rn = 1").drop("_rn")


def within_budget(chunks: DataFrame, by: str, order: str, text: str, limit: int) -> DataFrame:
    """Chunks of each group in order while their summed length stays within the limit; the first always."""
    w = Window.partitionBy(by).orderBy(order)
    summed = chunks.withColumn("cum", F.sum(F.length(text)).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_rn", F.row_number().over(w))
    return summed.where((F.col("cum") <= limit) | (F.col("_rn") == 1)).drop("_rn")


def span(chunks: DataFrame, by: str, order: str, key: Column, wanted: str) -> DataFrame:
    """From the first chunk whose key is ``wanted`` up to the chunk before the first with another key."""
    w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    keyed = chunks.withColumn("_k", key).withColumn("_on", F.max((F.col("_k") == wanted).cast("int")).over(w))
    stop = (F.col("_on") == 1) & (F.col("_k") != "") & (F.col("_k") != wanted)
    return keyed.withColumn("_off", F.max(stop.cast("int")).over(w)).where("_on = 1 and _off = 0").drop("_k", "_on", "_off")


def context(hits: DataFrame) -> DataFrame:
    """hits(rank, header, score, text), a bounded top-k -> one numbered context string."""
    line = lambda x: F.concat(F.lit("["), x["rank"].cast("string"), F.lit("] "), x["header"], F.lit(" (score: "), F.format_string("%.3f", x["score"]), F.lit(")\n"), x["text"])
    every = hits.agg(F.array_sort(F.collect_list(F.struct("rank", "header", "score", "text"))).alias("rows"))
    return every.select(F.array_join(F.transform("rows", line), "\n").alias("context"))


#: What each intent asks of the model; ``{context}`` and ``{question}`` are filled in.
PROMPTS = {
    "general_qa": "Answer the question from the numbered passages only and cite them.\n\n{context}\n\nQuestion: {question}",
    "explain_article": "Explain the article below in plain words, clause by clause, and name its document.\n\n{context}\n\nQuestion: {question}",
    "summarize_doc": "Summarise the document below: scope, main rules, dates, duties.\n\n{context}\n\nQuestion: {question}",
    "compare": "Compare the two texts below point by point: what agrees, what differs.\n\n{context}\n\nQuestion: {question}",
    "list_related": "List the related documents below with their relation and direction.\n\n{context}\n\nQuestion: {question}",
}


def prompt(intent: Column, context: Column, question: Column) -> Column:
    text = F.lit(PROMPTS["general_qa"])
    for name, template in PROMPTS.items():
        text = F.when(intent == name, F.lit(template)).otherwise(text)
    return F.replace(F.replace(text, F.lit("{context}"), F.coalesce(context, F.lit(""))), F.lit("{question}"), F.coalesce(question, F.lit("")))


#: Intents whose answers are worth reasoning over; others get no budget for it.
REASONING = frozenset(("explain_article", "summarize_doc", "compare"))


def thinking_budget(intent: Column, budget: int) -> Column:
    return F.when(intent.isin(*REASONING), F.lit(budget)).otherwise(F.lit(0))


def first_known(models: list[Callable[[str], str]], missing: str = "NOT_FOUND") -> Callable[[str], str]:
    """The first of several models that exists: the next is asked only where one says that it isn't found."""
    models = list(dict.fromkeys(models))
    if not models:
        raise ValueError("no model given")

    def ask(prompt: str) -> str:
        for i, model in enumerate(models):
            try:
                return model(prompt)
            except Exception as error:
                if missing not in str(error) or i + 1 == len(models):
                    raise
        raise AssertionError

    return ask


def synthesize(rows: DataFrame, model: Callable[[str], str] | list[Callable[[str], str]] | None = None, question: str = "question", context: str = "context", intent: str = "intent") -> DataFrame:
    """rows(question, context, intent) plus answer and failed.

    ``model`` is a callable prompt -> text that runs on the executors, or a list of them in order of preference.
    Where it fails, or is absent, the answer is the context itself (after the error), so what was found is never lost.
    """
    asked = rows.withColumn("_prompt", prompt(F.col(intent), F.col(context), F.col(question)))
    if model is None:
        return asked.withColumn("answer", F.coalesce(F.col(context), F.lit(""))).withColumn("failed", F.lit(False)).drop("_prompt")
    call = first_known(model) if isinstance(model, list) else model

    @F.pandas_udf("struct<answer: string, failed: boolean>")
    def ask(prompts: pd.Series, contexts: pd.Series) -> pd.DataFrame:
        out = []
        for p, c in zip(prompts, contexts):
            try:
                out.append((call(p), False))
            except Exception as error:
                out.append((f"{error}\n\n{c or ''}", True))
        return pd.DataFrame(out, columns=["answer", "failed"])

    return asked.withColumn("_a", ask("_prompt", context)).select("*", "_a.answer", "_a.failed").drop("_prompt", "_a")


SUMMARY_CHARS = 24_000
COMPARE_CHUNKS = 8
#: An article's number where a text names one, as in "Điều 8".
ARTICLE = r"(?iu)điều\s+0*(\d+)\b"


def article_chunks(chunks: DataFrame, group: str = "group", wanted: str = "article", order: str = "chunk_order") -> DataFrame:
    """chunks(group, article asked for, in_article, text, ...) -> those of the article.

    By the chunk's own article number; in a group where no chunk has it, the span from the first chunk whose text names
    the article up to the next that names another. A group whose article is null keeps all chunks.
    """
    w = Window.partitionBy(group)
    so_far = w.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    number = F.col(wanted).try_cast("int")
    keyed = chunks.withColumn("_own", F.regexp_extract(F.lower(F.coalesce("in_article", F.lit(""))), r"\d+", 0).try_cast("int").eqNullSafe(number) & number.isNotNull())
    keyed = keyed.withColumn("_by_field", F.max(F.col("_own").cast("int")).over(w))
    every = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(ARTICLE), F.lit(1))
    first = F.get(every, F.lit(0)).try_cast("int")
    keyed = keyed.withColumn("_on", F.max(F.coalesce(F.array_contains(F.transform(every, lambda x: x.try_cast("int")), number), F.lit(False)).cast("int")).over(so_far))
    before = F.lag("_on", 1, 0).over(w.orderBy(order))  # the span's first chunk may name another article first
    keyed = keyed.withColumn("_stop", ((before == 1) & first.isNotNull() & (first != number)).cast("int"))
    keyed = keyed.withColumn("_off", F.max("_stop").over(so_far))
    kept = number.isNull() | (F.col("_by_field") == 1) & F.col("_own") | (F.col("_by_field") == 0) & (F.col("_on") == 1) & (F.col("_off") == 0)
    return keyed.where(kept).drop("_own", "_by_field", "_on", "_stop", "_off")


def found_documents(refs: DataFrame, documents: DataFrame, article: str = "article") -> DataFrame:
    """refs(question_id, intent, ref, doc_number, doc_name, article) -> those with their document: by number, else by a title that contains the name
    (the shortest title, then doc_id).

    Names meet titles by their rarest run of characters, so that no title is compared with every name.
    """
    docs = documents.select("doc_id", "doc_number", "title")
    cols = ["question_id", "intent", "ref", F.col(article).cast("string").alias("article"), "doc_id", "doc_number", "cost"]
    by_number = refs.where("doc_number is not null").drop("doc_name").join(docs.drop("title"), "doc_number").withColumn("cost", F.lit(0)).select(*cols)
    named = refs.where("doc_number is null and trim(coalesce(doc_name, '')) <> ''").drop("doc_number")
    named = named.withColumn("key", F.concat_ws(":", "question_id", "ref"))
    pairs = L.containing(named.select("key", F.col("doc_name").alias("name")).distinct(), docs.select(F.col("doc_id").alias("id"), F.col("title").alias("text")))
    by_name = named.join(pairs.distinct(), "key").join(docs.withColumnRenamed("doc_id", "id"), "id").withColumn("cost", F.length("title")).withColumnRenamed("id", "doc_id").select(*cols)
    found = citations(by_number.unionByName(by_name).withColumn("_key", F.concat_ws(":", "question_id", "ref")), "_key", F.struct("cost", "doc_id"))
    return found.drop("_key", "cost")


def structured(intents: DataFrame, documents: DataFrame, chunks: DataFrame, edges: DataFrame, article: str = "article", fallback: DataFrame | None = None) -> DataFrame:
    """intents(question_id, intent, references) -> question_id, ref, kind, chunk_uid or related document, position.

    Related documents for list_related; the document within a character budget for summarize_doc; the article's
    chunks, else all, of the first reference for explain_article; the first eight chunks each of the first two for compare. Only
    the first reference counts otherwise. Questions for which nothing is found take their rows of ``fallback``(question_id,
    item, position), such as a hybrid search's hits, as kind "fallback".
    """
    refs = intents.select("question_id", "intent", F.posexplode("references").alias("ref", "r")).select("question_id", "intent", "ref", "r.*")
    refs = refs.where("ref = 0 or intent = 'compare' and ref = 1")
    found = found_documents(refs, documents, article)
    texts = found.where("intent <> 'list_related'").join(chunks.select("doc_id", "chunk_uid", "chunk_order", "text", F.col("article").alias("in_article")), "doc_id")
    texts = texts.withColumn("group", F.concat_ws(":", "question_id", "ref"))
    budget = within_budget(texts.where("intent = 'summarize_doc'"), "group", "chunk_order", "text", SUMMARY_CHARS).drop("cum")
    order = Window.partitionBy("group").orderBy("chunk_order")
    others = article_chunks(texts.where("intent <> 'summarize_doc'")).withColumn("_n", F.row_number().over(order)).where(f"intent <> 'compare' or _n <= {COMPARE_CHUNKS}").drop("_n")
    passages = budget.unionByName(others).select("question_id", "ref", F.lit("chunk").alias("kind"), F.col("chunk_uid").alias("item"), F.col("chunk_order").cast("long").alias("position"))
    asked = found.where("intent = 'list_related'").select("question_id", "ref", F.col("doc_number").alias("center"))
    out = asked.join(edges, F.col("center") == F.col("src")).select("question_id", "ref", F.concat_ws(" ", "rel_type", F.lit("out"), "dst").alias("item"))
    into = asked.join(edges, F.col("center") == F.col("dst")).select("question_id", "ref", F.concat_ws(" ", "rel_type", F.lit("in"), "src").alias("item"))
    related = out.unionByName(into).distinct().select("question_id", "ref", F.lit("related").alias("kind"), "item", F.lit(None).cast("long").alias("position"))
    rows = passages.unionByName(related)
    if fallback is None:
        return rows
    lost = intents.select("question_id").join(rows.select("question_id"), "question_id", "left_anti")
    spare = fallback.join(lost, "question_id", "left_semi")
    return rows.unionByName(spare.select("question_id", F.lit(None).cast("int").alias("ref"), F.lit("fallback").alias("kind"), "item", F.col("position").cast("long").alias("position")))
