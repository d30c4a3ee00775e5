"""Benchmark decontamination by a distributed positional inverted index, in DataFrame operations alone.

1. Terms of the test items are counted over the whole corpus.
2. Every 13-word window of an item names its two rarest terms. The index holds the corpus
   postings (term, document, position) of such terms and is written to the shared folder.
3. Postings become alignments (document, item, position difference); the lists of a window's
   rarest and second rarest term are intersected on the alignment. What is left is small.
4. The remaining terms of the item are intersected the same way, from the postings of the
   documents still in question. Runs of 13 aligned words are exact phrase matches; alignments
   with the two rarest terms of a window and at least ``NEAR`` aligned words in 13, but no whole
   window, are proximity matches.

Nothing pairs documents with documents; a passage in a third of all documents gives one
alignment for each of them. Sides are broadcast only under ``BROADCAST_ROWS`` and ``BROADCAST_BYTES``, both counted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import ROW, numbered, stored, without_rows

WINDOW = 13
NEAR = 9
RATIO = 20
BROADCAST_ROWS, BROADCAST_BYTES = 1_000_000, 64 << 20
SPLIT = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _split(text: Column) -> Column:
    """Words after lower-casing A-Z, with an empty string before and after where delimiters stand there."""
    return F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), SPLIT, -1)


def _ends(parts: Column) -> tuple[Column, Column]:
    lead = (F.get(parts, F.lit(0)) == "").cast("int")
    words = F.size(parts) - lead - (F.element_at(parts, -1) == "").cast("int")
    return lead, F.greatest(words, F.lit(0)).cast("long")


def _small(df: DataFrame) -> DataFrame:
    """``df`` marked for broadcast if it has few rows and few bytes; else left to a shuffled join."""
    width = sum((F.coalesce(F.octet_length(c), F.lit(0)) for c, t in df.dtypes if t == "string"), F.lit(8 * len(df.columns)))
    rows, size = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(width.cast("long")), F.lit(0))).first()
    return F.broadcast(df) if rows <= BROADCAST_ROWS and size <= BROADCAST_BYTES else df


def item_words(benchmark: DataFrame) -> DataFrame:
    """benchmark(item_id, text) -> item_id string, words; items without words go. One row an (id, text)."""
    parts = F.filter(_split(F.col("text")), lambda x: x != "")
    return benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), parts.alias("words")).where(F.size("words") > 0).distinct()


def postings(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """docs(row number, text), terms(term) -> term, row, pos: every place of each of the terms."""
    parts = docs.select(ROW, _split(F.col("text")).alias("parts"))
    lead, _ = _ends(F.col("parts"))
    placed = parts.select(ROW, lead.alias("lead"), F.posexplode("parts").alias("at", "term"))
    return placed.join(_small(terms), "term").select("term", ROW, (F.col("at") - F.col("lead")).alias("pos"))


def phrase_matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, near: int = NEAR) -> DataFrame:
    """docs(row number, text), benchmark(item_id, text) -> row, item, item_id, shift, first, last, words, exact.

    One row a run of aligned words: words ``first`` to ``last`` of the document equal the item's
    at positions less ``shift``. ``exact`` runs hold a whole window; other rows are proximity
    matches, with ``words`` the most aligned words inside any window.
    """
    items = stored(item_words(benchmark).withColumn("item", F.xxhash64("item_id", "words")), "items")
    words = items.select("item", F.size("words").alias("size"), F.posexplode("words").alias("at", "term"))
    counts = stored(_term_counts(docs, words.select("term").distinct()), "term-counts")
    # The two rarest terms of each window; a term's postings count decides, then the term.
    ranked = words.join(counts, "term", "left").fillna(0, ["n"])
    wide = F.least(F.col("size"), F.lit(window))
    starts = F.sequence(F.greatest(F.lit(0), F.col("at") - wide + 1), F.least("at", F.col("size") - wide))
    each = ranked.select("item", "at", "term", "n", "size", F.explode(starts).alias("start"))
    order = F.row_number().over(Window.partitionBy("item", "start").orderBy("n", "term", "at"))
    anchors = each.withColumn("rank", order).where("rank <= 2").select("item", "start", "at", "term", "rank", F.least(F.col("size"), F.lit(window)).alias("wide"))
    anchors = stored(anchors, "anchors")
    index = stored(postings(docs, anchors.select("term").distinct()), "postings")
    aligned = index.join(_small(anchors), "term").select(ROW, "item", (F.col("pos") - F.col("at")).alias("shift"), "start", "rank", "wide")
    # A window whose two lists meet at one alignment. Windows of one word need one list.
    met = (
        aligned.groupBy(ROW, "item", "shift", "start")
        .agg(F.count_if(F.col("rank") == 1).alias("one"), F.count_if(F.col("rank") == 2).alias("two"), F.first("wide").alias("wide"))
        .where((F.col("one") > 0) & ((F.col("two") > 0) | (F.col("wide") == 1)))
        .select(ROW, "item", "shift")
        .distinct()
    )
    met = stored(met, "alignments")
    asked = docs.join(_small(met.select(ROW).distinct()), ROW, "left_semi")
    parts = asked.select(ROW, _split(F.col("text")).alias("parts"))
    lead, _ = _ends(F.col("parts"))
    places = parts.select(ROW, lead.alias("lead"), F.posexplode("parts").alias("at", "term")).select(ROW, (F.col("at") - F.col("lead")).alias("pos"), "term")
    wanted = met.join(_small(words.select("item", "at", "size", "term")), "item").select(ROW, (F.col("shift") + F.col("at")).alias("pos"), "term", "item", "shift", "at", "size")
    hits = places.join(wanted, [ROW, "pos", "term"]).select(ROW, "item", "shift", "at", "size").distinct()
    diagonal = Window.partitionBy(ROW, "item", "shift").orderBy("at")
    hits = hits.withColumn("run", F.col("at") - F.row_number().over(diagonal))
    hits = hits.withColumn("dense", F.count(F.lit(1)).over(diagonal.rangeBetween(-(window - 1), 0)))
    runs = hits.groupBy(ROW, "item", "shift", "run", "size").agg(F.min("at").alias("a"), F.max("at").alias("b"), F.max("dense").cast("long").alias("words"))
    exact = F.col("b") - F.col("a") + 1 >= F.least(F.col("size"), F.lit(window))
    runs = runs.withColumn("exact", exact).where(F.col("exact") | (F.col("words") >= near))
    named = runs.join(_small(items.select("item", "item_id")), "item")
    return named.select(ROW, "item", "item_id", "shift", (F.col("shift") + F.col("a")).cast("long").alias("first"), (F.col("shift") + F.col("b")).cast("long").alias("last"), "words", "exact")


def _term_counts(docs: DataFrame, terms: DataFrame) -> DataFrame:
    said = docs.select(F.explode(_split(F.col("text"))).alias("term"))
    return said.join(_small(terms), "term").groupBy("term").agg(F.count(F.lit(1)).alias("n"))


def contamination(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, ratio: int = RATIO, near: int = NEAR) -> DataFrame:
    """documents(doc_id, text), benchmark(item_id, text) -> one row a row:
    doc_id, n_words, n_hit, n_items, items_sha256, contaminated, n_near.

    A word inside any occurrence of a window is hit; contaminated when ``ratio`` * n_hit >=
    n_words and n_hit > 0. ``n_near`` counts items with a proximity match only. Null texts have no
    words; null item ids count as ''; items repeated in full count once. Rows that share a
    doc_id, or have none, are texts of their own. Empty tables give no hits or no rows.
    """
    return _facts(numbered(documents), benchmark, window, ratio, near).drop(ROW)


def drop_contaminated(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, ratio: int = RATIO) -> DataFrame:
    """The rows of ``documents`` that aren't contaminated, with all their columns."""
    rows = numbered(documents)
    return without_rows(rows, _facts(rows, benchmark, window, ratio, NEAR).where("contaminated"))


def _facts(documents: DataFrame, benchmark: DataFrame, window: int, ratio: int, near: int) -> DataFrame:
    docs = documents.select(ROW, F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = stored(phrase_matches(docs.select(ROW, "text"), benchmark, window, near), "matches")
    exact = found.where("exact")
    hit = exact.select(ROW, F.explode(F.sequence("first", "last")).alias("pos")).distinct().groupBy(ROW).agg(F.count(F.lit(1)).alias("n_hit"))
    named = exact.select(ROW, "item_id").distinct()
    items = named.groupBy(ROW).agg(F.sort_array(F.collect_list("item_id")).alias("items"))  # at most the test items
    items = items.select(ROW, F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"))
    beside = found.where("not exact").select(ROW, "item_id").distinct().join(named, [ROW, "item_id"], "left_anti")
    beside = beside.groupBy(ROW).agg(F.count(F.lit(1)).alias("n_near"))
    facts = _small(hit.join(items, ROW).join(beside, ROW, "full"))  # fixed width, about a hundred bytes a row
    _, n_words = _ends(F.col("parts"))
    base = docs.select(ROW, "doc_id", _split(F.col("text")).alias("parts")).select(ROW, "doc_id", n_words.alias("n_words"))
    out = base.join(facts, ROW, "left").select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("items_sha256"),
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        ROW,
    )
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (ratio * F.col("n_hit") >= F.col("n_words")))


ORACLE = rf"""
WITH low AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
it AS (SELECT CAST(item_id AS VARCHAR) AS item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, n, array_to_string(w[s : s + n - 1], ' ') AS g FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM (SELECT *, least(len(w), {WINDOW}) AS n FROM it WHERE len(w) > 0))),
dg AS (SELECT doc_id, n, s, array_to_string(w[s : s + n - 1], ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM low, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n)),
m AS (SELECT doc_id, item_id, s, n FROM dg JOIN iw USING (n, g)),
h AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(s, s + n)) AS p FROM m) GROUP BY doc_id),
i AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT doc_id, item_id FROM m) GROUP BY doc_id),
di AS (SELECT item_id, w, len(w) AS size, least(len(w), {WINDOW}) AS wide, row_number() OVER (ORDER BY item_id, w) AS item FROM (SELECT DISTINCT item_id, w FROM it WHERE len(w) > 0)),
ip AS (SELECT item, size, wide, unnest(range(0, size)) AS ix, unnest(w) AS term FROM di),
dp AS (SELECT doc_id, unnest(range(0, len(w))) AS p, unnest(w) AS term FROM low),
tc AS (SELECT term, count(*) AS n FROM dp SEMI JOIN ip USING (term) GROUP BY term),
ea AS (SELECT item, ix, term, coalesce(n, 0) AS n, wide, unnest(range(greatest(0, ix - wide + 1), least(ix, size - wide) + 1)) AS st FROM ip LEFT JOIN tc USING (term)),
an AS (SELECT item, st, ix, term, wide, row_number() OVER (PARTITION BY item, st ORDER BY n, term, ix) AS r FROM ea QUALIFY r <= 2),
me AS (SELECT DISTINCT doc_id, item, shift FROM (SELECT doc_id, item, p - ix AS shift, st, wide, count(*) FILTER (r = 1) AS one, count(*) FILTER (r = 2) AS two FROM dp JOIN an USING (term) GROUP BY ALL) WHERE one > 0 AND (two > 0 OR wide = 1)),
hi AS (SELECT DISTINCT doc_id, item, shift, ix, size FROM me JOIN ip USING (item) JOIN dp USING (doc_id, term) WHERE p = shift + ix),
ru AS (SELECT *, ix - row_number() OVER (PARTITION BY doc_id, item, shift ORDER BY ix) AS run, count(*) OVER (PARTITION BY doc_id, item, shift ORDER BY ix RANGE BETWEEN {WINDOW - 1} PRECEDING AND CURRENT ROW) AS dense FROM hi),
rr AS (SELECT doc_id, item, max(ix) - min(ix) + 1 >= least(size, {WINDOW}) AS exact, max(dense) AS words FROM ru GROUP BY doc_id, item, shift, run, size),
ne AS (SELECT doc_id, count(DISTINCT item_id) AS n_near FROM (SELECT doc_id, item_id FROM rr JOIN di USING (item) WHERE NOT exact AND words >= {NEAR}) ANTI JOIN m USING (doc_id, item_id) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND {RATIO} * coalesce(n_hit, 0) >= len(w) AS contaminated, CAST(coalesce(n_near, 0) AS BIGINT) AS n_near
FROM low LEFT JOIN h USING (doc_id) LEFT JOIN i USING (doc_id) LEFT JOIN ne USING (doc_id)
"""
