"""Line deduplication by site-relative frequency.

A line is boilerplate on a site when it stands on two pages at least and the share of the site's
pages that hold it exceeds ``max_ratio``; on three pages one page alone exceeds it. Everything is DataFrame expressions. Lines are counted once a page; the count
shuffles (host, 128-bit digest) pairs after map-side combining. The boilerplate digests of one
host number at most (mean distinct lines a page) / ``max_ratio``, so they travel as one short
array a host, whatever the host's page count; they are counted, and broadcast when few, so that
pages don't move; else a hot host is split by adaptive skew joins.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import stored

MAX_RATIO = 0.3
MIN_PAGES = 3
#: Pages that must hold a line before it counts as repeated.
MIN_REPEATS = 2
#: Boilerplate digests (32 characters each) up to which they are broadcast.
BROADCAST_DIGESTS = 500_000

#: Java and RE2 read these alike. Whole elements whose content is no text, then tags that end a line.
HIDDEN = r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->"
BREAKS = r"(?is)</?(?:address|article|aside|blockquote|body|br|dd|div|dl|dt|footer|form|h1|h2|h3|h4|h5|h6|head|header|hr|html|li|main|nav|ol|option|p|pre|section|table|td|th|title|tr|ul)\b[^>]*>"
TAGS = r"(?s)</?[a-zA-Z][^>]*>|<[!?][^>]*>"
HOST = r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)"


#: Openers and closers of what ``HIDDEN`` removes.
PAIRS = (("<script", r"</script\s*>"), ("<style", r"</style\s*>"), ("<!--", "-->"))
#: Bytes of a page up to which its openers may all be searched to the end: well under a second. The lines are the same either way.
SHORT = 1 << 14
#: Openers of a kind up to which each may be searched to the page's end; beyond, those behind the last closer are set aside first.
OPENERS = 64
#: Stands in an opener that is set aside; a noncharacter, which texts don't hold.
ASIDE = "\ufdd0"


def _with(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _without_open(text: Column, low: Column, opener: str, closer: str) -> Column:
    """``text`` with ``ASIDE`` in the openers that nothing closes, where there are many: each of them would be searched to the end."""
    many = F.octet_length(low) - F.octet_length(F.replace(low, F.lit(opener), F.lit(""))) > OPENERS * len(opener)
    aside = lambda t, rest: F.concat(F.substring(t, F.lit(1), F.length(t) - F.length(rest)), F.regexp_replace(rest, f"(?i)<(?={opener[1:]})", "<" + ASIDE))
    behind = lambda t: F.regexp_replace(t, rf"(?is)\A.*{closer}", "")  # noqa: E731  what follows the last closer
    return _with(text, lambda t: F.when(many, _with(behind(t), lambda rest: aside(t, rest))).otherwise(t))


def html_lines(html: Column) -> Column:
    """Visible lines of raw HTML: block tags end a line, other tags vanish, blank lines go. Linear in the page: an element,
    a comment or a tag that nothing closes is text, and isn't searched for its end again and again."""

    def shown(low: Column) -> Column:
        text = F.coalesce(html, F.lit(""))
        for opener, closer in PAIRS:
            text = _without_open(text, low, opener, closer)
        return F.replace(F.regexp_replace(text, HIDDEN, "\n"), F.lit("<" + ASIDE), F.lit("<"))

    def untagged(text: Column, rest: Column) -> Column:
        tagged = F.substring(text, F.lit(1), F.length(text) - F.length(rest))
        return F.concat(bare(tagged), rest)

    text = F.coalesce(html, F.lit(""))
    bare = lambda t: F.regexp_replace(F.regexp_replace(t, BREAKS, "\n"), TAGS, "")
    long = _with(_with(F.lower(text), shown), lambda t: _with(F.substring_index(t, ">", -1), lambda rest: untagged(t, rest)))  # no tag ends in the rest
    text = F.when(F.octet_length(text) <= SHORT, bare(F.regexp_replace(text, HIDDEN, "\n"))).otherwise(long)
    return F.filter(F.transform(F.split(text, "[\r\n]+"), lambda x: F.btrim(x, F.lit(" \t"))), lambda x: x != "")


def host_of(url: Column) -> Column:
    """Lower-case host; '' for a null or relative url (such pages count as one site)."""
    return F.regexp_extract(F.lower(F.coalesce(url, F.lit(""))), HOST, 1)


def drop_boilerplate(pages: DataFrame, max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """pages(page_id, host, lines) -> page_id, host, n_lines, n_dropped, text.

    Lines repeated inside a page count once for the ratio and are judged alike. Hosts of fewer
    than ``min_pages`` pages keep every line. Null or empty lines arrays give an empty text.
    Repeated rows count as pages of their own; an empty table gives no rows.
    """
    pages = pages.select("page_id", F.coalesce("host", F.lit("")).alias("host"), F.coalesce("lines", F.array().cast("array<string>")).alias("lines"))
    totals = pages.groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    seen = (
        pages.select("host", F.explode(F.array_distinct(F.transform("lines", lambda x: F.md5(x)))).alias("digest"))
        .groupBy("host", "digest")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    bad = (
        seen.join(totals, "host")
        .where((F.col("pages") >= min_pages) & (F.col("n") >= MIN_REPEATS) & (F.col("n") > F.lit(max_ratio) * F.col("pages")))
        .groupBy("host")
        .agg(F.collect_set("digest").alias("bad"))
    )
    bad = stored(bad, "boilerplate")
    if (bad.agg(F.sum(F.size("bad"))).first()[0] or 0) <= BROADCAST_DIGESTS:
        bad = F.broadcast(bad)  # then no page moves; else adaptive joins split hot hosts
    kept = F.when(F.col("bad").isNull(), F.col("lines")).otherwise(F.filter("lines", lambda x: ~F.array_contains("bad", F.md5(x))))
    return (
        pages.join(bad, "host", "left")
        .withColumn("kept", kept)
        .select("page_id", "host", F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size("kept")).cast("long").alias("n_dropped"), F.array_join("kept", "\n").alias("text"))
    )


def dedup_page_lines(pages: DataFrame, max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """The same over raw pages(page_id, url, html)."""
    return drop_boilerplate(pages.select("page_id", host_of(F.col("url")).alias("host"), html_lines(F.col("html")).alias("lines")), max_ratio, min_pages)


ORACLE = rf"""
WITH p AS (
  SELECT page_id, regexp_extract(lower(coalesce(url, '')), '{HOST}', 1) AS host,
    list_filter(list_transform(regexp_split_to_array(
      regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '{HIDDEN}', chr(10), 'g'), '{BREAKS}', chr(10), 'g'), '{TAGS}', '', 'g'),
      '[\r\n]+'), lambda x: trim(x, ' ' || chr(9))), lambda x: x <> '') AS lines
  FROM pages),
t AS (SELECT host, count(*) AS pages FROM p GROUP BY host),
s AS (SELECT host, line, count(*) AS n FROM (SELECT host, unnest(list_distinct(lines)) AS line FROM p) GROUP BY ALL),
b AS (SELECT host, list(line) AS bad FROM s JOIN t USING (host) WHERE pages >= {MIN_PAGES} AND n >= {MIN_REPEATS} AND n > CAST({MAX_RATIO} AS DOUBLE) * pages GROUP BY host),
k AS (SELECT page_id, host, lines, CASE WHEN bad IS NULL THEN lines ELSE list_filter(lines, lambda x: NOT list_contains(bad, x)) END AS kept FROM p LEFT JOIN b USING (host))
SELECT page_id, host, CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(kept) AS BIGINT) AS n_dropped,
  coalesce(array_to_string(kept, chr(10)), '') AS text FROM k
"""
