"""Main text of web pages by two-pass block rules.

Pass one classifies each block by itself from its length, stop-word density and link density:
good, bad, or undecided (short or near-good). Pass two gives each undecided block the label of
its nearest decided neighbour (a tie goes to the better label). Elements that hold no article
text by their tag, role or class (menus, footers, adverts, forms, reader comments, scripts ...)
never make blocks. Inside article or main elements a lack of stop words doesn't condemn a
block, as tables of names and lists have none; it stays undecided.

Outside article and main elements one word of a class or id is enough to name furniture; inside them the whole
name must say it ("share-box", not "share-prices"), as articles have classes of their own.

End tags that HTML lets a page omit are supplied. A page is parsed in one linear scan, in memory in
proportion to it: a search that fails is never made again for the same page.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIN_LENGTH = 70
LONG_LENGTH = 200
LOW_STOPS = 0.15
HIGH_STOPS = 0.25
MAX_LINKS = 0.33

# HTML elements by kind, and common names of page furniture.
RAW = frozenset("script style title textarea xmp iframe noembed noframes noscript template".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body br-block caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
FURNITURE_TAGS = frozenset("nav footer aside form button select svg canvas object dialog menu head audio video map math datalist fieldset".split())
FURNITURE_NAMES = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs footer sidebar aside widget ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner"
    " cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup signin login comment comments disqus respond reply replies"
    " share sharing social related recommended recommendations search toolbar pagination pager skip copyright disclaimer masthead topbar".split()
)
#: Words that may stand beside a furniture name without making it another thing.
LAYOUT_WORDS = frozenset(
    "area article articles bar block body bottom box button buttons card cards center col column content count counter container div foot form group head heading header holder icon icons image inner item items label"
    " left link links list main meta module news new outer page panel post posts right row section set slot small stories story strip tab text the title top unit view wide wrap wrapper".split()
)
# Omitted end tags: a start tag ends the nearest open element of the first set, unless one of the second stands inside it.
CELLS, ROWS = frozenset(("td", "th")), frozenset(("tbody", "tfoot", "thead"))
_ITEMS = (BLOCK | {"button", "select", "object"}) - {"address", "div", "p"}
IMPLIED: dict[str, tuple[frozenset[str], frozenset[str]]] = {
    "li": (frozenset(("li",)), _ITEMS - {"li"}),
    "option": (frozenset(("option",)), frozenset(("select", "datalist", "optgroup"))),
    "optgroup": (frozenset(("option", "optgroup")), frozenset(("select", "datalist"))),
    "tr": (CELLS | {"tr", "caption"}, frozenset(("table",))),
    **dict.fromkeys(("dd", "dt"), (frozenset(("dd", "dt")), _ITEMS - {"dd", "dt"})),
    **dict.fromkeys(CELLS, (CELLS | {"caption"}, frozenset(("table", "tr")))),
    **dict.fromkeys(ROWS, (CELLS | ROWS | {"tr", "caption"}, frozenset(("table",)))),
}
ENDS_P = BLOCK - {"body", "br-block", "caption", "frameset", "head", "html", "legend", "optgroup", "option", "tbody", "td", "tfoot", "th", "thead", "tr"}
KEEPS_P = CELLS | {"a", "button", "caption", "object", "table"}
OTHER_VOICES = frozenset("comment comments reply replies ad ads advert advertisement sponsored promo related".split())
FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
STOP_WORDS = frozenset(
    "a about after all an and are as at be been but by can for from had has have he her his i if in into is it its more no not of on one or our she so that the their there they this to was we were what when which who will with would you your"
    " au aux avec ce ces cette comme dans de des du elle en est et il ils je la le les leur lui mais ne nous on ou par pas plus pour qu que qui sa se ses son sont sur un une vous y"
    " al como con del el ella en entre era es esta este fue ha hay la las lo los me mi no o para pero por que se sin sobre son su sus un una y ya"
    " aber als am an auch auf aus bei bin bis das dass dem den der des die du ein eine einem einen einer er es für hat ich ihr im in ist mit nach nicht noch nur oder sich sie sind so und vom von vor war was wie wir zu zum zur über".split()
)

OPEN = re.compile(r"<(?:!--|[!?]|(/?)([a-zA-Z][^\s/>]*+))")
ENDS = re.compile(r"""[>"']""")
COMMENT_END = re.compile(r"--!?>")
ATTRIBUTE = re.compile(r"""([^\s"'<>/=]++)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s"'=<>`]++))?""")
WORD = re.compile(r"[^\W\d_]+")


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape((m[2] or "").strip("\"'")).lower() for m in ATTRIBUTE.finditer(raw)} if raw.strip(" /") else {}


def _tokens(page: str) -> Iterator[tuple[int, int, bool, str, str]]:
    """Tags in page order: where each begins and ends, whether it is an end tag, its name, its raw attributes.

    Comments and declarations have no name. A quote opens a value only after "=" and only if it is
    closed somewhere; a tag without any ">" is text. Elements of raw content come with it as one token.
    """
    quotes = {'"': True, "'": True}  # still closed somewhere ahead
    at, n = 0, len(page)
    while m := OPEN.search(page, at):
        begin, end = m.start(), m.end()
        if not m[2]:
            if page[begin + 1 : begin + 4] == "!--":
                if page[end : end + 1] == ">" or page[end : end + 2] == "->":
                    close = page.index(">", end) + 1
                else:
                    close = c.end() if (c := COMMENT_END.search(page, end)) else n
            else:
                close = page.find(">", end) + 1 or n
            yield begin, close, False, "", ""
            at = close
            continue
        here = end
        while (q := ENDS.search(page, here)) and q[0] != ">":
            here = q.end()
            if quotes[q[0]]:
                back = q.start() - 1
                while page[back].isspace():
                    back -= 1
                if page[back] == "=" and back >= end:
                    shut = page.find(q[0], here)
                    quotes[q[0]] = shut >= 0
                    here = shut + 1 or here
        if not q:
            if not any(quotes.values()) or page.find(">", end) < 0:
                return
            quotes = dict.fromkeys(quotes, False)  # from here on a tag ends at the first ">"
            continue
        tag, close = m[2].lower(), q.end()
        if tag in RAW and not m[1]:
            shut = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(page, close)
            close = shut and page.find(">", shut.end()) + 1 or n
        yield begin, close, bool(m[1]), tag, page[end : q.start()]
        at = close


def _named_furniture(names: str, inside: bool) -> bool:
    """Whether a class or id attribute names furniture. ``inside``: every word of one of its names has to fit."""
    if not inside:
        return not FURNITURE_NAMES.isdisjoint(re.split(r"[^a-z0-9]+", names))
    for name in names.split():
        words = [w for w in re.split(r"[^a-z]+", name) if w]
        if not FURNITURE_NAMES.isdisjoint(words) and all(w in FURNITURE_NAMES or w in LAYOUT_WORDS for w in words):
            return True
    return False


def _furniture(tag: str, attributes: dict[str, str], inside: bool) -> bool:
    """Whether the element holds no article text. ``inside``: it stands in an article or main element."""
    if tag in ("html", "body", "main"):
        return False
    names = f"{attributes.get('class', '')} {attributes.get('id', '')}"
    if tag == "article":
        return not OTHER_VOICES.isdisjoint(re.split(r"[^a-z0-9]+", names))
    if tag in FURNITURE_TAGS or tag == "header" and not inside:
        return True
    if "hidden" in attributes or attributes.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", attributes.get("style", "")):
        return True
    return attributes.get("role", "") in FURNITURE_ROLES or _named_furniture(names, inside) or not inside and "header" in re.split(r"[^a-z0-9]+", names)


def blocks_of(page: str) -> list[tuple[str, float, bool]]:
    """Blocks in page order: text, share of its characters inside links, stands in article or main."""
    found: list[tuple[str, float, bool]] = []
    stack: list[tuple[str, bool]] = []  # open elements: tag, furniture
    places: dict[str, list[int]] = {}  # where each tag stands in the stack, so that an opener is found at any depth
    parts: list[str] = []
    linked = 0
    hidden = links = inside = 0

    def flush() -> None:
        nonlocal linked
        text = " ".join("".join(parts).split())
        if text:
            found.append((text, min(1.0, linked / len(text)), inside > 0))
        parts.clear()
        linked = 0

    def text(raw: str) -> None:
        nonlocal linked
        if not hidden and raw:
            raw = html.unescape(raw)
            parts.append(raw)
            if links:
                linked += len("".join(raw.split()))

    def close(k: int) -> None:
        nonlocal hidden, links, inside
        for tag, out in stack[k:]:
            if tag != "a-ended":
                places[tag].pop()
            hidden -= out
            links -= tag == "a"
            inside -= tag in ("article", "main") and not out
        del stack[k:]

    def nearest(tags: frozenset[str]) -> list[int]:
        return [places[t][-1] for t in tags if places.get(t)]

    def imply(targets: frozenset[str], limits: frozenset[str]) -> None:
        if found := nearest(targets):
            limit = max(nearest(limits), default=-1)
            if found := [k for k in found if k > limit]:
                close(min(found))

    at = 0
    for begin, close_at, ends, tag, raw in _tokens(page):
        text(page[at:begin])
        at = close_at
        if not tag:
            continue
        if tag == "br":
            if not hidden:
                parts.append(" ")
            continue
        if tag in BLOCK:
            flush()
        if ends:
            if places.get(tag):
                close(places[tag][-1])
            continue
        if tag in VOID or tag in RAW or raw.endswith("/") and tag not in BLOCK:
            continue
        if tag in ENDS_P:
            imply(frozenset(("p",)), KEEPS_P)
        if tag in IMPLIED:
            imply(*IMPLIED[tag])
        if tag == "a" and links:  # links don't nest: an unclosed one ends here
            if places.get("a"):
                k = places["a"].pop()
                stack[k] = ("a-ended", stack[k][1])
                links -= 1
        own = _attributes(raw)
        if tag in ("article", "main") and hidden and not _furniture(tag, own, False):
            close(0)  # an unclosed menu doesn't swallow the article
        out = _furniture(tag, own, inside > 0)
        places.setdefault(tag, []).append(len(stack))
        stack.append((tag, out))
        hidden += out
        links += tag == "a"
        inside += tag in ("article", "main") and not out
    text(page[at:])
    flush()
    return found


GOOD, BAD, UNDECIDED = 1, 0, None


def classify(text: str, links: float, inside: bool) -> int | None:
    """First pass: a block by itself."""
    if links > MAX_LINKS:
        return BAD
    if len(text) < MIN_LENGTH:
        return UNDECIDED
    words = WORD.findall(text.lower())
    stops = sum(w in STOP_WORDS for w in words) / max(1, len(words))
    if stops >= HIGH_STOPS or stops >= LOW_STOPS and len(text) >= LONG_LENGTH:
        return GOOD
    return UNDECIDED if inside or stops >= LOW_STOPS else BAD


def extract(page: str) -> str:
    """Both passes over one page. With no decided block, blocks of article or main elements are good."""
    blocks = blocks_of(page)
    labels = [classify(*b) for b in blocks]
    before: list[tuple[int, int] | None] = []
    last = None
    for i, label in enumerate(labels):
        last = (i, label) if label is not None else last
        before.append(last)
    last = None
    kept = []
    for i in range(len(blocks) - 1, -1, -1):
        last = (i, labels[i]) if labels[i] is not None else last
        near = [(abs(i - k[0]), -k[1], k[1]) for k in (before[i], last) if k]
        if blocks[i][2]:
            near = near or [(0, 0, GOOD)]
        if near and min(near)[2] == GOOD:
            kept.append(blocks[i][0])
    return " ".join(reversed(kept))


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [extract(x) for x in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"])


def extract_pages(pages: DataFrame) -> DataFrame:
    """pages(page_id, url, html) -> page_id, url, text, n_chars: one row per row, no shuffle.

    Null or empty html gives an empty text; nulls in page_id or url pass through; repeated rows
    give repeated rows; other columns are ignored.
    """
    source = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    return source.mapInArrow(_run, "page_id long, url string, text string").withColumn("n_chars", F.char_length("text").cast("long"))
