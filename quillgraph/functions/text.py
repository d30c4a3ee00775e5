"""Text, date, hash and array expressions. All are Catalyst expressions; none runs Python."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"
WORD = r"[\p{L}\p{N}_]+"
#: Document numbers such as 111/2013/TT-BTC. ``wide`` also takes the letter Đ.
DOC_NUMBER = r"\b\d{1,4}/\d{4}/[A-Z0-9\-]+\b"
DOC_NUMBER_WIDE = r"\b\d{1,4}/\d{4}/[A-Z0-9\x{110}\-]+"
#: Every white space that a Unicode-aware strip removes.
EDGE_SPACE = r"(?U)^[\s\x{1c}-\x{1f}]+|[\s\x{1c}-\x{1f}]+$"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip(x: Column | str) -> Column:
    return F.regexp_replace(_c(x), EDGE_SPACE, "")


def blank_to_null(x: Column | str) -> Column:
    """NULL for NULL, empty or white-space-only strings, else the trimmed string."""
    return F.nullif(strip(x), F.lit(""))


def is_blank(x: Column | str) -> Column:
    return F.length(F.trim(F.coalesce(_c(x), F.lit("")))) == 0


def first_nonblank(*candidates: Column | str, default: str | None = None) -> Column:
    """First candidate that isn't blank: how alternate field names are looked up."""
    tail = [F.lit(default)] if default is not None else []
    return F.coalesce(*[blank_to_null(c) for c in candidates], *tail)


def normalize_lines(x: Column | str) -> Column:
    """Line ends unified, each line trimmed, blank lines dropped."""
    lines = F.split(F.regexp_replace(F.coalesce(_c(x), F.lit("")), "\r", "\n"), "\n")
    return F.array_join(F.filter(F.transform(lines, strip), lambda v: v != ""), "\n")


def tokens(x: Column | str) -> Column:
    return F.regexp_extract_all(F.coalesce(_c(x), F.lit("")), F.lit(TOKEN), F.lit(0))


def token_count(x: Column | str) -> Column:
    return F.size(tokens(x)).cast("long")


def words(x: Column | str) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(_c(x), F.lit(""))), F.lit(WORD), F.lit(0))


def doc_references(x: Column | str, wide: bool = False) -> Column:
    """Sorted distinct document numbers of a text."""
    found = F.regexp_extract_all(F.upper(F.coalesce(_c(x), F.lit(""))), F.lit(DOC_NUMBER_WIDE if wide else DOC_NUMBER), F.lit(0))
    return F.array_sort(F.array_distinct(found))


def safe_id(x: Column | str) -> Column:
    cleaned = F.regexp_replace(F.regexp_replace(F.trim(_c(x)), r"[^A-Za-z0-9_-]+", "_"), "_+", "_")
    return F.coalesce(F.nullif(F.btrim(cleaned, F.lit("_")), F.lit("")), F.lit("doc"))


def chunk_uid(doc_id: Column | str, order: Column | str) -> Column:
    return F.format_string("%s__%05d", safe_id(_c(doc_id).cast("string")), _c(order).cast("int"))


def generated_doc_id(number: Column | str, title: Column | str, index: Column | str) -> Column:
    """Readable prefix of at most 40 characters and twelve digits of SHA-1."""
    base = F.coalesce(blank_to_null(number), blank_to_null(title), F.concat(F.lit("document-"), _c(index).cast("string")))
    prefix = F.substring(F.regexp_replace(base, r"[^A-Za-z0-9]", "_"), 1, 40)
    return F.lower(F.concat(F.btrim(prefix, F.lit("_")), F.lit("_"), F.substring(F.sha1(base), 1, 12)))


def strip_tags(x: Column | str) -> Column:
    """Tags to spaces, spaces collapsed, lines trimmed, blank lines dropped."""
    text = F.regexp_replace(F.regexp_replace(F.coalesce(_c(x), F.lit("")), "<[^>]+>", " "), r"[^\S\n]+", " ")
    return F.array_join(F.filter(F.transform(F.split(text, "\n"), lambda v: F.trim(v)), lambda v: v != ""), "\n")


def normalize_query(x: Column | str) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(_c(x), F.lit(""))), r"\s+", " "))


def escape_query(x: Column | str) -> Column:
    """Backslash before each character that full-text query syntax reserves."""
    return F.regexp_replace(_c(x), r'([\\+\-&|!(){}\[\]^"~*?:/])', r"\\$1")


DOC_TYPES = ("bộ luật", "luật", "nghị định", "thông tư liên tịch", "thông tư", "nghị quyết", "quyết định", "pháp lệnh", "hiến pháp")


def without_type_prefix(x: Column | str, types: tuple[str, ...] = DOC_TYPES) -> Column:
    """A document name less its leading type; unchanged if nothing is left."""
    longest = sorted(types, key=len, reverse=True)
    rest = F.trim(F.regexp_replace(_c(x), rf"(?iu)^\s*(?:{'|'.join(longest)})\s+", ""))
    return F.coalesce(F.nullif(rest, F.lit("")), _c(x))


def relation_name(x: Column | str) -> Column:
    """Relation type as an edge label: upper case, spaces to underscores, blank to REFERS_TO."""
    return F.coalesce(F.nullif(F.replace(F.upper(F.trim(_c(x))), F.lit(" "), F.lit("_")), F.lit("")), F.lit("REFERS_TO"))


#: Labels shown for relation types.
RELATION_LABELS = {
    "VĂN_BẢN_SỬA_ĐỔI": "sửa đổi",
    "VĂN_BẢN_ĐƯỢC_SỬA_ĐỔI": "được sửa đổi bởi",
    "VĂN_BẢN_BỔ_SUNG": "bổ sung",
    "VĂN_BẢN_ĐƯỢC_BỔ_SUNG": "được bổ sung bởi",
    "VĂN_BẢN_CĂN_CỨ": "căn cứ",
    "VĂN_BẢN_DẪN_CHIẾU": "dẫn chiếu",
    "VĂN_BẢN_HẾT_HIỆU_LỰC": "hết hiệu lực",
    "VĂN_BẢN_BỊ_HẾT_HIỆU_LỰC_1_PHẦN": "bị hết hiệu lực một phần",
    "VĂN_BẢN_QUY_ĐỊNH_HẾT_HIỆU_LỰC": "quy định hết hiệu lực",
    "VĂN_BẢN_QUY_ĐỊNH_HẾT_HIỆU_LỰC_1_PHẦN": "quy định hết hiệu lực một phần",
    "VĂN_BẢN_HD,_QĐ_CHI_TIẾT": "hướng dẫn/quy định chi tiết",
    "VĂN_BẢN_ĐƯỢC_HD,_QĐ_CHI_TIẾT": "được hướng dẫn/quy định chi tiết bởi",
    "VĂN_BẢN_LIÊN_QUAN_KHÁC": "liên quan khác",
    "MENTIONS": "nhắc đến",
    "REFERS_TO": "tham chiếu",
}


def relation_label(x: Column | str) -> Column:
    table = F.create_map(*[F.lit(v) for pair in RELATION_LABELS.items() for v in pair])
    return F.coalesce(F.try_element_at(table, _c(x)), F.lower(F.replace(F.coalesce(_c(x), F.lit("")), F.lit("_"), F.lit(" "))))


def chunk_header(doc_number: Column | str, title: Column | str, chapter: Column | str, article: Column | str, clause: Column | str) -> Column:
    empty = lambda x: F.nullif(_c(x), F.lit(""))
    parts = F.concat_ws(" | ", F.coalesce(empty(doc_number), F.substring(empty(title), 1, 60)), empty(chapter), empty(article), F.concat(F.lit("Khoản "), empty(clause)))
    return F.coalesce(F.nullif(parts, F.lit("")), F.lit("N/A"))


def preview(x: Column | str, n: int = 100) -> Column:
    return F.concat(F.substring(_c(x), 1, n), F.lit("..."))


def first_int(x: Column | str) -> Column:
    return F.regexp_extract(F.coalesce(_c(x), F.lit("")), r"\d+", 0).try_cast("int")


def estimated_tokens(x: Column | str) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(F.coalesce(_c(x), F.lit(""))) / 4)).cast("long")


def is_email(x: Column | str) -> Column:
    return F.lower(F.trim(_c(x))).rlike(r"^[^@\s]+@[^@\s]+\.[^@\s]+$")


def iso_date(x: Column | str) -> Column:
    return F.nullif(F.trim(_c(x)), F.lit("")).try_cast("date")


def bucket(x: Column | str, bounds: list[tuple[int, str]], last: str) -> tuple[Column, Column]:
    """Label and order of the first bucket whose upper bound isn't exceeded."""
    label, order = F.lit(last), F.lit(len(bounds))
    for i, (bound, name) in reversed(list(enumerate(bounds))):
        label, order = F.when(_c(x) <= bound, name).otherwise(label), F.when(_c(x) <= bound, i).otherwise(order)
    return label, order


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def contains_any(keywords: list[str], *columns: Column | str) -> Column:
    """Case-insensitive substring test of any keyword in any column; no keywords: true."""
    if not keywords:
        return F.lit(True)
    return any_of([F.contains(F.lower(F.coalesce(_c(c), F.lit(""))), F.lit(k.lower())) for k in keywords for c in columns])


def question_key(x: Column | str, scope: Column | str | None = None) -> Column:
    """Cache key of a question: sixteen digits of SHA-256, optionally with a user's scope."""
    base = F.lower(F.trim(_c(x)))
    return F.substring(F.sha2(base if scope is None else F.concat(_c(scope).cast("string"), F.lit("|"), base), 256), 1, 16)


def last_k(x: Column | str, k: int) -> Column:
    return F.slice(_c(x), F.greatest(F.size(_c(x)) - k + 1, F.lit(1)), F.lit(k))


#: The URL namespace of RFC 4122.
NAMESPACE_URL = "6ba7b8119dad11d180b400c04fd430c8"


def uuid5(x: Column | str, namespace: str = NAMESPACE_URL) -> Column:
    """Name-based UUID, version 5: stable point ids from chunk ids."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(_c(x), "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 2), 16, 10).cast("int").bitwiseAND(0x3F).bitwiseOR(0x80)))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 19, 2)), F.substring(h, 21, 12))


def composed_text(parts: Column | str) -> Column:
    """array<struct<chapter, article, clause, content>> -> text: chapter and article lines only where they change."""
    blank = lambda v: F.length(F.trim(F.coalesce(v, F.lit("")))) == 0
    start = F.struct(F.lit("").alias("chapter"), F.lit("").alias("article"), F.array().cast("array<string>").alias("lines"))

    def step(acc, x):
        new = lambda f: ~blank(x[f]) & (x[f] != acc[f])
        moved = new("chapter")
        heads = F.array(F.when(moved, x["chapter"]), F.when(~blank(x["article"]) & (moved | new("article")), x["article"]), F.when(~blank(x["clause"]), x["clause"]), F.when(~blank(x["content"]), F.trim(x["content"])))
        return F.struct(
            F.when(moved, x["chapter"]).otherwise(acc["chapter"]).alias("chapter"),
            F.when(~blank(x["article"]), x["article"]).otherwise(acc["article"]).alias("article"),
            F.concat(acc["lines"], F.filter(heads, lambda v: v.isNotNull())).alias("lines"),
        )

    return F.array_join(F.aggregate(_c(parts), start, step, lambda acc: acc["lines"]), "\n")
