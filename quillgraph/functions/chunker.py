"""Hierarchical chunker of legal texts.

Lines are grouped under chapter, section, article, clause and point headings. A chunk closes at
a heading, when the next line would pass the limit, or past the target at a sentence end. Then
each chunk is prefixed by the last tokens of the one before, itself already prefixed.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LEVELS = ("chapter", "section", "article", "clause", "point")
TOKEN = re.compile(r"\w+|[^\w\s]")
# Headings after accents are folded and case is lowered, and document numbers.
HEADINGS = (
    ("chapter", re.compile(r"chuong\s+(?:[ivxlcdm]+|\d+)\b")),
    ("section", re.compile(r"muc\s+(?:[ivxlcdm]+|\d+)\b")),
    ("article", re.compile(r"dieu\s+\d+[a-z]?\b")),
    ("clause", re.compile(r"(?:khoan\s+)?\d+[.)]\s+")),
    ("point", re.compile(r"[a-z]\)\s+")),
)
NUMBER = re.compile(r"\b\d{1,4}/\d{4}/[A-Z0-9\-]+\b")
NUMBER_WIDE = re.compile(r"\b\d{1,4}/\d{4}/[A-Z0-9Đ\-]+")

SCHEMA = (
    "chunk_uid string, doc_id string, doc_number string, doc_title string, chunk_order int, chunk_text string, token_count int, tokens array<string>,"
    " chapter string, section string, article string, clause string, point string, references_to array<string>"
)


def fold(text: str, fold_d: bool = True) -> str:
    """Accents removed; đ has none to remove, so it is folded by name unless ``fold_d`` is off."""
    plain = "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c))
    return plain.replace("đ", "d").replace("Đ", "D") if fold_d else plain


def heading(line: str, fold_d: bool = True) -> tuple[str, str] | None:
    low = fold(line, fold_d).lower()
    for level, pattern in HEADINGS:
        if m := pattern.match(low):
            return level, m[0]
    return None


@dataclass
class Chunk:
    lines: list[str]
    place: dict[str, str | None]
    references: list[str] = field(default_factory=list)
    text: str = ""
    tokens: list[str] = field(default_factory=list)


def split(text: str, target: int = 220, limit: int = 300, overlap: int = 30, fold_d: bool = True, wide: bool = True) -> list[Chunk]:
    """A line longer than the limit stays whole. Tokens never span lines, so their counts add up."""
    if target <= 0 or limit <= 0 or target > limit:
        raise ValueError("need 0 < target <= limit")
    place: dict[str, str | None] = dict.fromkeys(LEVELS)
    done: list[Chunk] = []
    lines: list[str] = []
    size = 0

    def close() -> None:
        nonlocal lines, size
        if lines:
            done.append(Chunk(lines, dict(place)))
        lines, size = [], 0

    for line in filter(None, (x.strip() for x in (text or "").replace("\r", "\n").split("\n"))):
        n = len(TOKEN.findall(line))
        if found := heading(line, fold_d):
            close()  # under the headings before this one
            level = LEVELS.index(found[0])
            place[found[0]] = found[1]
            place.update(dict.fromkeys(LEVELS[level + 1 :]))
        if lines and size + n > limit:
            close()
        lines.append(line)
        size += n
        if size >= target and line[-1] in ".;:":
            close()
    close()
    before: list[str] = []
    for chunk in done:
        body = "\n".join(chunk.lines)
        chunk.references = sorted(set((NUMBER_WIDE if wide else NUMBER).findall(body.upper())))
        tail = before[-overlap:] if overlap > 0 else []
        chunk.text = f"{' '.join(tail)}\n{body}" if tail else body
        chunk.tokens = before = TOKEN.findall(chunk.text)
    return done


def safe(text: str) -> str:
    return re.sub("_+", "_", re.sub(r"[^A-Za-z0-9_-]+", "_", text.strip())).strip("_") or "doc"


#: Characters of documents whose chunks a task holds before it hands them on; tokens as Python strings take some fifty times as much.
HELD = 1_000_000
_TEXTS = pa.list_(pa.string())
_KINDS = pa.schema([(name, {"int": pa.int32(), "array<string>": _TEXTS}.get(kind, pa.string())) for name, kind in (p.split(" ", 1) for p in SCHEMA.split(", "))])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(values, f.type) for values, f in zip(zip(*rows), _KINDS)], schema=_KINDS)


def chunk_documents(documents: DataFrame, target: int = 220, limit: int = 300, overlap: int = 30, fold_d: bool = True, wide: bool = True) -> DataFrame:
    """documents(doc_id, doc_number, doc_title, content_text) -> one row a chunk. No shuffle, no list held beyond a document's."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, held = [], 0
            for doc_id, number, title, text in zip(*batch.columns):
                doc_id, number, title, text = doc_id.as_py(), number.as_py(), title.as_py(), text.as_py()
                for i, c in enumerate(split(text, target, limit, overlap, fold_d, wide), 1):
                    rows.append((f"{safe(doc_id)}__{i:05d}", doc_id, number, title, i, c.text, len(c.tokens), c.tokens, *c.place.values(), c.references))
                held += len(text)
                if held >= HELD:
                    yield _batch(rows)
                    rows, held = [], 0
            if rows:
                yield _batch(rows)

    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    return documents.select(*[text(c) for c in ("doc_id", "doc_number", "doc_title", "content_text")]).mapInArrow(run, SCHEMA)


def register_chunker(spark: SparkSession, name: str = "chunk_document") -> None:
    """The chunker as a table function for SQL: ``FROM documents d, LATERAL chunk_document(d.doc_id, d.number, d.title, d.text, target, limit, overlap)``.

    Null arguments count as empty texts; a blank text has no chunks.
    """
    split_text, safe_id, levels = split, safe, LEVELS

    class ChunkDocument:
        def eval(self, doc_id: str, number: str, title: str, text: str, target: int, limit: int, overlap: int):  # noqa: ANN202
            for i, c in enumerate(split_text(text or "", target, limit, overlap), 1):
                yield (f"{safe_id(doc_id or '')}__{i:05d}", doc_id, number, title, i, c.text, len(c.tokens), c.tokens, *(c.place[x] for x in levels), c.references)

    spark.udtf.register(name, F.udtf(ChunkDocument, returnType=SCHEMA))
