"""Fill-in-the-middle transformation of whole texts, cut at line ends: DuckDB SQL over each Arrow batch.

A text is cut into lines, its line ends with them. Two numbers from a seeded digest of the id choose the cuts: the prefix ends
after the smaller, the middle after the larger, the suffix is the rest. A third decides whether the text is
transformed at all, a fourth between the two orders:

    psm   <P>prefix<S>suffix<M>middle
    spm   <S>suffix<P>prefix<M>middle

A text that is empty or holds one of the marks stays plain. The inverse finds the marks by their places, so any output
that isn't plain gives its text back exactly: no mark stands in the parts, and none can arise where parts meet, as a
mark's first character occurs in it once.

Cases: a null text is an empty one; a null id is hashed as ''; rows that share an id are cut alike if their texts have as many
lines; repeated rows give repeated results; an empty table gives no rows; other columns aren't read, so their names
can't clash. A text is held whole in one task, a batch in pieces of ``SLICE_BYTES``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Marks of prefix, suffix and middle. Each begins with a character that it holds once.
MARKS = ("<P>", "<S>", "<M>")
SEED = "7"
#: Of a hundred texts so many are transformed, and of a hundred of these so many put the suffix first.
RATE, SPM = 100, 50
#: Texts of a batch that DuckDB reads at a time, in bytes; a longer text goes alone.
SLICE_BYTES = 8 << 20

TRANSFORMED = "doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string, output_sha256 string"
RESTORED = "doc_id bigint, text string, restored_sha256 string"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def transform_sql(source: str, seed: str = SEED, rate: int = RATE, spm: int = SPM, marks: tuple[str, str, str] = MARKS) -> str:
    """SQL of the transformation over ``source``(doc_id, text)."""
    p, s, m = map(_quoted, marks)
    number = lambda i: f"CAST('0x' || substr(h, {8 * i + 1}, 8) AS BIGINT)"
    return f"""
WITH cut AS (
  SELECT doc_id, text, regexp_extract_all(text, '[^\\n]*\\n|[^\\n]+') AS units, sha256({_quoted(seed + ":")} || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM (SELECT doc_id, coalesce(text, '') AS text FROM {source})),
ends AS (
  SELECT *, len(units) AS n, {number(0)} % (len(units) + 1) AS a, {number(1)} % (len(units) + 1) AS b,
    CASE WHEN text = '' OR contains(text, {p}) OR contains(text, {s}) OR contains(text, {m}) OR {number(2)} % 100 >= {int(rate)} THEN 'plain'
      WHEN {number(3)} % 100 < {int(spm)} THEN 'spm' ELSE 'psm' END AS form FROM cut),
parts AS (
  SELECT doc_id, text, n, form, array_to_string(list_slice(units, 1, least(a, b)), '') AS prefix,
    array_to_string(list_slice(units, least(a, b) + 1, greatest(a, b)), '') AS middle, array_to_string(list_slice(units, greatest(a, b) + 1, n), '') AS suffix FROM ends),
told AS (
  SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
    CASE form WHEN 'psm' THEN {p} || prefix || {s} || suffix || {m} || middle WHEN 'spm' THEN {s} || suffix || {p} || prefix || {m} || middle ELSE text END AS output FROM parts)
SELECT *, sha256(output) AS output_sha256 FROM told"""


def restore_sql(source: str, marks: tuple[str, str, str] = MARKS) -> str:
    """SQL of the inverse over ``source``(doc_id, form, output)."""
    p, s, m = map(_quoted, marks)
    lp, ls, lm = map(len, marks)
    return f"""
WITH found AS (SELECT doc_id, form, output, strpos(output, {p}) AS p, strpos(output, {s}) AS s, strpos(output, {m}) AS m FROM {source}),
parts AS (
  SELECT *, CASE form WHEN 'psm' THEN substr(output, p + {lp}, s - p - {lp}) ELSE substr(output, p + {lp}, m - p - {lp}) END AS prefix,
    CASE form WHEN 'psm' THEN substr(output, s + {ls}, m - s - {ls}) ELSE substr(output, s + {ls}, p - s - {ls}) END AS suffix, substr(output, m + {lm}) AS middle
  FROM found WHERE form <> 'plain'),
whole AS (SELECT doc_id, prefix || middle || suffix AS text FROM parts UNION ALL SELECT doc_id, output FROM found WHERE form = 'plain')
SELECT *, sha256(text) AS restored_sha256 FROM whole"""


def _slices(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of about ``SLICE_BYTES``."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    first = held = 0
    for i, size in enumerate(sizes):
        if i > first and held + size > SLICE_BYTES:
            yield batch.slice(first, i - first)
            first, held = i, 0
        held += size
    if first < len(sizes):
        yield batch.slice(first)


def _by_duckdb(rows: DataFrame, sql: str, schema: str, column: str) -> DataFrame:
    """Rows of each batch, registered as the table ``batch``, through ``sql``."""
    names = [x.split()[0] for x in schema.split(", ")]
    types = pa.schema([(n, pa.int64() if x.endswith("bigint") else pa.string()) for n, x in zip(names, schema.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        with duckdb.connect(":memory:", config={"threads": 1, "temp_directory": ""}) as con:  # nothing is written beside the task
            for batch in batches:
                for part in _slices(batch, column):
                    con.register("batch", pa.Table.from_batches([part]))
                    yield from con.sql(sql).to_arrow_table().select(names).cast(types).to_batches()
                    con.unregister("batch")

    return rows.mapInArrow(run, schema)


def fill_in_middle(documents: DataFrame, text: str = "text", key: str = "doc_id", seed: str = SEED, rate: int = RATE, spm: int = SPM, marks: tuple[str, str, str] = MARKS) -> DataFrame:
    """-> doc_id, n (lines), form (plain, psm or spm), prefix_chars, middle_chars (null if plain), output, output_sha256."""
    if len(set(marks)) < 3 or any(not x or x[0] in x[1:] for x in marks):
        raise ValueError("three different marks, each beginning with a character that it holds once")
    rows = documents.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return _by_duckdb(rows, transform_sql("batch", seed, rate, spm, marks), TRANSFORMED, "text")


def restore(transformed: DataFrame, marks: tuple[str, str, str] = MARKS) -> DataFrame:
    """transformed(doc_id, form, output) -> doc_id, text, restored_sha256."""
    return _by_duckdb(transformed.select("doc_id", "form", "output"), restore_sql("batch", marks), RESTORED, "output")


def round_trip_sql(source: str, **options) -> str:
    """SQL of both directions over ``source``(doc_id, text). Rows are told apart by a number, as ids may repeat."""
    back = restore_sql("(SELECT row AS doc_id, form, output FROM t)", options.get("marks", MARKS))
    return f"""
WITH t AS (SELECT row_number() OVER () AS row, * FROM ({transform_sql(source, **options)})), back AS ({back})
SELECT t.* EXCLUDE (row), restored_sha256 FROM t JOIN back ON t.row = back.doc_id"""


def round_trip(documents: DataFrame, **options) -> DataFrame:
    """What ``fill_in_middle`` gives for each row, with restored_sha256 of the text rebuilt from its output and form alone, in one pass."""
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return _by_duckdb(rows, round_trip_sql("batch", **options), TRANSFORMED + ", restored_sha256 string", "text")


ORACLE = f"SELECT * EXCLUDE (output) FROM ({round_trip_sql('documents')})"
