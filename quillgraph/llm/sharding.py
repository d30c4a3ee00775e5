"""Proportional stratified interleaving into shards, by DataFrame expressions alone.

Rows of a source are ranked in a seeded pseudo-random order (md5 of seed and id), placed at
the fractional rank (rank - 1/2) / rows, sorted by it over all sources, and the sorted order
is cut into shards whose row counts differ by one at most; so each cut holds the mixture.

No window ever holds a source or the table: ranks are counted within (source, bucket of the
hash) and (bucket of the fraction), where buckets are uniform because the hash is, and the
offsets before each bucket come from tables of ``BUCKETS`` rows a source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 4096
SHARDS = 16
SEED = 20240601


def _before(counts: DataFrame, keys: list[str], bucket: str) -> DataFrame:
    """counts(keys, bucket, n) with the rows of smaller buckets, ``before``, and ``total``."""
    every = Window.partitionBy(*keys) if keys else Window.partitionBy()
    order = every.orderBy(bucket).rowsBetween(Window.unboundedPreceding, 0)
    return counts.select(*keys, bucket, (F.sum("n").over(order) - F.col("n")).alias("before"), F.sum("n").over(every).alias("total"))


def interleave(rows: DataFrame, key: Column, stratum: Column, shards: int = SHARDS, seed: int = SEED, buckets: int = BUCKETS) -> DataFrame:
    """``rows`` plus shard int and slot long; law "rows".

    A null stratum is one of its own; a null key hashes as ''. Rows with equal keys tie and
    take neighbouring ranks; repeated rows all get a place. An empty table gives no rows.
    ``rows`` keeps its columns; the added internal names start with ``_il_``.
    """
    names = rows.columns
    digest = F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(key.cast("string"), F.lit(""))))
    base = rows.select(
        *names,
        F.when(stratum.isNull(), F.lit("")).otherwise(F.concat(F.lit("s"), stratum.cast("string"))).alias("_il_s"),
        digest.alias("_il_h"),
    ).withColumn("_il_b", F.conv(F.substring("_il_h", 1, 8), 16, 10).cast("long") % buckets)
    strata = _before(base.groupBy("_il_s", "_il_b").agg(F.count(F.lit(1)).alias("n")), ["_il_s"], "_il_b")
    strata = strata.withColumnsRenamed({"before": "_il_before", "total": "_il_n"})
    # md5's first hex digits decide the bucket, so the order inside a source is (bucket, digest).
    local = F.row_number().over(Window.partitionBy("_il_s", "_il_b").orderBy("_il_h", *[n for n in names if n == "doc_id"]))
    ranked = base.withColumn("_il_r", local).join(strata, ["_il_s", "_il_b"])
    fraction = (2 * (F.col("_il_before") + F.col("_il_r")) - 1).cast("double") / (2 * F.col("_il_n")).cast("double")
    ranked = ranked.select(*names, "_il_s", "_il_h", fraction.alias("_il_f")).withColumn("_il_c", F.floor(F.col("_il_f") * buckets))
    cuts = _before(ranked.groupBy("_il_c").agg(F.count(F.lit(1)).alias("n")), [], "_il_c").withColumnsRenamed({"before": "_il_at", "total": "_il_all"})
    place = F.row_number().over(Window.partitionBy("_il_c").orderBy("_il_f", "_il_s", "_il_h"))
    placed = ranked.withColumn("_il_p", place).join(F.broadcast(cuts), "_il_c")  # at most `buckets` rows
    position = F.col("_il_at") + F.col("_il_p") - 1
    shard = F.expr(f"(_il_at + _il_p - 1) * {shards} div _il_all")
    first = F.expr(f"(_il_shard * _il_all + {shards - 1}) div {shards}")
    return placed.withColumn("_il_shard", shard).select(*names, F.col("_il_shard").cast("int").alias("shard"), (position - first).cast("long").alias("slot"))


def shard_documents(documents: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """documents(doc_id, text, source) -> doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    rows = documents.select(
        "doc_id",
        "source",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
    )
    # The text is in the key too: rows that share an id, or have none, spread like others.
    key = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("|"), F.col("text_crc32").cast("string"))
    out = interleave(rows, key, F.col("source"), shards, seed)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source")


#: DuckDB has no crc32: the table-driven form, over the UTF-8 bytes.
CRC_SQL = """
crc_t AS (SELECT list(c ORDER BY n) AS t FROM (SELECT n, list_reduce([CAST(n AS BIGINT)] || CAST(range(8) AS BIGINT[]), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS c FROM range(256) r(n))),
crc_b AS (SELECT text, list_transform(range(len(hx) // 2), lambda i: CAST('0x' || substr(hx, CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT)) AS bytes FROM (SELECT DISTINCT coalesce(text, '') AS text, hex(encode(coalesce(text, ''))) AS hx FROM documents)),
crc AS (SELECT text, xor(list_reduce([4294967295] || bytes, lambda a, b: xor(a >> 8, t[CAST(xor(a, b) & 255 AS BIGINT) + 1])), 4294967295) AS crc FROM crc_b, crc_t)
"""

ORACLE = f"""
WITH {CRC_SQL}, d AS (
  SELECT doc_id, source, CASE WHEN none THEN NULL ELSE text END AS text, CASE WHEN source IS NULL THEN '' ELSE 's' || source END AS s,
    md5('{SEED}|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || crc) AS h, crc FROM (SELECT doc_id, source, coalesce(text, '') AS text, text IS NULL AS none FROM documents) JOIN crc USING (text)),
r AS (
  SELECT *, row_number() OVER (PARTITION BY s ORDER BY CAST('0x' || substr(h, 1, 8) AS BIGINT) % {BUCKETS}, h, doc_id) AS r,
    count(*) OVER (PARTITION BY s) AS n FROM d),
p AS (
  SELECT *, row_number() OVER (ORDER BY CAST(2 * r - 1 AS DOUBLE) / CAST(2 * n AS DOUBLE), s, h) - 1 AS p, count(*) OVER () AS m FROM r),
q AS (SELECT *, (p * {SHARDS}) // m AS shard FROM p)
SELECT doc_id, CAST(coalesce(octet_length(encode(q.text)), 0) + 1 AS BIGINT) AS size,
  CAST(crc AS BIGINT) AS text_crc32, 'rows' AS law, CAST(shard AS INTEGER) AS shard,
  CAST(p - (shard * m + {SHARDS - 1}) // {SHARDS} AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard, source
FROM q
"""
