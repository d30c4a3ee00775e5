"""Exact deduplication by an extendible-hash index on shared files.

1. Every task reads its partition once, normalises texts and keeps a chained table of its own
   distinct texts (64-bit key -> chain of texts, compared byte by byte). It writes two kinds of
   index rows to shared files: a *member* row a document (which local group it is in) and an
   *entry* row a local group (key, bytes, count, best document). Copies are so combined
   before anything moves: a group that holds a third of all rows is one entry a task.
2. The directory starts at depth 0 and doubles while a bucket holds more than ``CAPACITY``
   distinct keys or ``BUCKET_BYTES`` of entries; a bucket that isn't overfull keeps its smaller local depth and is shared by
   several directory slots. Only key counts by prefix reach the driver (``2**depth`` numbers).
3. Owner tasks take whole buckets, that is key ranges. Inside one, entries of equal key form a
   chain; their bytes are compared, so colliding texts stay apart. Each local group learns its
   group's survivor and size.
4. Members join their local group's answer.

A bucket that no split can shrink, as it is one text that stands in very many tasks, is *hot*. Its entries are first dealt
out into runs of ``BUCKET_BYTES``; each run chains and compares its own and sends one entry a distinct text on, run after run until
the bucket fits. So no task holds more of a group of copies than a run, however many tasks met it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import ROW, numbered, public_id, row_id, stored, tidy, without_rows

WHITE = b" \t\n\v\f\r"
CAPACITY = 4096
#: Bytes of entries above which a bucket splits too.
BUCKET_BYTES = 64 << 20
MAX_DEPTH = 20
#: What an entry counts for beside its text, and the fewest entries that make a run of a hot bucket.
ENTRY_BYTES = 200
LEAST_RUN = 8
#: A task writes its entries out and starts a new local table at this many bytes of text.
LOCAL_BYTES = 32 << 20

ENTRY = f"kind int, gid long, key long, prefix int, body binary, doc_id long, n_chars long, members long, sha string, {ROW} long"
_INDEX = pa.schema([("kind", pa.int32()), ("gid", pa.int64()), ("key", pa.int64()), ("prefix", pa.int32()), ("body", pa.binary()), ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("members", pa.int64()), ("sha", pa.string()), (ROW, pa.int64())])


def digest64(body: bytes) -> int:
    """Index key of a normalised text: the first eight bytes of its SHA-256, signed."""
    return int.from_bytes(hashlib.sha256(body).digest()[:8], "big", signed=True)


def _local_index(hasher: Callable[[bytes], int] | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        gid0 = (TaskContext.get().partitionId() + 1) << 36
        schema = _INDEX
        table: dict[int, list[list]] = {}
        held, made = 0, 0

        def entries(size: int = 2 << 20) -> Iterator[pa.RecordBatch]:
            rows, n = [], 0
            for key, chain in table.items():
                for body, gid, best, count, sha in chain:
                    rows.append((1, gid, key, (key >> (64 - MAX_DEPTH)) & ((1 << MAX_DEPTH) - 1), body, best[1], -best[0], count, sha, best[2]))
                    n += len(body)
                    if n > size or len(rows) >= 4000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)
                        rows, n = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)
            table.clear()

        for batch in batches:
            docs = batch.column("doc_id").to_pylist()
            sizes = batch.column("n").to_pylist()
            rows = batch.column(ROW).to_pylist()
            gids = []
            for doc, chars, row, text in zip(docs, sizes, rows, batch.column("text").cast(pa.binary())):
                body = text.as_py().translate(None, WHITE)
                sha = hashlib.sha256(body)
                key = hasher(body) if hasher else int.from_bytes(sha.digest()[:8], "big", signed=True)
                chain = table.setdefault(key, [])
                for slot in chain:
                    if slot[0] == body:
                        slot[2] = min(slot[2], (-chars, doc, row))
                        slot[3] += 1
                        break
                else:
                    chain.append(slot := [body, gid0 + made, (-chars, doc, row), 1, sha.hexdigest()])
                    made += 1
                    held += len(body) + 300
                gids.append(slot[1])
            n = len(docs)
            none = pa.nulls(n, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(n, np.int32)), pa.array(gids, pa.int64()), none, pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()), pa.array(docs, pa.int64()), none, none, pa.nulls(n, pa.string()), batch.column(ROW)], schema=schema)
            if held > LOCAL_BYTES:
                yield from entries()
                held = 0
        yield from entries()
        tidy()

    return run


def directory(counts: np.ndarray, capacity: int = CAPACITY, sizes: np.ndarray | None = None, room: int = BUCKET_BYTES) -> tuple[np.ndarray, int]:
    """Key counts, and bytes of their entries, by ``MAX_DEPTH``-bit prefix (or fewer) -> (bucket of each directory slot, global depth).

    Extendible hashing: an overfull bucket of local depth d, by keys or by bytes, splits into two of depth
    d + 1; the directory doubles when d was the global depth. Buckets of one key, and those at the
    histogram's depth, stay whole.
    """
    deepest = int(len(counts)).bit_length() - 1
    sums = [np.concatenate([[0], np.cumsum(x)]) for x in (counts, np.zeros(len(counts), np.int64) if sizes is None else sizes)]

    def full(depth: int, slot: int) -> bool:
        keys, held = (x[(slot + 1) << (deepest - depth)] - x[slot << (deepest - depth)] for x in sums)
        return keys > capacity or held > room and keys > 1

    buckets, done, depth = [(0, 0)], [], 0
    while buckets:
        d, slot = buckets.pop()
        if d < deepest and full(d, slot):
            buckets += [(d + 1, 2 * slot), (d + 1, 2 * slot + 1)]
            depth = max(depth, d + 1)
        else:
            done.append((d, slot))
    out = np.empty(1 << depth, np.int32)
    for number, (d, slot) in enumerate(sorted(done, key=lambda x: x[1] << (depth - x[0]))):
        out[slot << (depth - d) : (slot + 1) << (depth - d)] = number
    return out, depth


def _chained(table: pa.Table) -> list[list]:
    """The slot [bytes, best document, members, first entry] of each entry: entries of equal key form a chain, bytes are compared."""
    chains: dict[int, list[list]] = {}
    slots = []
    keys, docs, chars, members, rows = (table.column(c).to_pylist() for c in ("key", "doc_id", "n_chars", "members", ROW))
    body = table.column("body")
    for i, key in enumerate(keys):
        chain = chains.setdefault(key, [])
        mine = body[i].as_buffer()
        for slot in chain:
            if slot[0].equals(mine):
                slot[1] = min(slot[1], (-chars[i], docs[i], rows[i]))
                slot[2] += members[i]
                break
        else:
            chain.append(slot := [mine, (-chars[i], docs[i], rows[i]), members[i], i])
        slots.append(slot)
    return slots


def _run(table: pa.Table) -> pa.Table:
    """One run of a hot bucket: an entry a distinct text (kind 1) with its first entry's gid, and which gid stands for each entry (kind 0, in ``key``)."""
    slots = _chained(table)
    gid = table.column("gid").to_pylist()
    leads = {s[3]: s for s in slots}
    first = table.take(pa.array(list(leads), pa.int64()))
    best = list(zip(*[(-s[1][0], s[1][1], s[1][2], s[2]) for s in leads.values()]))
    new = dict(zip(("n_chars", "doc_id", ROW, "members"), (pa.array(c, pa.int64()) for c in best))) | {"kind": pa.array([1] * len(leads), pa.int32())}
    entries = pa.table([new.get(f.name, first.column(f.name) if f.name in first.column_names else pa.nulls(len(leads), f.type)) for f in _INDEX], schema=_INDEX)
    told = {"kind": pa.array([0] * len(slots), pa.int32()), "gid": table.column("gid"), "key": pa.array([gid[s[3]] for s in slots], pa.int64())}
    return pa.concat_tables([entries, pa.table([told.get(f.name, pa.nulls(len(slots), f.type)) for f in _INDEX], schema=_INDEX)])


def _owner(table: pa.Table) -> pa.Table:
    """One bucket: answer each local group."""
    slots = _chained(table)
    return pa.table({"gid": table.column("gid"), "keep_id": pa.array([s[1][1] for s in slots], pa.int64()), "group_size": pa.array([s[2] for s in slots], pa.int64()), "sha": table.column("sha"), "keep_row": pa.array([s[1][2] for s in slots], pa.int64())})


def exact_groups(docs: DataFrame, hasher: Callable[[bytes], int] | None = None, capacity: int = CAPACITY, room: int = BUCKET_BYTES) -> DataFrame:
    """docs(doc_id, text) -> doc_id, keep_id, group_size, kept, text_sha256: one row per row.

    Texts are equal when identical without ASCII white space (null: empty). The row with the
    most code points stays, then the least doc_id; a null doc_id orders before others. Of rows that tie in
    both exactly one is kept. An empty table gives
    no rows; other columns are ignored. ``hasher`` replaces the key function (tests force
    collisions with it).
    """
    out = _groups(numbered(docs), hasher, capacity, room).drop(ROW)
    return out.withColumns({"doc_id": public_id("doc_id"), "keep_id": public_id("keep_id")})


def drop_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``exact_groups`` keeps, one a group, with all their columns."""
    rows = numbered(docs)
    return without_rows(rows, _groups(rows).where("not kept"))


def runs_of(held: np.ndarray, entries: np.ndarray, room: int) -> np.ndarray:
    """Runs that each bucket's entries are dealt into: about ``room`` bytes each, and ``LEAST_RUN`` entries at least, so that runs of copies shrink."""
    return np.maximum(1, np.minimum(-(-held // room), entries // LEAST_RUN)).astype(np.int64)


def cooled(placed: DataFrame, sizes: pd.DataFrame, room: int = BUCKET_BYTES) -> tuple[DataFrame, list[DataFrame]]:
    """Entries with their ``bucket``, and ``sizes`` (bucket, held, entries, least: bytes if each key stood once), a row a bucket -> entries whose
    overfull buckets hold few copies, and for each round of runs the pairs (gid, lead): which entry stands for which."""
    spark, told, cold = placed.sparkSession, [], []
    sizes = sizes.assign(runs=runs_of(sizes["held"].to_numpy(), sizes["entries"].to_numpy(), room))
    sizes = sizes[(sizes["runs"] > 1) & (2 * sizes["least"] <= sizes["held"])]
    while len(sizes):
        hot = F.broadcast(spark.createDataFrame(sizes[["bucket", "runs"]]))  # a row a bucket, at most 2**MAX_DEPTH
        cold.append(placed.join(hot, "bucket", "left_anti"))
        dealt = placed.join(hot, "bucket").withColumn("run", F.pmod(F.xxhash64("gid"), F.col("runs"))).drop("runs")
        bucket = F.col("bucket").cast("long").alias("bucket")

        def run(key: tuple, table: pa.Table) -> pa.Table:
            out = _run(table.drop_columns(["bucket", "run"]))
            return out.append_column("bucket", pa.array([key[0].as_py()] * len(out), pa.int64()))

        out = stored(dealt.withColumn("bucket", bucket).groupBy("bucket", "run").applyInArrow(run, f"{ENTRY}, bucket long"), "exact-runs", "kind")
        told.append(out.where("kind = 0").select("gid", F.col("key").alias("lead")))
        placed = out.where("kind = 1").select(*placed.columns)
        before = sizes[["bucket", "held"]].rename(columns={"held": "was"})
        left = placed.groupBy("bucket").agg(F.sum(F.octet_length("body") + ENTRY_BYTES).alias("held"), F.count(F.lit(1)).alias("entries")).toPandas()  # a row a hot bucket
        left = left.merge(before, on="bucket")
        left = left.assign(runs=runs_of(left["held"].to_numpy(), left["entries"].to_numpy(), room))
        sizes = left[(left["runs"] > 1) & (2 * left["held"] <= left["was"])]  # while runs halve it at least
    for part in cold:
        placed = placed.unionByName(part)
    return placed, told


def _groups(docs: DataFrame, hasher: Callable[[bytes], int] | None = None, capacity: int = CAPACITY, room: int = BUCKET_BYTES) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    source = docs.select(row_id(), F.char_length(text).cast("long").alias("n"), text.alias("text"), ROW)
    index = stored(source.mapInArrow(_local_index(hasher), ENTRY), "exact-index", "kind")
    entries, members = index.where("kind = 1"), index.where("kind = 0")
    keys = entries.groupBy("prefix", "key").agg(F.sum(F.octet_length("body") + ENTRY_BYTES).alias("bytes"), F.count(F.lit(1)).alias("entries"))
    keys = keys.withColumn("least", F.col("bytes") / F.col("entries"))
    total = entries.agg(F.approx_count_distinct("key")).first()[0]
    deepest = min(MAX_DEPTH, max(1, int(4 * total / capacity).bit_length() + 2))
    counts, sizes, many, least = np.zeros((4, 1 << deepest), np.int64)
    for p, n, size, rows, once in keys.groupBy(F.shiftright("prefix", MAX_DEPTH - deepest).alias("p")).agg(F.count(F.lit(1)), F.sum("bytes"), F.sum("entries"), F.sum("least")).collect():
        counts[p], sizes[p], many[p], least[p] = n, size, rows, once
    slots, depth = directory(counts, capacity, sizes, room)
    of = slots[np.arange(1 << deepest) >> (deepest - depth)]
    held, many, least = (np.bincount(of, weights=x).astype(np.int64) for x in (sizes, many, least))
    # The directory as a table of 2**depth slots, at most 2**MAX_DEPTH: it may be broadcast.
    spread = docs.sparkSession.createDataFrame(pd.DataFrame({"slot": np.arange(len(slots)), "bucket": slots}))
    placed = (
        entries.withColumn("slot", F.shiftright("prefix", MAX_DEPTH - depth).cast("long"))
        .join(F.broadcast(spread), "slot")
        .select("bucket", "gid", "key", "body", "doc_id", "n_chars", "members", "sha", ROW)
    )
    placed, told = cooled(placed, pd.DataFrame({"bucket": np.arange(len(held)), "held": held, "entries": many, "least": least}), room)
    answers = placed.groupBy("bucket").applyInArrow(_owner, "gid long, keep_id long, group_size long, sha string, keep_row long")
    for pairs in reversed(told):  # a run's entries learn what its lead learnt
        learnt = pairs.where("gid <> lead").join(answers.withColumnRenamed("gid", "lead"), "lead").drop("lead")
        answers = stored(answers.unionByName(learnt.select(*answers.columns)), "exact-answers")
    out = members.select("gid", "doc_id", ROW).join(answers, "gid")
    return out.select("doc_id", "keep_id", "group_size", (F.col(ROW) == F.col("keep_row")).alias("kept"), F.col("sha").alias("text_sha256"), ROW)


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
g AS (SELECT doc_id, norm, first_value(doc_id) OVER w AS keep_id, row_number() OVER w = 1 AS kept, count(*) OVER (PARTITION BY norm) AS group_size FROM d
  WINDOW w AS (PARTITION BY norm ORDER BY length(text) DESC, doc_id))
SELECT doc_id, keep_id, group_size, kept, sha256(norm) AS text_sha256 FROM g
"""
