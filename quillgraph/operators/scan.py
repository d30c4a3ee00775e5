"""Running sums of groups that may be larger than a task: a scan in two passes.

Rows are dealt by range of (group, order), so that a large group lies in several parts. Each part sums its own rows; a table of one row a
group and part gives what stands before; the second pass adds it. The result is a window's, without its one task a group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.io import stored


def running(rows: DataFrame, by: str, order: list[str], sums: dict[str, Column]) -> DataFrame:
    """``rows`` plus, for each of ``sums``, the sum (long) over the group's rows up to this one by ``order``, which tells rows apart.

    Null groups are one group; null values count as nothing.
    """
    names = list(sums)
    keyed = rows.withColumns({n: F.coalesce(c.cast("long"), F.lit(0)) for n, c in sums.items()} | {"_group": F.coalesce(F.concat(F.lit("g"), F.col(by).cast("string")), F.lit(""))})
    dealt = keyed.repartitionByRange("_group", *order).sortWithinPartitions("_group", *order)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, last, carry = TaskContext.get().partitionId(), None, dict.fromkeys(names, 0)
        for batch in batches:
            group = batch.column("_group").to_numpy(zero_copy_only=False)
            if not len(group):
                continue
            first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
            lengths = np.diff(np.append(first, len(group)))
            out = {c: batch.column(c) for c in batch.schema.names}
            for n in names:
                total = np.cumsum(batch.column(n).to_numpy())
                own = total - np.repeat(np.where(first > 0, total[first - 1], 0), lengths)
                if group[0] == last:
                    own[: lengths[0]] += carry[n]
                out[n], carry[n] = pa.array(own, pa.int64()), int(own[-1])
            last = group[-1]
            yield pa.RecordBatch.from_arrays([*out.values(), pa.array(np.full(len(group), part), pa.int32())], names=[*out, "_part"])

    held = stored(dealt.mapInArrow(run, f"{kinds}, _part int"), "scan")
    # Sums here are counts, lengths and flags, none below zero: a part's largest is its last.
    blocks = held.groupBy("_group", "_part").agg(*[F.max(n).alias(n) for n in names])
    before = Window.partitionBy("_group").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carries = blocks.select("_group", "_part", *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"_before_{n}") for n in names])
    return held.join(carries, ["_group", "_part"]).select(*rows.columns, *[(F.col(n) + F.col(f"_before_{n}")).alias(n) for n in names])


def batches_of(rows: DataFrame, order: list[str], size: int, name: str = "batch") -> DataFrame:
    """``rows`` plus the number, from 0, of their batch of ``size`` rows by ``order``, which tells rows apart. Only the last batch is smaller, however
    the table is cut. An empty table has no batch."""
    counted = running(rows.withColumn("_all", F.lit(0)), "_all", order, {"_rn": F.lit(1)})
    return counted.select(*rows.columns, F.expr(f"(_rn - 1) div {int(size)}").alias(name))


def bursts(rows: DataFrame, by: str, time: str, tie: str, gap_seconds: int) -> DataFrame:
    """``rows`` plus ``n``, the row's number in its burst: the rows of a group by (``time``, ``tie``) up to a pause of ``gap_seconds`` or more.

    The window ``streaming.state.rate_limit`` gives the same rows, a group a task. Here each part numbers its own rows and notes which
    may go on from the part before; a table of one row a group and part gives what they go on from. A null time starts a burst and
    ends it; null groups are one group.
    """
    gap = gap_seconds * 1_000_000
    keyed = rows.withColumns({"_t": F.unix_micros(F.col(time).cast("timestamp")), "_tie": F.col(tie), "_group": F.coalesce(F.concat(F.lit("g"), F.col(by).cast("string")), F.lit(""))})
    keyed = keyed.withColumns({"_known": F.col("_t").isNotNull(), "_micros": F.coalesce("_t", F.lit(0))})
    dealt = keyed.repartitionByRange("_group", "_t", "_tie").sortWithinPartitions("_group", "_t", "_tie")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, last, last_t, last_known, last_n, last_open = TaskContext.get().partitionId(), None, 0, False, 0, True
        for batch in batches:
            group, t, known = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("_group", "_micros", "_known"))
            if not len(group):
                continue
            at = np.arange(len(group))
            same = np.concatenate([[group[0] == last], group[1:] == group[:-1]]).astype(bool)
            pause = t - np.concatenate([[last_t], t[:-1]]) >= gap
            both = known & np.concatenate([[last_known], known[:-1]])
            fresh = same & (pause | ~both)
            start, head, new = (np.maximum.accumulate(np.where(x, at, -1)) for x in (fresh | ~same, ~same, fresh))
            n = np.where(start >= 0, at - start + 1, at + 1 + last_n)
            still = np.where(head >= 0, new < head, last_open & (new < 0))
            last, last_t, last_known, last_n, last_open = group[-1], t[-1], known[-1], n[-1], still[-1]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n, pa.int64()), pa.array(still.astype(bool)), pa.array(np.full(len(at), part), pa.int32())], names=[*batch.schema.names, "n", "_open", "_part"])

    held = stored(dealt.mapInArrow(run, f"{kinds}, n long, _open boolean, _part int"), "bursts")
    blocks = held.groupBy("_group", "_part").agg(F.min(F.struct("_t", "_tie")).alias("first"), F.max(F.struct("_t", "_tie", "n")).alias("last"), F.bool_and("_open").alias("whole"))
    order = Window.partitionBy("_group").orderBy("_part")
    before = blocks.withColumns({"end": F.lag("last").over(order), "whole_before": F.lag("whole").over(order)})
    paused = F.coalesce(F.col("first._t") - F.col("end._t") >= gap, F.lit(True))
    before = before.withColumns({"adds": F.when(paused, 0).otherwise(F.col("end.n")), "_seg": F.sum((paused | ~F.col("whole_before")).cast("int")).over(order)})
    carry = F.sum("adds").over(Window.partitionBy("_group", "_seg").orderBy("_part"))
    carries = before.select("_group", "_part", carry.alias("_carry"))
    n = F.col("n") + F.when(F.col("_open"), F.col("_carry")).otherwise(0)
    return held.join(carries, ["_group", "_part"]).select(*rows.columns, n.cast("int").alias("n"))


def within_budget(chunks: DataFrame, by: str, order: str, text: str, limit: int) -> DataFrame:
    """As ``answer.within_budget``, for groups of any size: chunks in order while their summed length stays within the limit, the first always."""
    summed = running(chunks, by, [order], {"cum": F.length(text), "_rn": F.lit(1)})
    return summed.where((F.col("cum") <= limit) | (F.col("_rn") == 1)).drop("_rn")


def span(chunks: DataFrame, by: str, order: str, key: Column, wanted: str) -> DataFrame:
    """As ``answer.span``, for groups of any size: from the first chunk whose key is ``wanted`` up to the next with another key."""
    keyed = running(chunks.withColumn("_k", key), by, [order], {"_on": (F.col("_k") == wanted).cast("int")})
    stop = (F.col("_on") > 0) & (F.col("_k") != "") & (F.col("_k") != wanted)
    return running(keyed, by, [order], {"_off": stop.cast("int")}).where("_on > 0 and _off = 0").drop("_k", "_on", "_off")
