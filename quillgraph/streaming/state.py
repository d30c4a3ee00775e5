"""Stateful stream operators, each with a batch twin that gives the same rows.

Batch twins are windows over (key, time). The streams use built-in session windows, duplicate
removal within a watermark, and ``transformWithStateInPandas`` where a running answer a row is needed.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RATE_SCHEMA = "user_id bigint, event_id bigint, ts timestamp, n int, allowed boolean"


def rate_limit(events: DataFrame, limit: int, gap_seconds: int) -> DataFrame:
    """events(user_id, event_id, ts) -> n, the request's number in its burst, and allowed (n <= limit).

    Every request prolongs the burst, so a counter only starts again after ``gap_seconds`` without one:
    a session by inactivity. Ties in time are ordered by event_id.
    """
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    since = F.unix_micros(F.col("ts").cast("timestamp")) - F.lag(F.unix_micros(F.col("ts").cast("timestamp"))).over(order)
    fresh = (since.isNull() | (since >= gap_seconds * 1_000_000)).cast("int")
    marked = events.withColumn("_fresh", fresh).withColumn("_burst", F.sum("_fresh").over(order))
    n = F.row_number().over(Window.partitionBy("user_id", "_burst").orderBy("ts", "event_id"))
    return marked.withColumn("n", n).withColumn("allowed", F.col("n") <= limit).drop("_fresh", "_burst")


def rate_limit_stream(events: DataFrame, limit: int, gap_seconds: int) -> DataFrame:
    """The same over a stream: per user the last time and count are state. Needs the RocksDB state store."""
    from pyspark.sql.streaming.stateful_processor import StatefulProcessor

    class Limiter(StatefulProcessor):
        def init(self, handle):
            self.state = handle.getValueState("burst", "last bigint, n int")

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
            batch = pd.concat(list(rows)).sort_values(["ts", "event_id"])
            last, n = self.state.get() if self.state.exists() else (None, 0)
            counts = []
            for t in batch["ts"].astype("int64") // (1000 if str(batch["ts"].dtype).startswith("datetime64[ns") else 1):
                n = 1 if last is None or t - last >= gap_seconds * 1_000_000 else n + 1
                last = int(t)
                counts.append(n)
            self.state.update((last, n))
            yield pd.DataFrame({"user_id": batch["user_id"], "event_id": batch["event_id"], "ts": batch["ts"], "n": counts, "allowed": [c <= limit for c in counts]})

        def close(self):
            pass

    return events.select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts")).groupBy("user_id").transformWithStateInPandas(Limiter(), outputStructType=RATE_SCHEMA, outputMode="append", timeMode="none")


def cache_hits(requests: DataFrame, ttl_seconds: int) -> DataFrame:
    """requests(key, request_id, ts) -> key, request_id, hit: whether a stored answer of the key is still alive.

    An entry is stored by a miss and lives ``ttl_seconds``; hits don't prolong it. Keys are read in
    order of time with one remembered time each, so memory stays constant however hot a key is.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key = stored = None
        for batch in batches:
            hits = []
            for k, t in zip(batch["key"], batch["t"]):
                hits.append(k == key and t - stored < ttl_seconds * 1_000_000)
                if not hits[-1]:
                    key, stored = k, t
            yield batch[["key", "request_id"]].assign(hit=hits)

    rows = requests.select(F.col("key").cast("string").alias("key"), F.col("request_id").cast("long").alias("request_id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    return rows.repartition("key").sortWithinPartitions("key", "t", "request_id").mapInPandas(run, "key string, request_id long, hit boolean")


CACHE_SCHEMA = "key string, request_id bigint, hit boolean"


def cache_stream(requests: DataFrame, ttl_seconds: int, kept_ms: int | None = None) -> DataFrame:
    """The same over a stream: a hit or a miss for every request. A key's stored time is its state, and is dropped ``kept_ms`` after it was
    written (ten lives, unless told), so keys that are never asked again cost nothing. Needs the RocksDB state store.

    Requests of a batch are read in order of time. With processing time Spark runs batches without data for as long as the
    query lives; one that has to end (``availableNow``) needs ``spark.sql.streaming.noDataMicroBatches.enabled`` off.
    """
    from pyspark.sql.streaming.stateful_processor import StatefulProcessor

    class Cache(StatefulProcessor):
        def init(self, handle):
            self.entry = handle.getValueState("entry", "stored bigint", kept_ms or 10_000 * ttl_seconds)

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
            batch = pd.concat(list(rows)).sort_values(["t", "request_id"])
            stored, hits = self.entry.get()[0] if self.entry.exists() else None, []
            for t in batch["t"]:
                hits.append(stored is not None and t - stored < ttl_seconds * 1_000_000)
                if not hits[-1]:
                    stored = int(t)
                    self.entry.update((stored,))
            yield pd.DataFrame({"key": batch["key"], "request_id": batch["request_id"], "hit": hits})

        def close(self):
            pass

    rows = requests.select(F.col("key").cast("string").alias("key"), F.col("request_id").cast("long").alias("request_id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    return rows.groupBy("key").transformWithStateInPandas(Cache(), outputStructType=CACHE_SCHEMA, outputMode="append", timeMode="processingTime")


def cache_misses_stream(requests: DataFrame, ttl: str) -> DataFrame:
    """A stream's first request of each key within the watermark ``ttl``: those that must be answered."""
    return requests.withWatermark("ts", ttl).dropDuplicatesWithinWatermark(["key"])


def retained(events: DataFrame, keep: int, order: str = "event_id") -> DataFrame:
    """The last ``keep`` events: a capped stream."""
    return events.orderBy(F.col(order).desc()).limit(keep)


def windowed_counts(events: DataFrame, by: list[str], size: str, slide: str | None = None, watermark: str | None = None) -> DataFrame:
    """Tumbling or sliding event-time counts, over a table or a stream."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    rows = rows.withWatermark("ts", watermark) if watermark else rows
    window = F.window("ts", size, slide) if slide else F.window("ts", size)
    out = rows.groupBy(window.alias("w"), *by).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n", "total")


def session_counts(events: DataFrame, by: list[str], gap: str, watermark: str | None = None) -> DataFrame:
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    rows = rows.withWatermark("ts", watermark) if watermark else rows
    out = rows.groupBy(F.session_window("ts", gap).alias("w"), *by).agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n")
