"""The chat queue as append-only tables: requests, results, analytics; and a listener for events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import QueryIdleEvent, QueryProgressEvent, QueryStartedEvent, QueryTerminatedEvent, StreamingQueryListener

ANSWER_CHARS = 500
ANALYTICS_ROWS = 10_000


def _entry(*fields: Column) -> list[Column]:
    """Fields of a queue entry: all strings, and when it was made."""
    return [f.cast("string") for f in fields] + [F.unix_timestamp(F.current_timestamp()).cast("string").alias("timestamp")]


def _json(metadata: str | Column | None) -> Column:
    value = F.col(metadata) if isinstance(metadata, str) else metadata
    return (F.lit("{}") if value is None else F.coalesce(F.to_json(value), F.lit("{}"))).alias("metadata")


def requests(rows: DataFrame, metadata: str | Column | None = None) -> DataFrame:
    """rows(conversation_id, user_message_id, question[, top_k_vector, top_k_graph]) -> request entries; five of each kind unless said."""
    k = lambda c: (F.coalesce(F.col(c), F.lit(5)) if c in rows.columns else F.lit(5)).alias(c)
    return rows.select(*_entry(F.col("conversation_id"), F.col("user_message_id"), F.col("question"), k("top_k_vector").cast("string").alias("top_k_vector"), k("top_k_graph").cast("string").alias("top_k_graph")), _json(metadata))


def results(rows: DataFrame, metadata: str | Column | None = None) -> DataFrame:
    """rows(conversation_id, assistant_message_id, answer, latency_ms) -> result entries; answers are cut to ``ANSWER_CHARS``."""
    return rows.select(*_entry(F.col("conversation_id"), F.col("assistant_message_id"), F.substring("answer", 1, ANSWER_CHARS).alias("answer"), F.col("latency_ms")), _json(metadata))


def analytics(rows: DataFrame, order: str, keep: int = ANALYTICS_ROWS) -> DataFrame:
    """rows(event_type, data, ``order``) -> the newest ``keep`` events, data as JSON."""
    newest = rows.orderBy(F.col(order).desc()).limit(keep)
    return newest.select(F.col("event_type").cast("string").alias("event_type"), F.to_json("data").alias("data"), F.col(order))


class EventListener(StreamingQueryListener):
    """Hands each progress of a streaming query to ``handle``; fire and forget, an error in it is swallowed as nobody waits for it."""

    def __init__(self, handle: Callable[[dict], None]):
        self.handle = handle

    def _tell(self, kind: str, **fields: object) -> None:
        try:
            self.handle({"kind": kind, **fields})
        except Exception:
            pass

    def onQueryStarted(self, event: QueryStartedEvent) -> None:
        self._tell("started", id=str(event.id))

    def onQueryProgress(self, event: QueryProgressEvent) -> None:
        self._tell("progress", id=str(event.progress.id), rows=event.progress.numInputRows)

    def onQueryIdle(self, event: QueryIdleEvent) -> None:
        self._tell("idle", id=str(event.id))

    def onQueryTerminated(self, event: QueryTerminatedEvent) -> None:
        self._tell("terminated", id=str(event.id))
