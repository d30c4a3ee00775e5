"""Batch twins of the stream operators, and event-time windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming import state as ST
from . import surrogates as S

QUERIES: dict = {}
ORACLES: dict = {}


def register(name: str, oracle: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if oracle is not None:
            ORACLES[name] = S.sql(oracle)
        return f

    return keep


@register(
    "stm4_rate_limit",
    """WITH a AS (SELECT user_id, event_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 3600 SECOND THEN 1 ELSE 0 END AS f FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    b AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS burst FROM a)
    SELECT event_id, CAST(row_number() OVER (PARTITION BY user_id, burst ORDER BY ts, event_id) AS INTEGER) AS n, row_number() OVER (PARTITION BY user_id, burst ORDER BY ts, event_id) <= 1 AS allowed FROM b""",
)
def stm4(s, d):
    return ST.rate_limit(S.raw(s, d, "events").select("user_id", "event_id", "ts"), 1, 3600).select("event_id", "n", "allowed")


@register(
    "stm5_cache_hits",
    """WITH RECURSIVE r AS (SELECT event_type || user_id % 10 AS key, event_id, ts, row_number() OVER (PARTITION BY event_type || user_id % 10 ORDER BY ts, event_id) AS i FROM events),
    f AS (SELECT key, event_id, ts, i, ts AS stored, FALSE AS hit FROM r WHERE i = 1
      UNION ALL SELECT r.key, r.event_id, r.ts, r.i, CASE WHEN r.ts - f.stored < INTERVAL 3600 SECOND THEN f.stored ELSE r.ts END, r.ts - f.stored < INTERVAL 3600 SECOND FROM f JOIN r ON r.key = f.key AND r.i = f.i + 1)
    SELECT key, event_id AS request_id, hit FROM f""",
)
def stm5(s, d):
    e = S.raw(s, d, "events").select(F.concat("event_type", (F.col("user_id") % 10).cast("string")).alias("key"), F.col("event_id").alias("request_id"), "ts")
    return ST.cache_hits(e, 3600)


@register("stm3_retained_events", "SELECT event_id, event_type FROM events ORDER BY event_id DESC LIMIT 500")
def stm3(s, d):
    return ST.retained(S.raw(s, d, "events").select("event_id", "event_type"), 500)


@register("ext_tumbling_counts", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def tumbling(s, d):
    out = ST.windowed_counts(S.raw(s, d, "events"), ["event_type"], "1 hour")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@register("ext_sliding_counts", "SELECT w AS start, count(*) AS n FROM (SELECT unnest([date_trunc('hour', ts), date_trunc('hour', ts) - INTERVAL 1 HOUR]) AS w FROM events) GROUP BY 1")
def sliding(s, d):
    out = ST.windowed_counts(S.raw(s, d, "events"), [], "2 hours", "1 hour")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "n")


@register(
    "ext_session_counts",
    """WITH a AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 3600 SECOND THEN 1 ELSE 0 END AS f FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    b AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM a) SELECT user_id, min(ts) AS start, count(*) AS n FROM b GROUP BY user_id, k""",
)
def sessions(s, d):
    out = ST.session_counts(S.raw(s, d, "events"), ["user_id"], "3600 seconds")
    return out.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")
