"""Reads over the chat tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def user_stats(users: DataFrame, conversations: DataFrame, messages: DataFrame, all_roles: bool = False) -> DataFrame:
    """Per user: active conversations, questions, mean confidence and latency, last activity.

    Messages are reduced to their conversation before the joins, so that the wide outer joins
    run over one row a conversation.
    """
    said = messages if all_roles else messages.where("role = 'assistant'")
    per = said.groupBy("conv_id").agg(
        F.count_if(F.col("role") == "user").alias("q"), F.sum("confidence").alias("sc"), F.count("confidence").alias("nc"), F.sum("latency_ms").alias("sl"), F.count("latency_ms").alias("nl"), F.max("turn").alias("last")
    )
    convs = conversations.where("status = 'active'").select("conv_id", "user_id").join(per, "conv_id", "left")
    of = convs.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in ("q", "sc", "nc", "sl", "nl")], F.max("last").alias("last"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    return users.join(of, "user_id", "left").select(
        "user_id", "email", zero("n").alias("total_conversations"), zero("q").alias("total_questions"), F.round(F.col("sc") / F.nullif("nc", F.lit(0)), 6).alias("avg_confidence"),
        F.round(F.col("sl") / F.nullif("nl", F.lit(0)), 4).alias("avg_latency_ms"), F.col("last").alias("last_activity"),
    )


def list_conversations(conversations: DataFrame, messages: DataFrame, user_id: int, limit: int, offset: int = 0) -> DataFrame:
    """A user's active conversations, the latest first, with message counts: the page is cut before the join."""
    own = conversations.where((F.col("user_id") == user_id) & (F.col("status") == "active")).orderBy(F.col("updated_at").desc(), "conv_id").offset(offset).limit(limit)
    n = messages.join(F.broadcast(own.select("conv_id")), "conv_id", "left_semi").groupBy("conv_id").agg(F.count("turn").alias("n"), F.max("turn").alias("last_turn"))
    return own.select("conv_id", "updated_at").join(n, "conv_id", "left").fillna(0, ["n"])
