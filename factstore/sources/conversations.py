"""Conversations stored as memories."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

TURNS_PER_MEMORY = 10_000


def conversations_to_memories(df: DataFrame, turns_per_memory: int = TURNS_PER_MEMORY) -> DataFrame:
    """Messages ``(conv_id, turn, role, text)`` as JSON lists.

    The message of turn t belongs to part ``floor(t / turns_per_memory)`` of its
    conversation, whatever other messages there are; a message without a turn belongs
    to part 0. So no group outgrows a task, and nothing has to be counted first.
    """
    part = F.coalesce(F.floor(F.col("turn") / turns_per_memory), F.lit(0)).cast("bigint")
    messages = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    as_json = F.to_json(F.transform(messages, lambda m: F.struct(
        m["role"].alias("role"), F.coalesce(m["text"], F.lit("")).alias("content"))))
    return (df.withColumn("part", part).groupBy("conv_id", "part")
            .agg(as_json.alias("memory"), F.count(F.lit(1)).alias("messages")))
