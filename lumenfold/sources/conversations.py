"""Conversations and their messages, and a cache of digests, as small tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.operators.corpus import delete, merged

CONVERSATIONS = "id string, title string, date_from string, date_to string, k int, created_at string, updated_at string"
MESSAGES = "conversation_id string, seq int, role string, content string, excerpts_json string, created_at string"
DIGESTS = "cache_key string, date_from string, date_to string, model string, text string, created_at string"


def listed(conversations: DataFrame) -> DataFrame:
    return conversations.orderBy(F.desc("updated_at"), "id")


def messages_of(messages: DataFrame, conversation_id: str) -> DataFrame:
    return messages.where(F.col("conversation_id") == conversation_id).orderBy("seq")


def saved(conversations: DataFrame, messages: DataFrame, new: DataFrame, new_messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations replaced or added, a known one keeping its creation time, and all their messages replaced."""
    old = conversations.select("id", F.col("created_at").alias("old_created"))
    new = new.join(old, "id", "left").withColumn("created_at", F.coalesce("old_created", "created_at")).select(*conversations.columns)
    kept = messages.join(new.select(F.col("id").alias("conversation_id")), "conversation_id", "left_anti")
    return merged(conversations, new, "id"), kept.unionByName(new_messages)


def deleted(conversations: DataFrame, messages: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Without conversations and their messages."""
    return delete(conversations, ids, "id"), delete(messages, ids.select(F.col("id").alias("conversation_id")), "conversation_id")


def renamed(conversations: DataFrame, conversation_id: str, title: str, now: str) -> DataFrame:
    own = F.col("id") == conversation_id
    return conversations.withColumns({"title": F.when(own, title).otherwise(F.col("title")), "updated_at": F.when(own, now).otherwise(F.col("updated_at"))})


def cached(digests: DataFrame, key: str) -> DataFrame:
    return digests.where(F.col("cache_key") == key)


def put(digests: DataFrame, new: DataFrame) -> DataFrame:
    return merged(digests, new, "cache_key")
