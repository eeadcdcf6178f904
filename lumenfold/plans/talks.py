"""Conversations and their messages, kept in a store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lumenfold.sources import conversations as chats
from lumenfold.sources.snapshots import Snapshots

TITLE = 60


class Talks:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.heads = Snapshots(spark, f"{folder}/conversations", chats.CONVERSATIONS, "id")
        self.messages = Snapshots(spark, f"{folder}/messages", chats.MESSAGES, "conversation_id")

    def listed(self) -> DataFrame:
        return chats.listed(self.heads.read())

    def history(self, conversation_id: str) -> list[dict[str, str]]:
        """The messages of one conversation in their order, as a chat model takes them."""
        own = self.messages.of(self.spark.createDataFrame([(conversation_id,)], "conversation_id string"))
        return [{"role": r.role, "content": r.content} for r in chats.messages_of(own, conversation_id).collect()]

    def save(self, conversation_id: str, messages: list[dict[str, str]], now: str, title: str | None = None, date_from: str | None = None, date_to: str | None = None, k: int = 8) -> None:
        """Put a conversation with all its messages. A known one keeps its time of creation, and its title unless one is given; a new one is called by its first message."""
        keys = self.spark.createDataFrame([(conversation_id,)], "id string")
        known = self.heads.of(keys).first()
        title = title or (known.title if known else next((m["content"] for m in messages if m["role"] == "user"), "")[:TITLE])
        head = self.spark.createDataFrame([(conversation_id, title, date_from, date_to, k, now, now)], chats.CONVERSATIONS)
        said = self.spark.createDataFrame([(conversation_id, i, m["role"], m["content"], None, now) for i, m in enumerate(messages)], chats.MESSAGES)
        none = self.messages.read().where("false")
        self.messages.replace(said, keys.toDF("conversation_id"))
        self.heads.update(lambda heads: (chats.saved(heads.where(heads.id == conversation_id), none, head, none)[0], keys))

    def rename(self, conversation_id: str, title: str, now: str) -> None:
        keys = self.spark.createDataFrame([(conversation_id,)], "id string")
        self.heads.update(lambda heads: (chats.renamed(heads.where(heads.id == conversation_id), conversation_id, title, now), keys))

    def delete(self, conversation_id: str) -> None:
        """The conversation goes, with its messages."""
        keys = self.spark.createDataFrame([(conversation_id,)], "id string")
        self.heads.replace(None, keys)
        self.messages.replace(None, keys.toDF("conversation_id"))
