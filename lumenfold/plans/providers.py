"""Models behind small interfaces; the ones here need no network and always answer alike."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame


class Embedder(Protocol):
    dim: int

    def embed(self, texts: Sequence[str]) -> list[list[float]]: ...


class ChatProvider(Protocol):
    def chat(self, messages: list[dict[str, str]], temperature: float = 0.2) -> str: ...


class HashEmbedder:
    """Vectors from the words' digests: equal texts are equal, texts with common words are near."""

    def __init__(self, dim: int = 64):
        self.dim = dim

    def embed(self, texts: Sequence[str]) -> list[list[float]]:
        out = []
        for text in texts:
            vector = [0.0] * self.dim
            for word in text.lower().split():
                d = hashlib.blake2b(word.encode(), digest_size=8).digest()
                vector[int.from_bytes(d[:4], "big") % self.dim] += 1.0 if d[4] & 1 else -1.0
            size = sum(x * x for x in vector) ** 0.5 or 1.0
            out.append([x / size for x in vector])
        return out


class EchoChat:
    """Answers with the last message."""

    def chat(self, messages: list[dict[str, str]], temperature: float = 0.2) -> str:
        return messages[-1]["content"]


def with_vectors(df: DataFrame, embedder: Embedder, batch: int = 64) -> DataFrame:
    """``vector`` of every ``text``, in batches, on the executors."""

    def run(frames):
        for frame in frames:
            texts, vectors = frame["text"].fillna("").tolist(), []
            for i in range(0, len(texts), batch):
                vectors += embedder.embed(texts[i : i + batch])
            yield frame.assign(vector=vectors)

    return df.mapInPandas(run, df.drop("vector").schema.add("vector", "array<float>") if "vector" not in df.columns else df.schema)


def answers(entries: DataFrame, chat: ChatProvider, prompt: str, most: int = 6000) -> DataFrame:
    """(entry_id, answer) of a chat model for each entry's text, cut at ``most`` characters as the model's input is."""

    def run(frames):
        for frame in frames:
            said = [chat.chat([{"role": "user", "content": f"{prompt}\n\n{t[:most]}"}]) for t in frame["text"].fillna("")]
            yield pd.DataFrame({"entry_id": frame["entry_id"], "answer": said})

    return entries.select("entry_id", "text").mapInPandas(run, "entry_id string, answer string")
