"""Embedders: any function from texts to vectors, applied in Arrow batches; one that asks an HTTP service."""

from __future__ import annotations

import json
import urllib.request
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Embedder(Protocol):
    dimensions: int

    def __call__(self, texts: list[str]) -> list[list[float]]: ...


def embed(rows: DataFrame, embedder: Callable[[list[str]], list[list[float]]], id: str = "id", text: str = "text", batch: int = 64) -> DataFrame:
    """(id, embedding): batches of texts, so that a service is asked once for many."""
    kind = dict(rows.dtypes)[id]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for a in range(0, len(f), batch):
                part = f.iloc[a : a + batch]
                yield pd.DataFrame({"id": part["id"], "embedding": list(embedder([t or "" for t in part["text"]]))})

    return rows.select(F.col(id).alias("id"), F.col(text).alias("text")).mapInPandas(run, f"id {kind}, embedding array<float>")


#: What a vector is kept under: the text's hash and the model that made it.
VECTORS = "hash string, model string, embedding array<float>"


def choose(candidates: list[tuple[str, Embedder]]) -> tuple[str, Embedder] | None:
    """The first (model, embedder) that answers, with vectors as long as it says; None if none does, and texts go without vectors."""
    for model, e in candidates:
        try:
            if e.dimensions > 0 and len(e(["probe"])[0]) == e.dimensions:
                return model, e
        except (OSError, ValueError, KeyError, IndexError):
            continue
    return None


def text_hash(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def missing(rows: DataFrame, store: DataFrame, model: str, text: str = "text") -> DataFrame:
    """(hash, text): each text once that the store has no vector of the model for."""
    texts = rows.select(text_hash(F.col(text)).alias("hash"), F.coalesce(F.col(text), F.lit("")).alias("text")).dropDuplicates(["hash"])
    return texts.join(store.where(F.col("model") == model).select("hash"), "hash", "left_anti")


def add_vectors(rows: DataFrame, store: DataFrame, chosen: tuple[str, Embedder] | None, text: str = "text") -> DataFrame:
    """New rows for the store (hash, model, embedding): an embedder is asked for texts that the store lacks, each once. Vectors of another length than the embedder's are left out."""
    if chosen is None:
        return store.limit(0)
    model, embedder = chosen
    made = embed(missing(rows, store, model, text), embedder, "hash", "text")
    return made.where(F.size("embedding") == embedder.dimensions).select(F.col("id").alias("hash"), F.lit(model).alias("model"), "embedding")


def with_vectors(rows: DataFrame, store: DataFrame, model: str, text: str = "text") -> DataFrame:
    """Rows with the stored vector of their text, null where there is none."""
    v = store.where(F.col("model") == model).groupBy("hash").agg(F.first("embedding").alias("embedding"))
    return rows.drop("embedding").withColumn("_hash", text_hash(F.col(text))).join(v.withColumnRenamed("hash", "_hash"), "_hash", "left").drop("_hash")


def fill(memories: DataFrame, vectors: DataFrame) -> DataFrame:
    """Memories with the vectors (id, embedding) they lacked."""
    m = memories.join(vectors.withColumnRenamed("embedding", "_new"), "id", "left")
    return m.withColumn("embedding", F.coalesce("embedding", "_new")).drop("_new")


class HttpEmbedder:
    """A service that speaks one of two public formats, told apart by its address."""

    def __init__(self, url: str, model: str, key: str | None = None, timeout: float = 30):
        self.url, self.model, self.key, self.timeout, self._dims = url, model, key, timeout, None

    @property
    def dimensions(self) -> int:
        if self._dims is None:
            self._dims = len(self(["probe"])[0])
        return self._dims

    def request(self, texts: list[str]) -> dict:
        return {"model": self.model, "input": texts}

    def answer(self, reply: dict) -> list[list[float]]:
        if "embeddings" in reply:
            return reply["embeddings"]
        return [x["embedding"] for x in sorted(reply["data"], key=lambda x: x.get("index", 0))]

    def __call__(self, texts: list[str]) -> list[list[float]]:
        head = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {self.key}"} if self.key else {})
        r = urllib.request.Request(self.url, json.dumps(self.request(texts)).encode(), head)
        with urllib.request.urlopen(r, timeout=self.timeout) as f:
            return self.answer(json.load(f))
