"""Interfaces of external models, and plain stand-ins for tests."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, StringType, StructField, StructType


class Embedder(Protocol):
    dim: int

    def embed(self, texts: list[str]) -> np.ndarray: ...


class Generator(Protocol):
    def answer(self, prompt: str) -> str: ...


class HashedWords:
    """A stand-in embedder: words hashed to places, length 1."""

    def __init__(self, dim: int = 64):
        self.dim = dim

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim), dtype=np.float32)
        for i, t in enumerate(texts):
            for w in t.lower().split():
                h = zlib.crc32(w.encode())
                out[i, h % self.dim] += 1 if h & 65536 else -1
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


class EchoGenerator:
    """A stand-in generator: the last line of the prompt."""

    def answer(self, prompt: str) -> str:
        return prompt.rstrip().split("\n")[-1]


def embed(rows: DataFrame, model: Embedder, batch: int = 64) -> DataFrame:
    """Rows with `vector` and `error`; a batch that fails keeps its rows with the error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            for a in range(0, len(frame), batch):
                part = frame.iloc[a : a + batch].copy()
                try:
                    part["vector"], part["error"] = list(model.embed([t or "" for t in part["text"]])), None
                except Exception as e:  # noqa: BLE001
                    part["vector"], part["error"] = None, str(e)
                yield part

    schema = StructType([*rows.schema.fields, StructField("vector", ArrayType(FloatType())), StructField("error", StringType())])
    return rows.mapInPandas(run, schema)


def with_cache(rows: DataFrame, cache: DataFrame, model: Embedder) -> tuple[DataFrame, DataFrame]:
    """(rows with vectors, new cache entries): texts whose key is in the cache are not embedded again."""
    keyed = rows.withColumn("cache_key", F.sha2("text", 256))
    known = cache.groupBy("cache_key").agg(F.min_by("vector", "vec_id").alias("vector"))
    hits = keyed.join(known, "cache_key")
    misses = embed(keyed.join(known.select("cache_key"), "cache_key", "left_anti").dropDuplicates(["cache_key"]), model)
    fresh = misses.select("cache_key", "vector")
    late = keyed.join(fresh, "cache_key")
    return hits.unionByName(late), fresh


def pages_of(provider) -> callable:
    """A provider chain: the first that gives text of enough quality."""

    def run(data: bytes, extension: str) -> list[str]:
        for p in provider:
            pages = p(data, extension)
            text = "".join(pages)
            if text and sum(c.isprintable() or c.isspace() for c in text) / len(text) >= 0.6:
                return pages
        raise ValueError("no provider gave text")

    return run
