"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame

from paperloom.session import tokenizer_dir

# Fixed value: the pattern that splits text before the merges of the rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
RANKS = "byte_bpe_multi_50k.tiktoken"


@lru_cache(maxsize=2)
def encoding(path: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def with_token_counts(documents: DataFrame, keys: dict[str, Column], folder: str | None = None) -> DataFrame:
    """The key columns and n_tokens of each row; a null or empty text has 0 tokens."""
    path = f"{folder or tokenizer_dir()}/{RANKS}"
    chosen = documents.select(*[c.alias(n) for n, c in keys.items()], documents["text"])
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in chosen.schema if f.name != "text") + ", n_tokens bigint"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoding(path)
        for batch in batches:
            out = batch.drop(columns="text")
            out["n_tokens"] = [len(enc.encode_ordinary(t)) if t else 0 for t in batch["text"]]
            yield out

    return chosen.mapInPandas(run, schema)
