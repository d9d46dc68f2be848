"""Turning texts into vectors."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of a text that are embedded.
CHARACTERS = 1800


class Embedder(Protocol):
    """``prefixed`` models are given the task before the text; texts come with it and cut to CHARACTERS."""

    dims: int
    prefixed: bool

    def embed(self, texts: list[str], query: bool) -> np.ndarray: ...


def with_prefix(text: str, query: bool, prefixed: bool) -> str:
    """The text as a model with task prefixes wants it."""
    return (("search_query: " if query else "search_document: ") if prefixed else "") + text[:CHARACTERS]


class HashingEmbedder:
    """A stand-in without a model: words hashed to signed places, scaled to length 1; equal texts have equal vectors."""

    prefixed = False

    def __init__(self, dims: int = 64):
        self.dims = dims

    def embed(self, texts: list[str], query: bool = False) -> np.ndarray:
        out = np.zeros((len(texts), self.dims), dtype=np.float32)
        for row, text in zip(out, texts, strict=True):
            for word in re.findall(r"\w+", text.lower()):
                h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
                row[h % self.dims] += 1 if h >> 63 else -1
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-8)


def embed(rows: DataFrame, text: str, embedder: Embedder, name: str = "vector") -> DataFrame:
    """Add the vector of a text column, batch by batch; a null text is embedded as the empty one."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(list(embedder.embed([with_prefix(t, False, embedder.prefixed) for t in texts.fillna("")], False).astype(np.float32)))

    return rows.withColumn(name, run(F.col(text)))


def query_vector(embedder: Embedder, query: str) -> list[float]:
    return [float(x) for x in embedder.embed([with_prefix(query, True, embedder.prefixed)], True)[0]]


