"""Vectors in and out of their stored form, and embedding of texts in batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T


@F.pandas_udf(T.ArrayType(T.FloatType()))
def decode(blob: pd.Series) -> pd.Series:
    """Little-endian 32-bit floats without a header; null for null or a broken length."""
    return blob.map(lambda b: None if b is None or len(b) % 4 else np.frombuffer(b, "<f4").tolist())


@F.pandas_udf(T.BinaryType())
def encode(vector: pd.Series) -> pd.Series:
    return vector.map(lambda v: None if v is None else np.asarray(v, "<f4").tobytes())


def hash_embedder(dimensions: int = 64) -> Callable[[list[str]], list[list[float]]]:
    """A stand-in service: signed counts of hashed words, the same for the same text."""
    def embed(texts: list[str]) -> list[list[float]]:
        import zlib

        out = np.zeros((len(texts), dimensions), np.float32)
        for i, t in enumerate(texts):
            for w in t.lower().split():
                h = zlib.crc32(w.encode())
                out[i, h % dimensions] += 1.0 if h & 1 << 20 else -1.0
        return out.tolist()

    return embed


def totals(embedded: DataFrame) -> DataFrame:
    """One row: texts considered, embedded and failed in a pass."""
    n = lambda s: F.count_if(F.col("status") == s).alias(s)
    return embedded.agg(F.count(F.lit(1)).alias("considered"), n("embedded"), n("failed"))


def embed_texts(rows: DataFrame, embed: Callable[[list[str]], list[list[float]]], key: str = "id", text: str = "text", batch: int = 32) -> DataFrame:
    """key, embedding, status: texts go to the service in batches; a batch that fails is marked, the pass goes on."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for at in range(0, len(f), batch):
                part = f.iloc[at:at + batch]
                try:
                    vs = embed(part[text].tolist())
                    if len(vs) != len(part):
                        raise ValueError("as many vectors as texts are wanted")
                    yield pd.DataFrame({key: part[key], "embedding": vs, "status": "embedded"})
                except Exception:
                    yield pd.DataFrame({key: part[key], "embedding": [None] * len(part), "status": "failed"})

    return rows.select(key, text).mapInPandas(run, f"`{key}` string, embedding array<float>, status string")
