"""Vector columns: unit length, truncation, similarity, the stand-in embedding."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from passagework.functions.text import col, let


def dot(a: Column | str, b: Column | str) -> Column:
    pairs = F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda acc, x: acc + x)


def norm(v: Column | str) -> Column:
    return F.sqrt(dot(v, v))


def l2_normalize(v: Column | str) -> Column:
    """Unit vector; the zero vector is left alone."""
    return let(norm(v), lambda n: F.transform(
        col(v), lambda x: x.cast("double") / F.when(n > 0, n).otherwise(F.lit(1.0))))


def truncate_vector(v: Column | str, width: int) -> Column:
    """First `width` components, brought back to unit length."""
    return l2_normalize(F.slice(col(v), 1, width))


def cosine(a: Column | str, b: Column | str) -> Column:
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n).otherwise(F.lit(0.0))


@lru_cache(maxsize=200_000)
def _buckets(word: str) -> tuple[tuple[int, float], ...]:
    digest = hashlib.sha256(word.encode()).digest()
    return tuple(
        (int.from_bytes(digest[i : i + 4], "big"), -1.0 if digest[i + 4] % 2 else 1.0) for i in (0, 8)
    )


def hashed_embedding(width: int = 768):
    """Deterministic stand-in embedding: each word adds two signed buckets."""

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            out = []
            for text in batch:
                v = np.zeros(width)
                for word in re.findall("[a-z0-9]+", (text or "").lower()):
                    for bucket, sign in _buckets(word):
                        v[bucket % width] += sign
                size = np.sqrt(v @ v)
                v[0] = v[0] if size else 1.0
                out.append(v / (size or 1.0))
            yield pd.Series(out)

    return embed
