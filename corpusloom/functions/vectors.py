"""Vectors as Column expressions, and the embedder that stands in where no model is at hand."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

DIMENSION = 64


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 for a zero vector."""
    n = norm(a) * norm(b)
    return F.when(n > 0, 1 - dot(a, b) / n).otherwise(F.lit(1.0))


def normalized(a: Column) -> Column:
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: x.cast("double") / n)).otherwise(F.transform(a, lambda x: x.cast("double")))


def _bucket(word: str) -> int:
    return int(hashlib.md5(word.encode()).hexdigest()[:7], 16) % DIMENSION


def hashing_model():
    """A model that needs no file: list of texts -> list of vectors, as hashed_embedding gives them."""
    return _hashed


_LONG = re.compile("[a-z]{4,}")


class _Places(dict):
    """Buckets of words, each worked out once."""

    def __missing__(self, word: str) -> int:
        place = self[word] = _bucket(word)
        return place


def _hashed(texts) -> list[np.ndarray]:
    place = _Places().__getitem__
    out = []
    for text in texts:
        own = np.array(list(map(place, _LONG.findall((text or "").lower()))), np.intp)
        counts = np.bincount(own, minlength=DIMENSION).astype(float)
        n = np.sqrt(counts @ counts)
        out.append(counts / n if n else counts)
    return out


@F.pandas_udf(ArrayType(DoubleType()))
def hashed_embedding(texts: pd.Series) -> pd.Series:
    """Counts of words of four letters or more by the hash of the word, of length 1. A model takes its place behind
    a function of the same signature. One pass over each text, where an expression would take one for each bucket."""
    return pd.Series(_hashed(texts))
