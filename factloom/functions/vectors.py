"""Vector expressions (M1 to M3)."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrow import vectorized


def constant(values: list[float]) -> Column:
    """A vector as one literal: an array of literals would be a tree that every rule walks."""
    return F.expr(f"cast(split('{','.join(repr(float(x)) for x in values)}', ',') as array<double>)")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Null for different lengths and zero vectors."""
    return F.when(F.size(a) == F.size(b), F.try_divide(dot(a, b), norm(a) * norm(b)))


def unit_similarity(cos: Column) -> Column:
    """M1: (cos + 1) / 2, between 0 and 1. Of a cosine distance d this is 1 - d / 2 (M2, full mode)."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (cos + 1) / 2))


def lite_similarity(cos: Column) -> Column:
    """M2, lite mode: 1 - d is the cosine itself."""
    return cos


@vectorized("array<float>")
def _fixture_1536(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: fixture_vector(t, 1536))


def fixture_vector(text: str | None, dimension: int) -> list[float] | None:
    """M3: a reproducible unit vector from SHA-256 bytes of the text, rounded to 8 places."""
    if text is None:
        return None
    raw, counter = b"", 0
    while len(raw) < dimension:
        raw += hashlib.sha256(f"{text}:{counter}".encode()).digest()
        counter += 1
    x = np.frombuffer(raw[:dimension], np.uint8) / 127.5 - 1
    return np.round(x / (np.linalg.norm(x) or 1), 8).tolist()


def fixture_embedding(text: Column) -> Column:
    return _fixture_1536(text)
