"""Vector arithmetic on array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _total(x: Column, kind: str) -> Column:
    return F.aggregate(x, F.lit(0).cast(kind), lambda a, e: a + e)


def dot(a: Column, b: Column, kind: str = "double") -> Column:
    return _total(F.zip_with(a, b, lambda x, y: (x * y).cast(kind)), kind)


def cosine(a: Column, b: Column) -> Column:
    """0 where either squared norm is 1e-12 or less."""
    na, nb = dot(a, a), dot(b, b)
    return F.when((na <= 1e-12) | (nb <= 1e-12), F.lit(0.0)).otherwise(dot(a, b) / F.sqrt(na * nb))


def normalise(a: Column, least: float = 1e-9) -> Column:
    norm = F.sqrt(dot(a, a))
    return F.when(norm > least, F.transform(a, lambda x: x / norm)).otherwise(a)


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)
