"""Similarity and distance between array columns, all inside the JVM.

Components are cast to double before they are multiplied.  A zero vector has no direction: its cosine is null, and
null pairs never pass a threshold.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

METRICS = ("cosine", "euclidean", "dot_product")


def _sum(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(_sum(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def similarity(a: Column, b: Column, metric: str = "cosine") -> Column:
    """Larger is nearer; the Euclidean form is 1 / (1 + distance)."""
    _known(metric)
    return {"cosine": cosine, "euclidean": lambda x, y: 1 / (1 + l2(x, y)), "dot_product": dot}[metric](a, b)


def distance(a: Column, b: Column, metric: str = "cosine") -> Column:
    """Smaller is nearer; a dot product is negated."""
    _known(metric)
    return {"cosine": lambda x, y: 1 - cosine(x, y), "euclidean": l2, "dot_product": lambda x, y: -dot(x, y)}[metric](a, b)


def _known(metric: str) -> None:
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}; known: {', '.join(METRICS)}")


def hashed(text: Column, dims: int = 16) -> Column:
    """A deterministic stand-in for an embedding model: hash-derived components in [-1, 1)."""
    return F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.pmod(F.xxhash64(text, i), F.lit(20_001)).cast("double") / 10_000 - 1)
