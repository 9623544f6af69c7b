"""Arithmetic on array<float|double> columns with higher-order functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_double(col: Column | str) -> Column:
    return (F.col(col) if isinstance(col, str) else col).cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(as_double(a), as_double(b), lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(as_double(a), F.lit(0.0), lambda s, v: s + v * v))


def scale(a: Column, factor: Column) -> Column:
    return F.transform(as_double(a), lambda v: v * factor)


def clip_l2(a: Column, bound: float) -> Column:
    """Rescale to the bound only if the norm exceeds it."""
    n = norm(a)
    return F.when(n > bound, scale(a, F.lit(float(bound)) / n)).otherwise(as_double(a))


def clip_l2_smooth(a: Column, bound: float) -> Column:
    """Per-row batch form: factor min(1, C / (norm + 1e-8))."""
    return scale(a, F.least(F.lit(1.0), F.lit(float(bound)) / (norm(a) + F.lit(1e-8))))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 when either vector is zero."""
    d = norm(a) * norm(b)
    return F.when(d > 0, dot(a, b) / d).otherwise(F.lit(0.0))
