"""Noise columns. Draws follow seed, partition and row order: write a noised table once before it is used twice."""

from __future__ import annotations

import math
import zlib

from pyspark.sql import Column
from pyspark.sql import functions as F


def _uniform(seed: int | None, stream: int) -> Column:
    return F.rand() if seed is None else F.rand(seed * 7919 + stream)


def stream(seed: int | None, name: str) -> int | None:
    """A seed of its own for each column name, so that columns of one run do not share their draws."""
    return None if seed is None else seed ^ zlib.crc32(name.encode())


def laplace(scale: Column | float, seed: int | None = None) -> Column:
    """Laplace(0, scale) as the difference of two exponentials."""
    b = scale if isinstance(scale, Column) else F.lit(float(scale))
    e1 = -F.log(F.lit(1.0) - _uniform(seed, 1))
    e2 = -F.log(F.lit(1.0) - _uniform(seed, 2))
    return b * (e1 - e2)


def gaussian(sigma: Column | float, seed: int | None = None) -> Column:
    s = sigma if isinstance(sigma, Column) else F.lit(float(sigma))
    return s * (F.randn() if seed is None else F.randn(seed))


def gumbel(seed: int | None = None) -> Column:
    """Standard Gumbel; the largest of score + Gumbel draws proportionally to exp(score)."""
    return -F.log(-F.log(F.greatest(_uniform(seed, 3), F.lit(1e-300))))


def gaussian_sigma(sensitivity: float, epsilon: float, delta: float) -> float:
    """Noise level of the classic Gaussian mechanism."""
    return sensitivity * math.sqrt(2.0 * math.log(1.25 / delta)) / epsilon
