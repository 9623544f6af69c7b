"""Checked bounds for whatever is sent to every executor or to the driver."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

BROADCAST_ROWS = 200_000
SPREAD_BYTES = 4 << 30
#: Estimated bytes a partition of a redistributed input holds at most.
PART_BYTES = 64 << 20


class SizeExceeded(ValueError):
    """A side that had to stay small did not."""


def bounded_rows(df: DataFrame, max_rows: int, what: str) -> list[Row]:
    """Rows on the driver, only if there are at most ``max_rows`` of them."""
    rows = df.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        raise SizeExceeded(f"{what}: more than {max_rows} rows")
    return rows


def join_small(
    big: DataFrame, small: DataFrame, on: list[str], how: str = "inner", max_rows: int = BROADCAST_ROWS
) -> DataFrame:
    """Broadcast ``small`` after counting it; a larger one is left to a shuffled join (AQE splits skew)."""
    n = small.limit(max_rows + 1).count()
    return big.join(F.broadcast(small) if n <= max_rows else small, on, how)


def lowest_hashed(df: DataFrame, cols: Sequence[str], size: int, n: int) -> DataFrame:
    """The ``size`` rows of smallest hash of ``cols``, of ``n`` rows.

    Hashes are uniform, so the rows below twice the wanted share of all hashes are enough to order; where a few values
    make up most rows and these are too few, all rows are ordered.
    """
    hashed = F.xxhash64(*cols)
    if n > 4 * size:
        low = df.where(hashed < -(1 << 63) + (1 << 64) * 2 * size // n)
        df = low if low.limit(size).count() == size else df
    return df.orderBy(hashed, *cols).limit(size)


def spread(df: DataFrame, limit: int = SPREAD_BYTES) -> DataFrame:
    """Redistribute a small input over all cores before CPU-heavy row work.

    A small table often sits in one file and row group, hence in one task. Only inputs
    whose estimated size is within ``limit`` are shuffled; a large one already has
    enough splits and is returned as it is.
    """
    if df.isStreaming:
        return df
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    parts = max(df.sparkSession.sparkContext.defaultParallelism, -(-size // PART_BYTES))
    return df.repartition(parts) if size <= limit else df
