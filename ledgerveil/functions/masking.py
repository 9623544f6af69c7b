"""Masking, truncation, redaction and format-preserving tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

REDACTED = "[REDACTED]"
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _text(col: Column | str) -> Column:
    return (F.col(col) if isinstance(col, str) else col).cast("string")


def mask_middle(col: Column | str) -> Column:
    """Keep two characters at each end; four or fewer are starred out entirely."""
    t = _text(col)
    n = F.length(t)
    return F.when(n <= 4, F.repeat(F.lit("*"), n)).otherwise(
        F.concat(F.substring(t, 1, 2), F.repeat(F.lit("*"), n - 4), F.right(t, F.lit(2)))
    )


def mask_for_log(col: Column | str, shown: int = 3) -> Column:
    """Keep the first characters only."""
    t = _text(col)
    n = F.length(t)
    return F.when(n <= shown, F.repeat(F.lit("*"), n)).otherwise(
        F.concat(F.substring(t, 1, shown), F.repeat(F.lit("*"), n - shown))
    )


def truncate_half(col: Column | str) -> Column:
    """First half of the text plus an ellipsis when longer than four characters."""
    t = _text(col)
    n = F.length(t)
    return F.when(n > 4, F.concat(t.substr(F.lit(1), F.floor(n / 2).cast("int")), F.lit("..."))).otherwise(t)


def redact() -> Column:
    return F.lit(REDACTED)


def suppress(data_type: T.DataType) -> Column:
    return F.lit(None).cast(data_type)


def tokenize(col: Column | str, key: str) -> Column:
    """Digits become digits, letters become A-Z, the rest is kept.

    The replacement depends on key, whole value and position, so equal values get
    equal tokens on every executor and on recomputation.
    """
    t = _text(col)
    chars = F.filter(F.split(t, ""), lambda c: c != "")

    def swap(c: Column, i: Column) -> Column:
        h = F.xxhash64(F.lit(key), t, i)
        return (
            F.when(c.rlike("^[0-9]$"), F.pmod(h, F.lit(10)).cast("string"))
            .when(
                c.rlike(r"^\p{L}$"),
                F.lit(LETTERS).substr((F.pmod(h, F.lit(26)) + 1).cast("int"), F.lit(1)),
            )
            .otherwise(c)
        )

    return F.array_join(F.transform(chars, swap), "")
