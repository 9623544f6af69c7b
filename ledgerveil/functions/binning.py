"""Generalisation of quasi-identifiers to coarser values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: bin edges and labels -------------------------------------
AGE_BREAKS = [18, 25, 35, 45, 55, 65]
AGE_LABELS = ["<18", "18-24", "25-34", "35-44", "45-54", "55-64", "65+"]
INCOME_BREAKS = [25000, 50000, 75000, 100000, 150000, 200000]
INCOME_LABELS = ["<25K", "25K-50K", "50K-75K", "75K-100K", "100K-150K", "150K-200K", "200K+"]
EMPLOYMENT_GROUPS = ["employed", "unemployed", "other"]
HOUSING_GROUPS = ["owned", "rented", "other"]
DOB_FORMATS = ["yyyy-MM-dd", "dd/MM/yyyy", "MM/dd/yyyy"]
# -----------------------------------------------------------------------------


def _col(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def cut(col: Column | str, breaks: Sequence[float], labels: Sequence[str]) -> Column:
    """Right-closed intervals: a value equal to a break belongs to the lower bin."""
    c = _col(col)
    out = F.when(c.isNull(), F.lit(None).cast("string"))
    for edge, label in zip(breaks, labels):
        out = out.when(c <= F.lit(edge), F.lit(label))
    return out.otherwise(F.lit(labels[-1]))


def age_band(col: Column | str) -> Column:
    return cut(col, AGE_BREAKS, AGE_LABELS)


def income_band(col: Column | str) -> Column:
    return cut(col, INCOME_BREAKS, INCOME_LABELS)


def zip_prefix(col: Column | str) -> Column:
    t = _col(col).cast("string")
    return F.when(F.length(t) >= 3, F.concat(F.substring(t, 1, 3), F.lit("XX"))).otherwise(t)


def birth_decade(col: Column | str, as_of_year: int) -> Column:
    """Decade of age from a date text in one of three formats; anything else is 'unknown'."""
    t = _col(col).cast("string")
    parsed = F.coalesce(*[F.try_to_timestamp(t, F.lit(f)) for f in DOB_FORMATS])
    decade = (F.floor((F.lit(as_of_year) - F.year(parsed)) / 10) * 10).cast("string")
    return F.when(t.isNull(), F.lit(None).cast("string")).otherwise(
        F.coalesce(F.concat(decade, F.lit("s")), F.lit("unknown"))
    )


def coarse_coordinates(col: Column | str) -> Column:
    """'lat,lon' to one decimal; malformed text becomes null."""
    parts = F.split(_col(col).cast("string"), ",")
    lat = F.bround(F.try_element_at(parts, F.lit(1)).try_cast("double"), 1)
    lon = F.bround(F.try_element_at(parts, F.lit(2)).try_cast("double"), 1)
    return F.when((F.size(parts) == 2) & lat.isNotNull() & lon.isNotNull(), F.concat_ws(",", lat, lon))


def quantile_label(col: Column | str, breaks: Sequence[float]) -> Column:
    """bin_0 .. bin_k from ascending quantile breaks (right-closed)."""
    return cut(col, breaks, [f"bin_{i}" for i in range(len(breaks) + 1)])


def to_group(col: Column | str, mapping: dict[str, str], other: str = "other") -> Column:
    """Small fixed category mapping as one CASE expression."""
    c = F.lower(_col(col))
    out = F.when(c.isNull(), F.lit(None).cast("string"))
    for source, target in mapping.items():
        out = out.when(c == F.lit(source.lower()), F.lit(target))
    return out.otherwise(F.lit(other))


def coarse_time(col: Column | str, unit: str) -> Column:
    """Timestamp to hour, day or week."""
    if unit not in ("hour", "day", "week"):
        raise ValueError(f"unit must be hour, day or week, not {unit}")
    return F.date_trunc(unit, _col(col))
