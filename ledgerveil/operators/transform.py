"""Transformation plan and its application as one projection."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerveil.functions import binning, hashing, masking, noise, pii
from ledgerveil.operators.profile import treatment_of
from ledgerveil.plans.ranking import exact_quantiles, hash_rank
from ledgerveil.plans.sizing import join_small

_AGE_WORD = re.compile(r"(^|[^a-z])age($|[^a-z])", re.IGNORECASE)
_DECILES = [i / 10 for i in range(1, 10)]


def plan_table(matches: DataFrame) -> DataFrame:
    """(column_name, pii_type, transformation) for every detected column."""
    return matches.select("column_name", "pii_type", treatment_of(F.col("pii_type")).alias("transformation"))


def plan_of(matches: DataFrame) -> dict[str, tuple[str, str]]:
    """column -> (pii_type, transformation); one entry per flagged column."""
    return {r[0]: (r[1], r[2]) for r in plan_table(matches).collect()}  # schema-sized


def is_numeric(dt: T.DataType) -> bool:
    return isinstance(dt, T.NumericType)


def generalized(df: DataFrame, column: str, pii_type: str, as_of_year: int, deciles: list[float] | None) -> Column:
    """The generalisation that fits the column's type and name; raises if none does."""
    dt = df.schema[column].dataType
    if pii_type == "age" or (_AGE_WORD.search(column) and is_numeric(dt)):
        return _numeric_only(dt, binning.age_band(column), column)
    if pii_type == "income" or "income" in column.lower():
        return _numeric_only(dt, binning.income_band(column), column)
    if pii_type == "zip_code":
        return binning.zip_prefix(column)
    if pii_type == "date_of_birth":
        if isinstance(dt, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            return binning.birth_decade(F.date_format(column, "yyyy-MM-dd"), as_of_year)
        return binning.birth_decade(column, as_of_year)
    if pii_type == "gps_coordinates":
        return binning.coarse_coordinates(column)
    if is_numeric(dt):
        return binning.quantile_label(column, deciles or [])
    return masking.truncate_half(column)


def _numeric_only(dt: T.DataType, expr: Column, column: str) -> Column:
    if not is_numeric(dt):
        raise TypeError(f"{column}: numeric bins need a numeric column")
    return expr


def deciles(df: DataFrame, column: str) -> list[float]:
    """The nine inner deciles of a column, exact and interpolated; none without values."""
    cuts = exact_quantiles(df.select(F.col(column).cast("double").alias("v")), [], "v", {f"q{i}": p for i, p in enumerate(_DECILES)}).first()
    return [v for v in cuts or [] if v is not None]


def _takes_deciles(df: DataFrame, column: str, pii_type: str) -> bool:
    """Whether a generalised column is cut at its own deciles, rather than at fixed bands."""
    fixed = pii_type in ("age", "income", "zip_code", "date_of_birth", "gps_coordinates") or _AGE_WORD.search(column) or "income" in column.lower()
    return is_numeric(df.schema[column].dataType) and not fixed


def _column_facts(df: DataFrame, plan: Mapping[str, tuple[str, str]]) -> dict[str, object]:
    """Deciles and ranges the plan needs (a few numbers per column)."""
    aggs = []
    facts: dict[str, object] = {}
    for c, (pii_type, how) in plan.items():
        if how == "generalize" and _takes_deciles(df, c, pii_type):
            facts[f"q_{c}"] = deciles(df, c)
        if how == "noise" and is_numeric(df.schema[c].dataType):
            aggs += [F.min(c).cast("double").alias(f"lo_{c}"), F.max(c).cast("double").alias(f"hi_{c}")]
    return facts | (df.agg(*aggs).first().asDict() if aggs else {})


def apply_plan(
    df: DataFrame,
    plan: Mapping[str, tuple[str, str]],
    key: str,
    overrides: Mapping[str, str] | None = None,
    as_of_year: int = 2026,
    epsilon: float = 1.0,
    pseudonyms: Mapping[str, DataFrame] | None = None,
    seed: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Sanitised table and its transformation log.

    A column whose treatment cannot be applied is redacted and logged with
    ``success = false``: it never passes through unchanged.
    """
    overrides = dict(overrides or {})
    todo = {c: (t, overrides.get(c, how)) for c, (t, how) in plan.items() if c in df.columns}
    facts = _column_facts(df, todo)
    out = df
    log = []
    expressions: dict[str, Column] = {}
    for c, (pii_type, how) in todo.items():
        ok, message = True, None
        try:
            if how == "pseudonymize":
                mapping = (pseudonyms or {}).get(c) or pseudonym_map(df, c)
                out = attach_pseudonyms(out, mapping, c)
                expressions[c] = F.col(f"_pseudo_{c}")
            else:
                expressions[c] = _treat(df, c, pii_type, how, key, as_of_year, epsilon, facts, seed)
        except (TypeError, ValueError) as e:
            ok, message = False, str(e)
            expressions[c] = masking.redact()
        log.append((c, how, df.schema[c].dataType.simpleString(), ok, message))
    result = out.select(*[expressions[c].alias(c) if c in expressions else F.col(c) for c in df.columns])
    return result, transformation_log(df, log)


def _treat(df, c, pii_type, how, key, as_of_year, epsilon, facts, seed) -> Column:  # noqa: ANN001
    if how == "hash":
        return hashing.value_hash(c)
    if how == "hmac":
        return hashing.keyed_hash(c, key)
    if how == "mask":
        return masking.mask_middle(c)
    if how == "generalize":
        return generalized(df, c, pii_type, as_of_year, facts.get(f"q_{c}"))
    if how == "redact":
        return masking.redact()
    if how == "suppress":
        return masking.suppress(df.schema[c].dataType)
    if how == "tokenize":
        return masking.tokenize(c, key)
    if how == "noise":
        if not is_numeric(df.schema[c].dataType):
            return hashing.value_hash(c)
        lo, hi = facts.get(f"lo_{c}"), facts.get(f"hi_{c}")
        if lo is None:
            return F.col(c)
        return F.col(c) + noise.laplace((hi - lo) / 100.0 / epsilon, noise.stream(seed, c))
    raise ValueError(f"unknown treatment {how}")


def transformation_log(df: DataFrame, entries: list[tuple]) -> DataFrame:
    """One row per treated column with its non-null and null counts (one aggregate)."""
    schema = (
        "column_name string, transformation_type string, original_dtype string, "
        "rows_transformed bigint, null_count bigint, success boolean, error_message string"
    )
    if not entries:
        return df.sparkSession.createDataFrame([], schema)
    counts = df.agg(
        F.count(F.lit(1)).alias("_n"), *[F.count(F.col(e[0])).alias(f"c{i}") for i, e in enumerate(entries)]
    )
    cells = [
        F.struct(
            F.lit(c).alias("column_name"),
            F.lit(how).alias("transformation_type"),
            F.lit(dt).alias("original_dtype"),
            F.col(f"c{i}").alias("rows_transformed"),
            (F.col("_n") - F.col(f"c{i}")).alias("null_count"),
            F.lit(ok).alias("success"),
            F.lit(msg).cast("string").alias("error_message"),
        )
        for i, (c, how, dt, ok, msg) in enumerate(entries)
    ]
    return counts.select(F.explode(F.array(*cells)).alias("r")).select("r.*")


def roll_up(df: DataFrame, column: str, hierarchy: DataFrame, level: str) -> DataFrame:
    """Replace a value by its ancestor (city -> state -> country): ``hierarchy`` has the
    column itself and one column per level. Unknown values become null."""
    side = hierarchy.select(column, F.col(level).alias("_up"))
    return join_small(df, side, [column], "left").withColumn(column, F.col("_up")).drop("_up").select(*df.columns)


# --- pseudonyms ------------------------------------------------------------------


def pseudonym_map(
    df: DataFrame, column: str, existing: DataFrame | None = None, prefix: str = "PSEUDO", seed: int = 42
) -> DataFrame:
    """(value, pseudonym) for every value of the column; values already mapped keep theirs.

    First appearance means nothing on partitions, so new values are numbered in
    seeded-hash order after the stored ones. That order spreads over many tasks and,
    unlike value order, tells nothing about the values.
    """
    values = df.where(F.col(column).isNotNull()).select(F.col(column).cast("string").alias("value")).distinct()
    start = 0
    if existing is not None:
        values = values.join(existing.select("value"), "value", "left_anti")
        stored = F.regexp_extract("pseudonym", r"(\d+)$", 1)
        top = existing.agg(F.max(F.when(stored != "", stored.cast("long")))).first()[0]
        start = 0 if top is None else top + 1
    ranked = hash_rank(values, [], ["value"], seed)
    number = F.format_string("%06d", F.col("rn") - 1 + start)
    fresh = ranked.select("value", F.concat(F.lit(f"{prefix}_{column.upper()}_"), number).alias("pseudonym"))
    return fresh if existing is None else existing.select("value", "pseudonym").unionByName(fresh)


def attach_pseudonyms(df: DataFrame, mapping: DataFrame, column: str) -> DataFrame:
    side = mapping.select(F.col("value").alias(f"_v_{column}"), F.col("pseudonym").alias(f"_pseudo_{column}"))
    return df.join(side, F.col(column).cast("string") == F.col(f"_v_{column}"), "left").drop(f"_v_{column}")
