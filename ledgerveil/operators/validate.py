"""Validation rules, missing values, schema gate, consent, erasure."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerveil.operators.transform import is_numeric
from ledgerveil.plans.ranking import exact_quantiles


@dataclass(frozen=True)
class Rule:
    """Bounds or allowed values of one column; null breaks a rule only if ``required``."""

    column: str
    minimum: float | None = None
    maximum: float | None = None
    allowed: tuple | None = None
    required: bool = False

    @property
    def name(self) -> str:
        parts = [self.column]
        if self.minimum is not None:
            parts.append(f"min={self.minimum:g}")
        if self.maximum is not None:
            parts.append(f"max={self.maximum:g}")
        if self.allowed is not None:
            parts.append("values")
        if self.required:
            parts.append("required")
        return " ".join(parts)

    def broken(self) -> Column:
        c = F.col(self.column)
        bad = F.lit(False)
        if self.minimum is not None:
            bad = bad | F.coalesce(c < self.minimum, F.lit(False))
        if self.maximum is not None:
            bad = bad | F.coalesce(c > self.maximum, F.lit(False))
        if self.allowed is not None:
            bad = bad | F.coalesce(~c.isin(*self.allowed), F.lit(False))
        if self.required:
            bad = bad | c.isNull()
        return bad


# --- fixed values: rules per dataset (canonical names) -----------------------------
RULES: dict[str, list[Rule]] = {
    "bank_account_fraud": [
        Rule("is_fraud", allowed=(True, False)),
        Rule("customer_age", minimum=18, maximum=100),
        Rule("income", minimum=0),
        Rule("velocity_6h", minimum=0),
    ],
    "credit_card_fraud": [
        Rule("is_fraud", allowed=(True, False)),
        Rule("amount", minimum=0),
        Rule("time_seconds", minimum=0),
    ],
    "paysim": [
        Rule("is_fraud", allowed=(True, False)),
        Rule("transaction_type", allowed=("CASH_IN", "CASH_OUT", "DEBIT", "PAYMENT", "TRANSFER")),
        Rule("amount", minimum=0),
    ],
}
# --------------------------------------------------------------------------------------


def violations(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """(rule, n_violations, n_rows) from one aggregate."""
    wide = df.agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(r.broken()).alias(f"r{i}") for i, r in enumerate(rules)]
    )
    cells = [
        F.struct(F.lit(r.name).alias("rule"), F.col(f"r{i}").alias("n_violations"), F.col("n").alias("n_rows"))
        for i, r in enumerate(rules)
    ]
    return wide.select(F.explode(F.array(*cells)).alias("v")).select("v.*")


def quarantine(df: DataFrame, rules: Sequence[Rule]) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected with the names of the broken rules)."""
    names = F.filter(F.array(*[F.when(r.broken(), F.lit(r.name)) for r in rules]), lambda x: x.isNotNull())
    marked = df.withColumn("broken_rules", names)
    return marked.where(F.size("broken_rules") == 0).drop("broken_rules"), marked.where(F.size("broken_rules") > 0)


def fill_values(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row with the median of numeric and the most frequent value of text columns.

    Fallbacks: 0 and UNKNOWN. The mode's ties go to the smallest value.
    """
    out: DataFrame | None = None
    for c in columns:
        if is_numeric(df.schema[c].dataType):
            part = exact_quantiles(df.select(F.col(c).cast("double").alias("v")), [], "v", {c: 0.5})
            part = part.agg(F.coalesce(F.max(c), F.lit(0.0)).alias(c))
        else:
            counts = df.where(F.col(c).isNotNull()).groupBy(c).agg(F.count(F.lit(1)).alias("m"))
            top = counts.groupBy("m").agg(F.min(c).alias("v")).agg(F.max_by("v", "m").alias(c))
            part = top.select(F.coalesce(F.col(c).cast("string"), F.lit("UNKNOWN")).alias(c))
        part = part.withColumn("_k", F.lit(1))
        out = part if out is None else out.join(part, "_k")
    return out.drop("_k") if out is not None else df.sparkSession.createDataFrame([{}])


def impute(df: DataFrame, columns: Sequence[str], critical: Sequence[str] = ()) -> DataFrame:
    """Drop rows lacking a critical value, then fill the rest from the kept rows."""
    kept = df.na.drop(subset=list(critical)) if critical else df
    if not columns:
        return kept
    values = fill_values(kept, columns).first().asDict()  # one number or text per column
    return kept.select(
        *[
            F.coalesce(F.col(c), F.lit(values[c]).cast(kept.schema[c].dataType)).alias(c) if c in values else F.col(c)
            for c in kept.columns
        ]
    )


def schema_gate(df: DataFrame, expected: T.StructType, required: Sequence[str] = ()) -> DataFrame:
    """(column_name, issue): unknown columns, missing required ones, wrong types (schema-sized)."""
    have = {f.name: f.dataType for f in df.schema.fields}
    want = {f.name: f.dataType for f in expected.fields}
    rows = [(c, "unknown column") for c in have if c not in want]
    rows += [(c, "missing required column") for c in required if c not in have]
    rows += [
        (c, f"expected {want[c].simpleString()}, found {have[c].simpleString()}")
        for c in have
        if c in want and have[c] != want[c]
    ]
    return df.sparkSession.createDataFrame(rows, "column_name string, issue string")


def erase_subjects(df: DataFrame, requests: DataFrame, subject: str) -> DataFrame:
    """Rows of everyone except the subjects in the request table."""
    return df.join(requests.select(F.col(subject)).distinct(), subject, "left_anti")


def with_valid_consent(
    df: DataFrame, consents: DataFrame, subject: str, purpose: str, as_of: Column
) -> DataFrame:
    """Rows whose subject gave unwithdrawn, unexpired consent for the purpose.

    ``consents``: subject, consent_given, consent_timestamp, withdrawal_timestamp,
    processing_purposes (array), retention_period_days.
    """
    ends = F.timestamp_seconds(F.unix_timestamp("consent_timestamp") + F.col("retention_period_days") * 86400)
    valid = consents.where(
        F.col("consent_given")
        & (F.col("consent_timestamp") <= as_of)
        & (F.col("withdrawal_timestamp").isNull() | (F.col("withdrawal_timestamp") > as_of))
        & (ends > as_of)
        & F.array_contains("processing_purposes", purpose)
    )
    return df.join(valid.select(subject).distinct(), subject, "left_semi")
