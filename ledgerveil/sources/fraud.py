"""Loaders and unification of the three public fraud tables."""

from __future__ import annotations

import os
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerveil.functions.hashing import account_hash
from ledgerveil.operators.split import sample_fraction

# --- fixed values: source files and canonical names -------------------------------------------
BANK_FILES = ["Base.csv", "Variant I.csv", "Variant II.csv", "Variant III.csv", "Variant IV.csv", "Variant V.csv"]

RENAMES: dict[str, dict[str, str]] = {
    "bank_account_fraud": {
        "fraud_bool": "is_fraud",
        "income": "income",
        "name_email_similarity": "name_email_similarity",
        "current_address_months_count": "address_months",
        "customer_age": "customer_age",
        "days_since_request": "days_since_request",
        "intended_balcon_amount": "intended_balance_amount",
        "payment_type": "payment_type",
        "zip_count_4w": "zip_activity_4w",
        "velocity_6h": "velocity_6h",
        "velocity_24h": "velocity_24h",
        "velocity_4w": "velocity_4w",
        "bank_branch_count_8w": "bank_branch_activity_8w",
        "date_of_birth_distinct_emails_4w": "dob_distinct_emails_4w",
        "employment_status": "employment_status",
        "credit_risk_score": "credit_risk_score",
        "email_is_free": "email_is_free",
        "housing_status": "housing_status",
        "phone_home_valid": "phone_home_valid",
        "phone_mobile_valid": "phone_mobile_valid",
        "bank_months_count": "bank_months",
        "has_other_cards": "has_other_cards",
        "proposed_credit_limit": "proposed_credit_limit",
        "foreign_request": "foreign_request",
        "source": "source_channel",
        "session_length_in_minutes": "session_length_minutes",
        "device_os": "device_os",
        "keep_alive_session": "keep_alive_session",
        "device_distinct_emails_8w": "device_distinct_emails_8w",
        "device_fraud_count": "device_fraud_count",
        "month": "month",
    },
    "credit_card_fraud": {"Time": "time_seconds", "Amount": "amount", "Class": "is_fraud"},
    "paysim": {
        "step": "step",
        "type": "transaction_type",
        "amount": "amount",
        "nameOrig": "account_orig",
        "oldbalanceOrg": "balance_orig_before",
        "newbalanceOrig": "balance_orig_after",
        "nameDest": "account_dest",
        "oldbalanceDest": "balance_dest_before",
        "newbalanceDest": "balance_dest_after",
        "isFraud": "is_fraud",
        "isFlaggedFraud": "is_flagged_fraud",
    },
}

BANK_SCHEMA = (
    "fraud_bool int, income double, name_email_similarity double, prev_address_months_count int, "
    "current_address_months_count int, customer_age int, days_since_request double, intended_balcon_amount double, "
    "payment_type string, zip_count_4w int, velocity_6h double, velocity_24h double, velocity_4w double, "
    "bank_branch_count_8w int, date_of_birth_distinct_emails_4w int, employment_status string, credit_risk_score int, "
    "email_is_free int, housing_status string, phone_home_valid int, phone_mobile_valid int, bank_months_count int, "
    "has_other_cards int, proposed_credit_limit double, foreign_request int, source string, "
    "session_length_in_minutes double, device_os string, keep_alive_session int, device_distinct_emails_8w int, "
    "device_fraud_count int, month int"
)
CARD_SCHEMA = "Time double, " + ", ".join(f"V{i} double" for i in range(1, 29)) + ", Amount double, Class int"
PAYMENT_SCHEMA = (
    "step int, type string, amount double, nameOrig string, oldbalanceOrg double, newbalanceOrig double, "
    "nameDest string, oldbalanceDest double, newbalanceDest double, isFraud int, isFlaggedFraud int"
)
UNIFIED_COLUMNS = ["transaction_id", "time_value", "amount", "is_fraud", "fraud_type", "dataset_source"]
# -------------------------------------------------------------------------------------------------


class DatasetMissing(FileNotFoundError):
    """None of a dataset's files exist."""


def _read_csv(spark: SparkSession, paths: Sequence[str], schema: str) -> DataFrame:
    """Columns are matched to the header of each file by name; unknown ones are added as text."""
    want = T.StructType.fromDDL(schema)
    types = {f.name: f.dataType for f in want.fields}
    header = spark.read.option("header", True).csv(list(paths)).columns
    actual = T.StructType([T.StructField(c, types.get(c, T.StringType())) for c in header])
    return spark.read.option("header", True).option("enforceSchema", False).schema(actual).csv(list(paths))


def _finish(df: DataFrame, dataset: str, ids: Sequence[str], fraction: float | None, seed: int) -> DataFrame:
    renames = {k: v for k, v in RENAMES[dataset].items() if k in df.columns and k != v}
    out = df.withColumnsRenamed(renames).withColumn("dataset_source", F.lit(dataset))
    if "is_fraud" in out.columns:
        out = out.withColumn("is_fraud", F.col("is_fraud").cast("boolean"))
    return sample_fraction(out, [c for c in (ids or out.columns) if c in out.columns], fraction, seed)


def load_bank_applications(spark: SparkSession, folder: str, fraction: float | None = None, seed: int = 42) -> DataFrame:
    """All variant files that exist, tagged by ``variant``; differing columns are filled with null."""
    parts: DataFrame | None = None
    for name in BANK_FILES:
        path = os.path.join(folder, name)
        if not _exists(spark, path):
            continue
        tag = name.removesuffix(".csv").replace("Variant ", "V")
        df = _read_csv(spark, [path], BANK_SCHEMA).withColumn("variant", F.lit(tag))
        parts = df if parts is None else relaxed_union(parts, df)
    if parts is None:
        raise DatasetMissing(f"no bank application file in {folder}")
    return _finish(parts, "bank_account_fraud", [], fraction, seed)


def load_card_transactions(spark: SparkSession, folder: str, fraction: float | None = None, seed: int = 42) -> DataFrame:
    path = os.path.join(folder, "creditcard.csv")
    if not _exists(spark, path):
        raise DatasetMissing(path)
    return _finish(_read_csv(spark, [path], CARD_SCHEMA), "credit_card_fraud", [], fraction, seed)


def load_mobile_payments(spark: SparkSession, folder: str, fraction: float | None = None, seed: int = 42, salt: str | None = None) -> DataFrame:
    """All files of the first pattern that matches any; account names are replaced by their hashes."""
    paths = _matches(spark, folder, ["PS_*.csv", "paysim*.csv"])
    if not paths:
        raise DatasetMissing(f"no mobile payment file in {folder}")
    df = _finish(_read_csv(spark, paths, PAYMENT_SCHEMA), "paysim", [], fraction, seed)
    return df.withColumns(
        {"account_orig_hash": account_hash("account_orig", salt), "account_dest_hash": account_hash("account_dest", salt)}
    ).drop("account_orig", "account_dest")


LOADERS: dict[str, Callable[..., DataFrame]] = {
    "bank_account_fraud": load_bank_applications,
    "credit_card_fraud": load_card_transactions,
    "paysim": load_mobile_payments,
}


def load_all(spark: SparkSession, folders: dict[str, str], fraction: float | None = None, datasets: Sequence[str] | None = None) -> dict[str, DataFrame]:
    """Lazy frames of the datasets that exist; absent ones are left out."""
    out = {}
    for name in datasets or list(LOADERS):
        try:
            out[name] = LOADERS[name](spark, folders[name], fraction)
        except (DatasetMissing, KeyError):
            continue
    return out


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p))


def _matches(spark: SparkSession, folder: str, patterns: Sequence[str]) -> list[str]:
    """Files of the first pattern with a match, by the file system that Spark itself resolves the path to."""
    for pattern in patterns:
        p = spark._jvm.org.apache.hadoop.fs.Path(os.path.join(folder, pattern))
        hits = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p)
        if hits:
            return sorted(h.getPath().toString() for h in hits)
    return []


# --- set operations -------------------------------------------------------------------------------

_ORDER = ["boolean", "tinyint", "smallint", "int", "bigint", "float", "double"]


def common_type(a: T.DataType, b: T.DataType) -> str:
    """Wider of two numeric types; anything that does not fit together becomes text."""
    x, y = a.simpleString(), b.simpleString()
    if x == y:
        return x
    if x in _ORDER and y in _ORDER:
        if {x, y} <= {"bigint", "float"} or ({x, y} == {"int", "float"}):
            return "double"
        return _ORDER[max(_ORDER.index(x), _ORDER.index(y))]
    return "string"


def relaxed_union(a: DataFrame, b: DataFrame) -> DataFrame:
    """Union by name over all columns: missing ones are null, differing types are widened."""
    ta = {f.name: f.dataType for f in a.schema.fields}
    tb = {f.name: f.dataType for f in b.schema.fields}
    wide = {c: common_type(ta[c], tb[c]) for c in ta if c in tb}
    cast = lambda df: df.select(*[F.col(c).cast(wide[c]).alias(c) if c in wide else F.col(c) for c in df.columns])
    return cast(a).unionByName(cast(b), allowMissingColumns=True)


# --- statistics and catalog --------------------------------------------------------------------------


def dataset_stats(df: DataFrame, dataset: str, label: str = "is_fraud") -> DataFrame:
    """One row: rows, fraud, legitimate, ratio, columns, imbalance (infinite without fraud)."""
    fraud = F.count_if(F.col(label))
    n = F.count(F.lit(1))
    return df.agg(n.alias("total_rows"), fraud.alias("fraud_count")).select(
        F.lit(dataset).alias("dataset"),
        "total_rows",
        "fraud_count",
        (F.col("total_rows") - F.col("fraud_count")).alias("legit_count"),
        F.coalesce(F.try_divide("fraud_count", "total_rows"), F.lit(0.0)).alias("fraud_ratio"),
        F.lit(len(df.columns)).cast("bigint").alias("num_features"),
        F.when(F.col("fraud_count") > 0, (F.col("total_rows") - F.col("fraud_count")) / F.col("fraud_count"))
        .otherwise(F.lit(float("inf")))
        .alias("imbalance_ratio"),
    )


def unified_stats(stats: DataFrame) -> DataFrame:
    return stats.agg(
        F.sum("total_rows").alias("total_rows"),
        F.sum("fraud_count").alias("total_fraud"),
        F.coalesce(F.try_divide(F.sum("fraud_count"), F.sum("total_rows")), F.lit(0.0)).alias("overall_fraud_ratio"),
        F.max("num_features").alias("combined_features"),
        F.count(F.lit(1)).alias("n_datasets"),
    )


def column_catalog(spark: SparkSession) -> DataFrame:
    rows = [(d, s, c) for d, m in RENAMES.items() for s, c in m.items()]
    return spark.createDataFrame(rows, "dataset string, source_name string, canonical_name string")


def unify(df: DataFrame, dataset: str) -> DataFrame:
    """Canonical transaction columns from a loaded table."""
    body: list[Column]
    if dataset == "bank_account_fraud":
        key = F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in sorted(df.columns)]), 256)
        body = [key, F.col("month").cast("double"), F.col("intended_balance_amount").cast("double"), F.lit("account_fraud")]
    elif dataset == "credit_card_fraud":
        key = F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in sorted(df.columns)]), 256)
        body = [key, F.col("time_seconds").cast("double"), F.col("amount").cast("double"), F.lit("card_fraud")]
    elif dataset == "paysim":
        key = F.sha2(F.concat_ws("|", "account_orig_hash", F.col("step").cast("string")), 256)
        body = [key, F.col("step").cast("double"), F.col("amount").cast("double"), F.lit("payment_fraud")]
    else:
        raise ValueError(f"unknown dataset {dataset}")
    tx, at, amount, kind = body
    return df.select(
        F.substring(tx, 1, 16).alias("transaction_id"),
        at.alias("time_value"),
        amount.alias("amount"),
        F.col("is_fraud"),
        kind.alias("fraud_type"),
        F.lit(dataset).alias("dataset_source"),
    )
