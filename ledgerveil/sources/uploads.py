"""Per-institution uploads: label discovery, counts, listing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# --- fixed values: label columns in order of preference ---------------------------------------
LABEL_COLUMNS = ["is_fraud", "fraud", "Class", "isFraud", "label", "target"]
# ------------------------------------------------------------------------------------------------


def label_column(columns: Sequence[str]) -> str | None:
    return next((c for c in LABEL_COLUMNS if c in columns), None)


def process_upload(df: DataFrame, bank: str = "bank_id") -> DataFrame:
    """(bank, n_rows, n_fraud, fraud_rate) for CSV and Parquet alike."""
    label = label_column(df.columns)
    fraud = F.coalesce(F.sum(F.col(label).cast("int")), F.lit(0)) if label else F.lit(0)
    return df.groupBy(bank).agg(F.count(F.lit(1)).alias("n_rows"), fraud.cast("bigint").alias("n_fraud")).withColumn(
        "fraud_rate", F.col("n_fraud") / F.col("n_rows")
    )


def list_uploads(log: DataFrame, bank: object | None = None, status: str | None = None, limit: int = 50) -> DataFrame:
    """Newest uploads first; ``log``: upload_id, bank_id, status, uploaded_at."""
    out = log
    if bank is not None:
        out = out.where(F.col("bank_id") == F.lit(bank))
    if status:
        out = out.where(F.col("status") == status)
    return out.orderBy(F.col("uploaded_at").desc(), F.col("upload_id").desc()).limit(limit)
