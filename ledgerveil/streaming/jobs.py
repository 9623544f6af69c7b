"""Structured Streaming: file ingest, windowed rules, velocity, monitoring, compliance alerts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ledgerveil.sources.uploads import process_upload

# --- fixed values: rules (name, event condition, window, slide, strictly more than) -------------
RULES = {
    "brute_force": ("login_failure", "5 minutes", "1 minute", 5),
    "api_abuse": ("request", "1 minute", "30 seconds", 1000),
    "data_exfiltration": ("export_request", "1 hour", "10 minutes", 10),
    "privilege_escalation": ("access_denied", "1 hour", "10 minutes", 3),
}
UNUSUAL_HOURS = (2, 5)
# --------------------------------------------------------------------------------------------------


def read_parquet_stream(spark: SparkSession, folder: str, schema: object, name_filter: str | None = None, files_per_trigger: int | None = None) -> DataFrame:
    """New files of a folder as a stream; the schema is given, never inferred."""
    reader = spark.readStream.schema(schema)
    if name_filter:
        reader = reader.option("pathGlobFilter", name_filter)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder)


def event_time(df: DataFrame, time: str) -> DataFrame:
    """Watermarks need a timestamp with time zone; zone-less values are taken as session time."""
    return df.withColumn(time, F.col(time).cast("timestamp"))


def window_counts(df: DataFrame, time: str, keys: list[str], length: str, slide: str | None = None, watermark: str | None = None) -> DataFrame:
    """Events per sliding (or tumbling) window and key; the same code serves batch and stream."""
    base = event_time(df, time)
    if watermark:
        base = base.withWatermark(time, watermark)
    w = F.window(time, length, slide) if slide else F.window(time, length)
    return base.groupBy(w.alias("w"), *keys).agg(F.count(F.lit(1)).alias("n")).select(
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, "n"
    )


def threshold_rule(df: DataFrame, time: str, actor: str, condition: Column, length: str, slide: str, more_than: int, watermark: str | None = None) -> DataFrame:
    """Windows in which an actor exceeds the allowed number of matching events."""
    return window_counts(df.where(condition), time, [actor], length, slide, watermark).where(F.col("n") > more_than)


def unusual_hours(df: DataFrame, time: str, condition: Column) -> DataFrame:
    """Matching events between the quiet hours (02:00 up to 05:00)."""
    hour = F.hour(F.col(time).cast("timestamp"))
    return df.where(condition & (hour >= UNUSUAL_HOURS[0]) & (hour < UNUSUAL_HOURS[1]))


def velocity_stream(df: DataFrame, time: str, account: str, watermark: str = "1 hour") -> DataFrame:
    """Transactions per account in sliding hours; rows later than the watermark are dropped."""
    return window_counts(df, time, [account], "1 hour", "10 minutes", watermark)


def ingest_uploads(batch: DataFrame, bank: str = "bank_id") -> DataFrame:
    return process_upload(batch, bank)


def to_parquet(df: DataFrame, out: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Exactly-once file sink, run until the present input is consumed."""
    return (
        df.writeStream.format("parquet").outputMode(mode).option("path", out).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def each_batch(df: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Run a batch operator on every micro-batch (scoring, mining, ingest)."""
    return df.writeStream.outputMode(mode).foreachBatch(work).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def batch_writer(operator: Callable[[DataFrame], DataFrame], out: str) -> Callable[[DataFrame, int], None]:
    """Write an operator's result per batch under its id: a replayed batch overwrites itself."""

    def work(batch: DataFrame, batch_id: int) -> None:
        operator(batch).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return work


def compliance_alerts(ledger: DataFrame | None = None, certificates: DataFrame | None = None, chain: DataFrame | None = None, consents: DataFrame | None = None, k_min: int = 5, as_of: Column | None = None) -> DataFrame:
    """(rule, severity, subject) from budget, class size, chain and consent rows; works on streams too.

    ledger: account, remaining_epsilon; certificates: table_name, k_anonymity; chain:
    session_id, broken; consents: subject, expires_at.
    """
    parts: list[DataFrame] = []

    def add(df: DataFrame, cond: Column, rule: Column | str, severity: Column | str, subject: str) -> None:
        rule_c = F.lit(rule) if isinstance(rule, str) else rule
        sev_c = F.lit(severity) if isinstance(severity, str) else severity
        parts.append(df.where(cond).select(rule_c.alias("rule"), sev_c.alias("severity"), F.col(subject).cast("string").alias("subject")))

    if ledger is not None:
        left = F.col("remaining_epsilon")
        add(
            ledger, left < 0.2,
            F.when(left <= 0, "privacy_budget_exhausted").otherwise("privacy_budget_low"),
            F.when(left <= 0, "critical").otherwise("warning"), "account",
        )
    if certificates is not None:
        add(certificates, F.col("k_anonymity") < k_min, "k_anonymity_violation", "critical", "table_name")
    if chain is not None:
        add(chain, F.col("broken"), "audit_integrity_failure", "critical", "session_id")
    if consents is not None:
        now = as_of if as_of is not None else F.current_timestamp()
        soon = (F.col("expires_at") > now) & (F.unix_timestamp("expires_at") - F.unix_timestamp(now) < 30 * 86400)
        add(consents, soon, "consent_expiring", "info", "subject")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
