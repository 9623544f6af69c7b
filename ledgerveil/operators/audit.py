"""Hash-linked audit events as an append-only table."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerveil.plans.ranking import ordered_prefix

# --- fixed values: event types ---------------------------------------------------
EVENT_TYPES = [
    "pii_scan_started", "pii_scan_completed", "pii_detected", "transformation_started",
    "transformation_completed", "certification_requested", "certification_granted", "certification_denied",
    "data_access", "data_export", "configuration_change", "error",
]
# -----------------------------------------------------------------------------------

# input of link(): session_id, seq (1..n in each session), event_type, ts, actor, resource, action, details


def payload(with_id: Column | None = None) -> Column:
    """Everything an event's hash covers, apart from the previous hash, as a JSON array.

    Quotes and nulls keep the fields apart: no text can move from one to the next unnoticed.
    """
    event_id = with_id if with_id is not None else F.col("event_id")
    fields = [event_id, F.col("event_type"), F.col("ts"), F.col("actor"), F.col("resource"), F.col("action"), F.col("details")]
    return F.to_json(F.array(*[c.cast("string") for c in fields]))


def event_hash(body: Column, previous: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", body, F.coalesce(previous, F.lit("None"))), 256), 1, 16)


def link(events: DataFrame, heads: DataFrame | None = None) -> DataFrame:
    """Give every event its id, the previous event's hash and its own hash.

    Each hash depends on the one before, so a session is walked in order. Sessions are
    spread over tasks and each task streams its sorted rows batch by batch, keeping one
    hash in memory: a very long session is neither collected nor cut. ``heads``
    (session_id, event_hash) continues chains already stored.
    """
    seq = F.col("seq").cast("string")
    eid = F.concat(F.col("session_id"), F.lit("-"), F.lpad(seq, F.greatest(F.lit(5), F.length(seq)), F.lit("0")))
    base = events.withColumn("event_id", eid).withColumn("_p", payload())
    if heads is None:
        base = base.withColumn("_head", F.lit(None).cast("string"))
    else:
        base = base.join(heads.select("session_id", F.col("event_hash").alias("_head")), "session_id", "left")
    fields = ["session_id", "seq", "event_id", "event_type", "ts", "actor", "resource", "action", "details"]
    ordered = (
        base.select(*fields, "_p", "_head").repartition("session_id").sortWithinPartitions("session_id", "seq")
    )
    out_schema = T.StructType(
        [*[ordered.schema[f] for f in fields], T.StructField("previous_hash", T.StringType()),
         T.StructField("event_hash", T.StringType())]
    )
    return ordered.mapInPandas(_walk, out_schema)


def _walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    session, last = None, None
    for pdf in batches:
        previous, own = [], []
        for sid, body, head in zip(pdf["session_id"], pdf["_p"], pdf["_head"]):
            if sid != session:
                session, last = sid, head if isinstance(head, str) else None
            previous.append(last)
            last = hashlib.sha256(f"{body}|{last}".encode()).hexdigest()[:16]
            own.append(last)
        yield pdf.drop(columns=["_p", "_head"]).assign(previous_hash=previous, event_hash=own)


def verify(events: DataFrame) -> DataFrame:
    """Issues found in linked events: wrong hash, or a link that does not match its predecessor.

    The predecessor is reached by an equi-join on (session, seq - 1), so even one
    very long session is checked in parallel.
    """
    prev = events.select(
        F.col("session_id"), (F.col("seq") + 1).alias("seq"), F.col("event_hash").alias("_expected")
    )
    joined = events.join(prev, ["session_id", "seq"], "left")
    bad_hash = ~F.col("event_hash").eqNullSafe(event_hash(payload(), F.col("previous_hash")))
    # the first event of a chain has no predecessor to name
    bad_link = ~F.col("previous_hash").eqNullSafe(F.col("_expected"))
    issues = F.filter(
        F.array(F.when(bad_hash, F.lit("hash mismatch")), F.when(bad_link, F.lit("chain broken"))),
        lambda x: x.isNotNull(),
    )
    return joined.select("session_id", "seq", "event_id", F.explode(issues).alias("issue"))


def counts_by_type(events: DataFrame) -> DataFrame:
    return events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n")).orderBy("event_type")


# --- what happened, as rows for link() ----------------------------------------------------------
# Each constructor turns the rows of ``facts`` into events of one kind; ``step`` and the order within it give the sequence.


def happened(facts: DataFrame, step: int, event_type: Column | str, resource: Column | str, action: Column, details: list[str], order: list[str] | None = None) -> DataFrame:
    """(step, within, event_type, resource, action, details): one event a row, its details a JSON object of the named columns."""
    text = lambda v: F.lit(v) if isinstance(v, str) else v
    within = F.concat_ws("/", *[F.col(c).cast("string") for c in order]) if order else F.lit("")
    body = F.to_json(F.struct(*details), {"ignoreNullFields": "false"})
    return facts.select(F.lit(step).alias("step"), within.alias("within"), text(event_type).alias("event_type"), text(resource).alias("resource"), action.alias("action"), body.alias("details"))


def scan_started(sizes: DataFrame, dataset: str, step: int = 1) -> DataFrame:
    """``sizes``: n_columns, n_rows."""
    return happened(sizes, step, "pii_scan_started", dataset, F.format_string("scan of %d columns and %d rows begins", "n_columns", "n_rows"), ["n_columns", "n_rows"])


def scan_completed(summary: DataFrame, dataset: str, step: int = 2) -> DataFrame:
    """``summary``: total_columns, columns_with_pii, passed."""
    return happened(summary, step, "pii_scan_completed", dataset, F.format_string("%d of %d columns hold personal data", "columns_with_pii", "total_columns"), ["total_columns", "columns_with_pii", "passed"])


def detected(matches: DataFrame, step: int = 3) -> DataFrame:
    """One event a match, on the column; ``matches``: column_name, pii_type, sensitivity, confidence."""
    action = F.concat(F.col("pii_type"), F.lit(" found, sensitivity "), F.col("sensitivity"))
    return happened(matches, step, "pii_detected", F.col("column_name"), action, ["pii_type", "sensitivity", "confidence"], ["column_name", "pii_type"])


def transformation_started(plan_size: DataFrame, dataset: str, step: int = 4) -> DataFrame:
    """``plan_size``: n_columns."""
    return happened(plan_size, step, "transformation_started", dataset, F.format_string("treatment of %d columns begins", "n_columns"), ["n_columns"])


def transformation_completed(log: DataFrame, dataset: str, step: int = 5) -> DataFrame:
    """``log`` as the transformation gives it: one row a column, so its list fits into one event."""
    treated = F.sort_array(F.collect_list(F.struct("column_name", "transformation_type", "rows_transformed", "success"))).alias("columns")
    done = log.agg(F.count(F.lit(1)).alias("n_columns"), F.count_if("success").alias("n_treated"), treated)
    return happened(done, step, "transformation_completed", dataset, F.format_string("%d of %d columns treated", "n_treated", "n_columns"), ["n_columns", "n_treated", "columns"])


def certification_requested(sizes: DataFrame, dataset: str, step: int = 6) -> DataFrame:
    return happened(sizes, step, "certification_requested", dataset, F.format_string("certificate asked for %d rows", "n_rows"), ["n_columns", "n_rows"])


def certified(certificate: DataFrame, dataset: str, step: int = 7) -> DataFrame:
    """Granted or denied, with score and gates."""
    kind = F.when(F.col("certified"), "certification_granted").otherwise("certification_denied")
    told = certificate.withColumn("gates", F.array(*[F.col(f"gate{i}_passed") for i in range(1, 6)]))
    return happened(told, step, kind, dataset, F.concat(F.lit("level "), F.col("certification_level")), ["certified", "certification_level", "certification_score", "gates"])


def accessed(reads: DataFrame, resource: str, step: int = 8) -> DataFrame:
    """``reads``: accessor, purpose."""
    return happened(reads, step, "data_access", resource, F.concat(F.lit("read for "), F.col("purpose")), ["accessor", "purpose"], ["accessor", "purpose"])


def exported(exports: DataFrame, resource: str, step: int = 9) -> DataFrame:
    """``exports``: destination, format, n_rows."""
    return happened(exports, step, "data_export", resource, F.format_string("%d rows to %s", "n_rows", "destination"), ["destination", "format", "n_rows"], ["destination"])


def failed(errors: DataFrame, step: int = 10) -> DataFrame:
    """``errors``: resource, error_type, message."""
    return happened(errors, step, "error", F.col("resource"), F.concat(F.col("error_type"), F.lit(": "), F.col("message")), ["error_type", "message"], ["resource", "error_type", "message"])


def chained(parts: list[DataFrame], session_id: str, ts: str, actor: str = "system", heads: DataFrame | None = None) -> DataFrame:
    """Events of one session, numbered by step and the order within it, and linked."""
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    seq = F.row_number().over(Window.partitionBy("session_id").orderBy("step", "within", "details"))
    named = rows.withColumns({"session_id": F.lit(session_id), "ts": F.lit(ts), "actor": F.lit(actor)})
    return link(named.withColumn("seq", seq.cast("bigint")).drop("step", "within"), heads)


def events_of_type(events: DataFrame, event_type: str) -> DataFrame:
    if event_type not in EVENT_TYPES:
        raise ValueError(f"unknown event type {event_type}")
    return events.where(F.col("event_type") == event_type)


def events_on(events: DataFrame, resource: str) -> DataFrame:
    return events.where(F.col("resource") == resource)


def compliance_lines(events: DataFrame) -> DataFrame:
    """Printable report lines: integrity, counts per type, then the log in order."""
    issues = verify(events).agg(F.count(F.lit(1)).alias("n"))
    head = issues.select(
        F.lit(0).alias("part"), F.lit("").alias("k1"), F.lit(0).cast("bigint").alias("k2"),
        F.concat(
            F.lit("Audit chain integrity: "),
            F.when(F.col("n") == 0, "VERIFIED").otherwise(F.format_string("COMPROMISED (%d issues)", "n")),
        ).alias("line"),
    )
    body = counts_by_type(events).select(
        F.lit(1).alias("part"), F.col("event_type").alias("k1"), F.lit(0).cast("bigint").alias("k2"),
        F.format_string("%s: %d events", "event_type", "n").alias("line"),
    )
    log = events.select(
        F.lit(2).alias("part"), F.col("session_id").alias("k1"), F.col("seq").alias("k2"),
        F.concat_ws(" | ", F.col("ts").cast("string"), "event_type", "resource", "action", "actor").alias("line"),
    )
    return head.unionByName(body).unionByName(log).orderBy("part", "k1", "k2")


def latest_heads(events: DataFrame) -> DataFrame:
    """(session_id, event_hash) of the last event, for appending the next batch."""
    return events.groupBy("session_id").agg(F.max_by("event_hash", "seq").alias("event_hash"))


def number_within_session(events: DataFrame, order: str) -> DataFrame:
    """Add ``seq`` = 1..n per session along a numeric column that is unique in the session."""
    run = ordered_prefix(events.withColumn("_one", F.lit(1)), ["session_id"], order, ["_one"])
    return run.withColumn("seq", F.col("cum__one").cast("bigint")).drop("_one", "cum__one")
