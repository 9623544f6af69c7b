"""Streaming jobs run over the tables until the present input is consumed."""

from __future__ import annotations

from pyspark.errors import StreamingQueryException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerveil.catalog.base import KN, query, round_base, rounded
from ledgerveil.catalog.knowledge import SPIKE_SQL
from ledgerveil.catalog.modelling import saved_model
from ledgerveil.catalog.privacy import SPENT_SQL, release_ledger
from ledgerveil.catalog.quality import DETECT_SQL, audit_events, contact_table
from ledgerveil.operators import alerts, ledger, models, profile, reports
from ledgerveil.session import durable_dir, materialize
from ledgerveil.sources.tables import table
from ledgerveil.streaming import jobs, monitoring, rules, state


def _stream(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A table's files as a stream. The pattern stands for the table itself, be it one file or a folder of files."""
    return jobs.read_parquet_stream(spark, f"{sf}/{name}.parque[t]", table(spark, sf, name).schema)


_WINDOWS = """wn AS (SELECT make_timestamp(({step} * (epoch_us(ts) // {step}) - {step} * unnest(range(0, {k})))::BIGINT) AS window_start, {actor} AS actor FROM events {where}),
  wc AS (SELECT window_start, window_start + INTERVAL {length} AS window_end, actor, count(*) AS n FROM wn GROUP BY 1, 2, 3)"""


def _windows(length: str, length_us: int, step_us: int, actor: str, where: str = "") -> str:
    return _WINDOWS.format(step=step_us, k=length_us // step_us, actor=actor, length=length, where=where)


_MIN = 60_000_000
_SHOW = "strftime(window_start, '%Y-%m-%d %H:%M:%S') AS window_start, strftime(window_end, '%Y-%m-%d %H:%M:%S') AS window_end, actor, n"


def _show(df: DataFrame) -> DataFrame:
    return df.select(*[F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) for c in ("window_start", "window_end")], "actor", "n")


@query("rule_windows_batch", f"WITH {_windows('6 HOUR', 360 * _MIN, 60 * _MIN, 'user_id % 10', chr(10) + chr(32) + 'WHERE event_type = ' + repr('error'))} SELECT {_SHOW} FROM wc WHERE n > 5")
def _(spark: SparkSession, sf: str) -> DataFrame:
    """The batch twin of the streaming rule."""
    e = table(spark, sf, "events").withColumn("actor", F.col("user_id") % 10)
    return _show(jobs.threshold_rule(e, "ts", "actor", F.col("event_type") == "error", "6 hours", "1 hour", 5))


@query(
    "rule_windows_stream",
    f"""WITH {_windows('6 HOUR', 360 * _MIN, 60 * _MIN, 'user_id % 10', chr(10) + chr(32) + 'WHERE event_type = ' + repr('error'))}
      SELECT {_SHOW} FROM wc WHERE n > 5 AND window_end <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events WHERE event_type = 'error')""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    """Append mode: a window is written once the watermark has passed its end."""
    e = _stream(spark, sf, "events").withColumn("actor", F.col("user_id") % 10)
    rule = jobs.threshold_rule(e, "ts", "actor", F.col("event_type") == "error", "6 hours", "1 hour", 5, watermark="1 hour")
    out, cp = durable_dir(spark, "rule"), durable_dir(spark, "rule-checkpoint")
    jobs.to_parquet(rule, out, cp).awaitTermination()
    return _show(spark.read.schema(rule.schema).parquet(out))


@query(
    "velocity_stream",
    f"""WITH {_windows('1 HOUR', 60 * _MIN, 10 * _MIN, 'user_id')} SELECT {_SHOW} FROM wc WHERE window_end <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    v = jobs.velocity_stream(_stream(spark, sf, "events").withColumnRenamed("user_id", "actor"), "ts", "actor")
    out, cp = durable_dir(spark, "velocity"), durable_dir(spark, "velocity-checkpoint")
    jobs.to_parquet(v, out, cp).awaitTermination()
    return _show(spark.read.schema(v.schema).parquet(out))


@query("unusual_hours", "SELECT event_id, user_id FROM events WHERE event_type = 'signup' AND hour(ts) >= 2 AND hour(ts) < 5")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return jobs.unusual_hours(table(spark, sf, "events"), "ts", F.col("event_type") == "signup").select("event_id", "user_id")


#: Rows a file of a stream's input holds, about.
FILE_ROWS = 500_000


def _in_turn(df: DataFrame, parts: list[Column], purpose: str) -> tuple[str, int]:
    """(a folder with the rows of each condition, written one after the other, how many files each was written as).

    A stream that takes so many files a trigger reads the parts in this order; the more rows, the more files. All parts
    have equally many, none empty, so that no trigger mixes two of them. ``df`` is worked out once.
    """
    folder = durable_dir(df.sparkSession, purpose)
    rows = materialize(df, f"{purpose}-rows")
    sizes = rows.agg(*[F.count_if(part) for part in parts]).first()
    n = max(1, min(sum(sizes) // FILE_ROWS // len(parts), min(sizes) // 64))
    for part in parts:
        some = rows.where(part)
        (some.repartition(n) if n > 1 else some.coalesce(1)).write.mode("append").parquet(folder)
    return folder, n


def _dealt(key: Column, n: int) -> list[Column]:
    return [F.pmod(F.xxhash64(key), F.lit(n)) == i for i in range(n)]


@query("upload_stream", "SELECT l_suppkey AS bank_id, count(*) AS n_rows, sum((l_returnflag = 'R')::INT)::BIGINT AS n_fraud, round(avg((l_returnflag = 'R')::INT), 8) AS fraud_rate FROM lineitem GROUP BY 1")
def _(spark: SparkSession, sf: str) -> DataFrame:
    """Files arrive one a trigger, each with rows of every institution; totals are kept as state."""
    rows = table(spark, sf, "lineitem").select("l_orderkey", F.col("l_suppkey").alias("bank_id"), F.lit(1).alias("n_rows"), (F.col("l_returnflag") == "R").cast("int").alias("n_fraud"))
    src, n = _in_turn(rows, _dealt(F.col("l_orderkey"), 3), "uploads-in")
    sums = ["n_rows", "n_fraud"]
    totals = state.running_totals(jobs.read_parquet_stream(spark, src, rows.schema, files_per_trigger=n), "bank_id", sums)
    out, cp = durable_dir(spark, "uploads"), durable_dir(spark, "uploads-checkpoint")
    jobs.each_batch(totals, jobs.batch_writer(lambda b: b, out), cp, "update").awaitTermination()
    latest = state.latest_totals(spark.read.parquet(out), "bank_id", sums)
    return rounded(latest.withColumn("fraud_rate", F.col("n_fraud") / F.col("n_rows")), 8)


def _monitored(spark: SparkSession, sf: str) -> tuple[DataFrame, monitoring.BatchTable, monitoring.BatchTable]:
    """(batch scores, streamed rows, streamed rounds): a saved model, two files a trigger, and a batch that is replayed."""
    matrix, model, features = saved_model(spark, sf)
    rows = matrix.withColumns({"bank": F.pmod(F.col("event_id"), F.lit(20)), "round": F.lit(1) + F.pmod(F.col("event_id"), F.lit(7))})
    src, n = _in_turn(rows, _dealt(F.col("event_id"), 6), "monitor-in")
    root, cp = durable_dir(spark, "monitor"), durable_dir(spark, "monitor-checkpoint")
    work, scored, rounds = monitoring.monitor(spark, root, model, features, "event_id", "bank", "round")
    work = monitoring.interrupted(work, 1)
    for _ in range(2):  # the first run ends in the interruption, the second replays its batch and goes on
        run = jobs.each_batch(jobs.read_parquet_stream(spark, src, rows.schema, files_per_trigger=2 * n), work, cp)
        try:
            run.awaitTermination()
        except StreamingQueryException:
            continue
    batch = models.score(models.prepare(rows, "is_fraud", features, keep=["event_id"]), model)
    return batch, scored, rounds


@query("monitoring_stream", "SELECT event_id, 1 AS n_scored, true AS equals_batch FROM events")
def _(spark: SparkSession, sf: str) -> DataFrame:
    """Transactions scored on a stream by the saved model: each once, as the batch scorer does it."""
    batch, scored, _ = _monitored(spark, sf)
    streamed = scored.read().groupBy("event_id").agg(F.count(F.lit(1)).cast("int").alias("n_scored"), F.max("score").alias("streamed"), F.max("flagged").alias("flagged"))
    same = (F.abs(F.col("streamed") - F.col("score")) < 1e-12) & (F.col("flagged") == F.col("score_label"))
    return batch.join(streamed, "event_id", "left").select("event_id", "n_scored", F.coalesce(same, F.lit(False)).alias("equals_batch"))


@query("monitoring_rounds", "SELECT 1 + event_id % 7 AS round, event_id % 20 AS bank_id, count(*) AS n_rows, true AS equals_batch FROM events GROUP BY ALL")
def _(spark: SparkSession, sf: str) -> DataFrame:
    """Institutions' rounds merged from the stream's batches, against the batch scores."""
    batch, scored, rounds = _monitored(spark, sf)
    whole = monitoring.round_sums(batch.withColumns({"bank": F.pmod(F.col("event_id"), F.lit(20)), "round": F.lit(1) + F.pmod(F.col("event_id"), F.lit(7)), "flagged": F.col("score_label")}), "bank", "round")
    merged = monitoring.merged_rounds(rounds)
    same = (F.col("m.n_flagged") == F.col("w.n_flagged")) & (F.abs(F.col("m.mean_score") - F.col("w.score_millionths") / F.col("w.n_rows") / 1_000_000) < 1e-9)
    on = (F.col("m.round") == F.col("w.round")) & (F.col("m.bank_id") == F.col("w.bank_id"))
    return merged.alias("m").join(whole.alias("w"), on, "left").select("m.round", "m.bank_id", "m.n_rows", F.coalesce(same, F.lit(False)).alias("equals_batch"))


@query(
    "compliance_alerts",
    """SELECT CASE WHEN c_acctbal <= 0 THEN 'privacy_budget_exhausted' ELSE 'privacy_budget_low' END AS rule, CASE WHEN c_acctbal <= 0 THEN 'critical' ELSE 'warning' END AS severity, c_custkey::VARCHAR AS subject
        FROM customer WHERE c_acctbal / 1000 < 0.2
      UNION ALL SELECT 'consent_expiring', 'info', o_orderkey::VARCHAR FROM orders WHERE o_orderdate > TIMESTAMP '1998-01-01' AND o_orderdate < TIMESTAMP '1998-01-31'
      UNION ALL SELECT 'k_anonymity_violation', 'critical', l_suppkey::VARCHAR FROM (SELECT l_suppkey, l_returnflag, l_linestatus, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL) WHERE n < 5""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    budget = table(spark, sf, "customer").select(F.col("c_custkey").alias("account"), (F.col("c_acctbal") / 1000).alias("remaining_epsilon"))
    consents = table(spark, sf, "orders").select(F.col("o_orderkey").alias("subject"), F.col("o_orderdate").cast("timestamp").alias("expires_at"))
    classes = table(spark, sf, "lineitem").groupBy("l_suppkey", "l_returnflag", "l_linestatus", "l_linenumber").agg(F.count(F.lit(1)).alias("k_anonymity"))
    return jobs.compliance_alerts(budget, classes.withColumnRenamed("l_suppkey", "table_name"), None, consents, as_of=F.lit("1998-01-01 00:00:00").cast("timestamp"))


@query(
    "compliance_indicators",
    f"""{DETECT_SQL}, {SPENT_SQL}, cv AS (SELECT avg((c_acctbal > 0 AND TIMESTAMP '1996-01-01' + to_days((c_custkey % 900)::INT) > TIMESTAMP '1997-01-01')::INT) * 100 AS v FROM customer)
      SELECT 'remaining_epsilon' AS indicator, round(min(greatest(0, 10 - spent)), 6) AS value FROM sp
      UNION ALL SELECT 'min_class_size', min(n)::DOUBLE FROM (SELECT count(*) AS n FROM customer GROUP BY c_nationkey, c_mktsegment)
      UNION ALL SELECT 'pii_blocks_direct', (count(*) FILTER (sensitivity IN ('critical', 'high')))::DOUBLE FROM r WHERE rn = 1
      UNION ALL SELECT 'pii_blocks_quasi', (count(*) FILTER (sensitivity NOT IN ('critical', 'high')))::DOUBLE FROM r WHERE rn = 1
      UNION ALL SELECT 'consent_coverage_pct', round(v, 6) FROM cv UNION ALL SELECT 'audit_entries', count(*)::DOUBLE FROM events""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    """Budget, class size, detections, consent coverage and audit volume."""
    consents = table(spark, sf, "customer").select(
        (F.col("c_acctbal") > 0).alias("consent_given"), F.lit("1996-01-01 00:00:00").cast("timestamp").alias("consent_timestamp"), (F.col("c_custkey") % 900).alias("retention_period_days")
    )
    out = reports.compliance_indicators(
        ledger.summary(release_ledger(spark, sf), 10.0), profile.equivalence_classes(table(spark, sf, "customer"), ["c_nationkey", "c_mktsegment"]),
        profile.detect(contact_table(spark, sf)), consents, audit_events(spark, sf), F.lit("1997-01-01 00:00:00").cast("timestamp"),
    )
    return rounded(out)


@query("alert_stream", f"{KN}, {SPIKE_SQL} SELECT round, alert_id, severity, confidence FROM a2")
def _(spark: SparkSession, sf: str) -> DataFrame:
    """Institutions' reports of a round arrive in two parts over several files; a round is tested once it is whole."""
    parts = round_base(spark, sf).groupBy("round", "bank_id", F.pmod(F.xxhash64("p_type"), F.lit(2)).alias("part")).agg(
        F.sum("n").alias("num_samples"), F.sum(F.when(F.col("is_fraud"), F.col("n")).otherwise(0)).alias("num_fraud")
    )
    expected = parts.groupBy("round").agg(F.count(F.lit(1)).alias("n_expected"))
    month = F.make_timestamp(F.expr("(round - 1) div 12"), F.pmod(F.col("round") - 1, F.lit(12)) + 1, F.lit(1), F.lit(0), F.lit(0), F.lit(0))
    reports = materialize(parts.join(expected, "round").withColumn("event_time", month), "reports")
    src, n = _in_turn(reports, _dealt(F.concat_ws("/", "bank_id", "part", "round"), 3), "spikes-in")
    out, cp = durable_dir(spark, "spikes"), durable_dir(spark, "spikes-checkpoint")
    # reports of all years are mixed in the files, so that none is late
    whole = state.whole_rounds(jobs.read_parquet_stream(spark, src, reports.schema, files_per_trigger=n), delay="3650 days")
    jobs.each_batch(whole, jobs.batch_writer(alerts.fraud_rate_spikes, out), cp).awaitTermination()
    return rounded(spark.read.parquet(out).select("round", "alert_id", "severity", "confidence"))


# the documented rules over events whose time runs sixty times as fast; a view stands for ten requests a unit of value
_FAST_SQL = """ev AS (SELECT make_timestamp(1704067200000000 + (epoch_us(ts) - 1704067200000000) // 60) AS t, user_id % 4 AS actor,
    CASE event_type WHEN 'error' THEN 'login_failure' WHEN 'view' THEN 'request' WHEN 'purchase' THEN 'export_request' WHEN 'signup' THEN 'access_denied' END AS event,
    CASE event_type WHEN 'view' THEN floor(value)::BIGINT * 10 ELSE 1 END AS weight FROM events),
  ru AS (SELECT * FROM (VALUES ('brute_force', 'login_failure', 300, 60, 5), ('api_abuse', 'request', 60, 30, 1000), ('data_exfiltration', 'export_request', 3600, 600, 10),
    ('privilege_escalation', 'access_denied', 3600, 600, 3)) AS r(rule, event, len, slide, more)),
  wi AS (SELECT rule, actor, more, len, weight, (epoch_us(t) // (slide * 1000000)) * slide - k * slide AS s FROM ev JOIN ru USING (event), unnest(range(0, 60)) AS u(k) WHERE k * slide < len),
  al AS (SELECT rule, actor, make_timestamp(s * 1000000) AS window_start, make_timestamp((s + len) * 1000000) AS window_end, sum(weight)::BIGINT AS n, max(more) AS more FROM wi GROUP BY rule, actor, s, len)"""


def _fast_events(spark: SparkSession, sf: str) -> DataFrame:
    start = 1_704_067_200_000_000
    t = F.timestamp_micros(F.expr(f"{start} + (unix_micros(CAST(ts AS TIMESTAMP)) - {start}) div 60"))
    kinds = {"error": "login_failure", "view": "request", "purchase": "export_request", "signup": "access_denied"}
    event = F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair])[F.col("event_type")]
    weight = F.when(F.col("event_type") == "view", F.floor("value") * 10).otherwise(1)
    return table(spark, sf, "events").select("ts", t.alias("t"), (F.col("user_id") % 4).alias("actor"), event.alias("event"), weight.alias("weight"))


def _alert_rows(df: DataFrame) -> DataFrame:
    return df.select("rule", "actor", *[F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) for c in ("window_start", "window_end")], "n")


@query("rule_alerts_batch", f"WITH {_FAST_SQL} SELECT rule, {_SHOW} FROM al WHERE n > more")
def _(spark: SparkSession, sf: str) -> DataFrame:
    """All documented rules, joined to the events as a table, in one plan."""
    return _alert_rows(rules.rule_alerts(_fast_events(spark, sf), rules.rule_table(spark), "t", "actor", "event", "weight"))


@query("rule_alerts_stream", f"WITH {_FAST_SQL} SELECT rule, {_SHOW} FROM al WHERE n > more AND window_end <= (SELECT max(window_end) - INTERVAL 1 HOUR - INTERVAL 10 MINUTE FROM al)")
def _(spark: SparkSession, sf: str) -> DataFrame:
    """The same rules on a stream of three files, one a trigger; a window is written once the watermark has passed it."""
    events = _fast_events(spark, sf)
    day = F.dayofmonth(F.col("ts").cast("timestamp"))
    src, n = _in_turn(events, [day <= 10, (day > 10) & (day <= 20), day > 20], "rules-in")
    found = rules.rule_alerts(jobs.read_parquet_stream(spark, src, events.schema, files_per_trigger=n), rules.rule_table(spark), "t", "actor", "event", "weight", "10 minutes")
    out, cp = durable_dir(spark, "rules"), durable_dir(spark, "rules-checkpoint")
    jobs.to_parquet(found, out, cp).awaitTermination()
    return _alert_rows(spark.read.schema(found.schema).parquet(out))


@query(
    "compliance_alerts_stream",
    """SELECT CASE WHEN c_acctbal <= 0 THEN 'privacy_budget_exhausted' ELSE 'privacy_budget_low' END AS rule, CASE WHEN c_acctbal <= 0 THEN 'critical' ELSE 'warning' END AS severity, c_custkey::VARCHAR AS subject
        FROM customer WHERE c_acctbal / 1000 < 0.2
      UNION ALL SELECT 'consent_expiring', 'info', o_orderkey::VARCHAR FROM orders WHERE o_orderdate > TIMESTAMP '1998-01-01' AND o_orderdate < TIMESTAMP '1998-01-31'
      UNION ALL SELECT DISTINCT 'k_anonymity_violation', 'critical', l_suppkey::VARCHAR FROM (SELECT l_suppkey, l_returnflag, l_linestatus, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL) WHERE n < 5
      UNION ALL SELECT 'audit_integrity_failure', 'critical', user_id::VARCHAR FROM events GROUP BY user_id HAVING bool_or(event_type = 'error')""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    """Budget, class sizes, consents and audit sessions as one stream of alerts; every file comes twice, every alert once."""
    as_of = F.lit("1998-01-01 00:00:00").cast("timestamp")
    sources = {
        "ledger": table(spark, sf, "customer").select(F.col("c_custkey").alias("account"), (F.col("c_acctbal") / 1000).alias("remaining_epsilon")),
        "consents": table(spark, sf, "orders").select(F.col("o_orderkey").alias("subject"), F.col("o_orderdate").cast("timestamp").alias("expires_at")),
        "certificates": table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("table_name"), "l_returnflag", "l_linestatus", "l_linenumber").agg(F.count(F.lit(1)).alias("k_anonymity")),
        "chain": table(spark, sf, "events").groupBy(F.col("user_id").alias("session_id")).agg(F.bool_or(F.col("event_type") == "error").alias("broken")),
    }
    streams = {}
    for name, df in sources.items():
        src, n = _in_turn(df, [F.lit(True), F.lit(True)], f"compliance-{name}")  # the second file replays the first
        streams[name] = jobs.read_parquet_stream(spark, src, df.schema, files_per_trigger=n)
    found = rules.once(jobs.compliance_alerts(**streams, as_of=as_of).withColumn("event_time", as_of))
    out, cp = durable_dir(spark, "compliance"), durable_dir(spark, "compliance-checkpoint")
    jobs.to_parquet(found, out, cp).awaitTermination()
    return spark.read.schema(found.schema).parquet(out).drop("event_time")


@query("client_vector_stream", "SELECT (vec_id // 50)::BIGINT AS round, count(*) AS n_clients FROM embeddings GROUP BY 1")
def _(spark: SparkSession, sf: str) -> DataFrame:
    """Client updates arriving as files, counted per round in each micro-batch."""
    out, cp = durable_dir(spark, "vectors"), durable_dir(spark, "vectors-checkpoint")
    s = _stream(spark, sf, "embeddings").select(F.floor(F.col("vec_id") / 50).alias("round"), "vec_id")
    jobs.each_batch(s, jobs.batch_writer(lambda b: b.groupBy("round").agg(F.count(F.lit(1)).alias("n_clients")), out), cp).awaitTermination()
    return spark.read.parquet(out).groupBy("round").agg(F.sum("n_clients").alias("n_clients"))
