"""Scans, sources, sinks, projections, filters, set operations."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerveil.catalog.base import SCORED, TX, query, rounded, scored, transactions
from ledgerveil.functions import hashing
from ledgerveil.operators import audit, erasure, models, profile, validate
from ledgerveil.operators.split import sample_fraction
from ledgerveil.plans.ranking import with_totals
from ledgerveil.session import durable_dir
from ledgerveil.sources import fraud, tables, uploads
from ledgerveil.sources.tables import table

# --- CSV loaders on files derived from the tables ------------------------------------------------


def _bank_csv(spark: SparkSession, sf: str) -> str:
    """customer written as two application files with differing columns."""
    c = table(spark, sf, "customer")
    folder = durable_dir(spark, "applications")
    base = c.select(
        (F.col("c_custkey") % 10 == 0).cast("int").alias("fraud_bool"),
        F.round(F.col("c_acctbal") / 10000, 4).alias("income"),
        (F.col("c_custkey") % 60 + 18).cast("int").alias("customer_age"),
        F.col("c_mktsegment").alias("payment_type"),
        F.col("c_acctbal").alias("intended_balcon_amount"),
        (F.col("c_custkey") % 8).cast("int").alias("month"),
    )
    odd = F.col("month") % 2 == 1
    base.where(~odd).write.option("header", True).csv(os.path.join(folder, "Base.csv"))
    base.where(odd).drop("payment_type").withColumn("device_os", F.lit("linux")).write.option("header", True).csv(
        os.path.join(folder, "Variant II.csv")
    )
    return folder


@query(
    "load_bank_applications",
    """
    WITH a AS (SELECT c_custkey % 10 = 0 AS is_fraud, round(c_acctbal / 10000, 4) AS income, (c_custkey % 60 + 18)::INT AS customer_age,
      c_mktsegment AS payment_type, c_acctbal AS intended_balance_amount, (c_custkey % 8)::INT AS month FROM customer)
    SELECT is_fraud, income, customer_age, CASE WHEN month % 2 = 0 THEN payment_type END AS payment_type,
      intended_balance_amount, month, CASE WHEN month % 2 = 0 THEN 'Base' ELSE 'VII' END AS variant,
      CASE WHEN month % 2 = 1 THEN 'linux' END AS device_os, 'bank_account_fraud' AS dataset_source FROM a
    """,
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return fraud.load_bank_applications(spark, _bank_csv(spark, sf))


@query(
    "load_card_transactions",
    """
    SELECT floor(epoch(ts))::BIGINT % 172800 + 0.0::DOUBLE AS time_seconds, value / 2 AS "V1", -value AS "V2", value AS amount,
      event_type = 'error' AS is_fraud, 'credit_card_fraud' AS dataset_source FROM events
    """,
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    folder = durable_dir(spark, "cards")
    secs = F.unix_timestamp(F.col("ts").cast("timestamp")) % 172800
    table(spark, sf, "events").select(
        secs.alias("Time"), (F.col("value") / 2).alias("V1"), (-F.col("value")).alias("V2"), F.col("value").alias("Amount"),
        (F.col("event_type") == "error").cast("int").alias("Class"),
    ).write.option("header", True).csv(os.path.join(folder, "creditcard.csv"))
    return fraud.load_card_transactions(spark, folder)


def _payments_csv(spark: SparkSession, sf: str) -> str:
    """events written as a file of mobile payments."""
    folder = durable_dir(spark, "payments")
    kinds = F.element_at(F.array(*[F.lit(k) for k in ("CASH_IN", "CASH_OUT", "DEBIT", "PAYMENT", "TRANSFER")]), (F.col("event_id") % 5 + 1).cast("int"))
    before = F.round(F.col("value") * (F.col("event_id") % 3), 2)
    table(spark, sf, "events").select(
        (F.col("event_id") % 744).cast("int").alias("step"), kinds.alias("type"), F.col("value").alias("amount"),
        F.concat(F.lit("C"), F.col("user_id").cast("string")).alias("nameOrig"), before.alias("oldbalanceOrg"),
        F.greatest(F.lit(0.0), F.round(before - F.col("value"), 2)).alias("newbalanceOrig"),
        F.concat(F.lit("M"), (F.col("user_id") % 17).cast("string")).alias("nameDest"), F.lit(0.0).alias("oldbalanceDest"),
        F.col("value").alias("newbalanceDest"), (F.col("event_type") == "error").cast("int").alias("isFraud"), F.lit(0).alias("isFlaggedFraud"),
    ).write.option("header", True).csv(os.path.join(folder, "PS_derived.csv"))
    return folder


def _payments(spark: SparkSession, sf: str) -> DataFrame:
    """events as mobile payments, read back through the loader."""
    return fraud.load_mobile_payments(spark, _payments_csv(spark, sf))


@query("load_all_datasets", "SELECT 'bank_account_fraud' AS dataset_source, count(*) AS n_rows FROM customer UNION ALL SELECT 'paysim', count(*) FROM events")
def _(spark: SparkSession, sf: str) -> DataFrame:
    """The data sets that exist, loaded by one call; the one whose folder is missing is left out."""
    folders = {"bank_account_fraud": _bank_csv(spark, sf), "credit_card_fraud": durable_dir(spark, "missing"), "paysim": _payments_csv(spark, sf)}
    loaded = fraud.load_all(spark, folders)
    counts = [df.groupBy("dataset_source").agg(F.count(F.lit(1)).alias("n_rows")) for df in loaded.values()]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


_PAY = """pay AS (
  SELECT (event_id % 744)::INT AS step, ['CASH_IN','CASH_OUT','DEBIT','PAYMENT','TRANSFER'][(event_id % 5 + 1)::INT] AS transaction_type,
    value AS amount, round(value * (event_id % 3), 2) AS balance_orig_before,
    greatest(0.0::DOUBLE, round(round(value * (event_id % 3), 2) - value, 2)) AS balance_orig_after,
    0.0::DOUBLE AS balance_dest_before, value AS balance_dest_after, event_type = 'error' AS is_fraud, 0 AS is_flagged_fraud,
    'paysim' AS dataset_source, substr(sha256('C' || user_id), 1, 16) AS account_orig_hash,
    substr(sha256('M' || (user_id % 17)), 1, 16) AS account_dest_hash FROM events)"""


@query("load_mobile_payments", f"WITH {_PAY} SELECT * FROM pay")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return _payments(spark, sf)


@query(
    "payment_features",
    f"""WITH {_PAY} SELECT account_orig_hash, step, amount,
      round(balance_orig_before - balance_orig_after, 4) AS balance_change_orig, round(balance_dest_after - balance_dest_before, 4) AS balance_change_dest,
      round(balance_orig_after / (balance_orig_before + 1), 6) AS balance_ratio_orig, balance_orig_after = 0 AS is_zero_balance_after,
      balance_orig_before > 0 AND balance_orig_after = 0 AS is_full_drain, round(ln(1 + amount), 6) AS amount_log,
      round(amount / (balance_orig_before + 1), 6) AS amount_to_balance_ratio, amount = balance_orig_before AS is_exact_balance,
      step % 24 AS hour_of_day, (step // 24) % 7 AS day_of_week, step % 24 IN (0,1,2,3,4,5) AS is_night_txn,
      list_position(['CASH_IN','CASH_OUT','DEBIT','PAYMENT','TRANSFER'], transaction_type) - 1 AS type_encoded,
      transaction_type = 'TRANSFER' AND balance_orig_before > 0 AND balance_orig_after = 0 AS fraud_pattern_1,
      amount > 200000 AND transaction_type = 'TRANSFER' AS fraud_pattern_2 FROM pay""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    from ledgerveil.operators.features import payment_features

    f = payment_features(_payments(spark, sf)).select(
        "account_orig_hash", "step", "amount", "balance_change_orig", "balance_change_dest", "balance_ratio_orig", "is_zero_balance_after",
        "is_full_drain", "amount_log", "amount_to_balance_ratio", "is_exact_balance", "hour_of_day", "day_of_week", "is_night_txn",
        "type_encoded", "fraud_pattern_1", "fraud_pattern_2",
    )
    f = rounded(f, 4, ["balance_change_orig", "balance_change_dest"])
    return rounded(f, 6, ["balance_ratio_orig", "amount_log", "amount_to_balance_ratio"])


@query(
    "unified_transactions",
    f"""WITH {_PAY} SELECT substr(sha256(account_orig_hash || '|' || step), 1, 16) AS transaction_id, step::DOUBLE AS time_value, amount,
      is_fraud, 'payment_fraud' AS fraud_type, dataset_source FROM pay""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return fraud.unify(_payments(spark, sf), "paysim")


@query(
    "unified_statistics",
    f"""WITH {_PAY}, a AS (SELECT count(*) AS n, count(*) FILTER (is_fraud) AS f, 12 AS k FROM pay
      UNION ALL SELECT count(*), count(*) FILTER (c_custkey % 10 = 0), 9 FROM customer)
    SELECT sum(n)::BIGINT AS total_rows, sum(f)::BIGINT AS total_fraud, round(sum(f) / sum(n), 8) AS overall_fraud_ratio,
      max(k)::BIGINT AS combined_features, count(*) AS n_datasets FROM a""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    pay = fraud.dataset_stats(_payments(spark, sf), "paysim")
    bank = fraud.dataset_stats(fraud.load_bank_applications(spark, _bank_csv(spark, sf)), "bank_account_fraud")
    return rounded(fraud.unified_stats(pay.unionByName(bank)), 8)


@query(
    "dataset_statistics",
    f"""WITH {TX} SELECT 'transactions' AS dataset, count(*) AS total_rows, count(*) FILTER (is_fraud) AS fraud_count,
      count(*) FILTER (NOT is_fraud) AS legit_count, round(count(*) FILTER (is_fraud) / count(*), 8) AS fraud_ratio, 3::BIGINT AS num_features,
      round(count(*) FILTER (NOT is_fraud) / count(*) FILTER (is_fraud), 8) AS imbalance_ratio FROM tx""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    t = transactions(spark, sf).select("bank_id", "l_extendedprice", "is_fraud")
    return rounded(fraud.dataset_stats(t, "transactions"), 8)


@query("account_hash", "SELECT c_custkey, CASE WHEN c_custkey % 9 = 0 OR c_custkey % 7 = 0 THEN '' ELSE substr(sha256(c_name), 1, 16) END AS account FROM customer")
def _(spark: SparkSession, sf: str) -> DataFrame:
    name = F.when(F.col("c_custkey") % 9 == 0, F.lit(None).cast("string")).when(F.col("c_custkey") % 7 == 0, F.lit("")).otherwise(F.col("c_name"))
    return table(spark, sf, "customer").select("c_custkey", hashing.account_hash(name).alias("account"))


_SQL_TEXT = """
SELECT c.c_mktsegment AS segment, o.o_orderpriority AS priority, count(*) AS n_orders, round(sum(o.o_totalprice), 2) AS total
FROM {orders} o JOIN {customer} c ON o.o_custkey = c.c_custkey
WHERE o.o_orderstatus <> 'P' GROUP BY c.c_mktsegment, o.o_orderpriority
"""


@query("sql_text", _SQL_TEXT.format(orders="orders", customer="customer"))
def _(spark: SparkSession, sf: str) -> DataFrame:
    return tables.query(spark, _SQL_TEXT, orders=table(spark, sf, "orders"), customer=table(spark, sf, "customer"))


_ASOF = """
SELECT o.o_orderkey, count(l.l_orderkey) AS n_lines, max(l.l_shipdate) IS NOT NULL AS shipped
FROM {orders} o LEFT JOIN {lineitem} l ON o.o_orderkey = l.l_orderkey AND l.l_shipdate >= o.o_orderdate
GROUP BY o.o_orderkey
"""


@query("sql_left_join", _ASOF.format(orders="orders", lineitem="lineitem"))
def _(spark: SparkSession, sf: str) -> DataFrame:
    return tables.query(spark, _ASOF, orders=table(spark, sf, "orders"), lineitem=table(spark, sf, "lineitem"))


@query("rescan_sanitised", "SELECT c_custkey, substr(sha256(c_name), 1, 16) AS c_name, c_nationkey FROM customer")
def _(spark: SparkSession, sf: str) -> DataFrame:
    clean = table(spark, sf, "customer").select("c_custkey", hashing.value_hash("c_name").alias("c_name"), "c_nationkey")
    folder = durable_dir(spark, "processed")
    tables.save(clean, folder, "customer_sanitized")
    return tables.load_sanitised(spark, folder, "customer")


@query(
    "table_description",
    """SELECT * FROM (VALUES (0, 'c_custkey', 'bigint'), (1, 'c_name', 'string'), (2, 'c_nationkey', 'int'), (3, 'c_acctbal', 'double'),
      (4, 'c_mktsegment', 'string')) t(ord, column_name, data_type), (SELECT count(*) AS n_rows FROM customer)""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return tables.describe(table(spark, sf, "customer"))


@query(
    "upload_ingest",
    f"WITH {TX} SELECT bank_id, count(*) AS n_rows, sum(is_fraud::INT)::BIGINT AS n_fraud, round(avg(is_fraud::INT), 8) AS fraud_rate FROM tx GROUP BY bank_id",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    t = transactions(spark, sf).select("bank_id", "l_extendedprice", F.col("is_fraud").cast("int").alias("isFraud"))
    return rounded(uploads.process_upload(t), 8)


@query(
    "upload_listing",
    """SELECT o_orderkey AS upload_id, o_custkey AS bank_id, o_orderstatus AS status, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders
      WHERE o_orderstatus = 'F' ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 50""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    log = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("upload_id"), F.col("o_custkey").alias("bank_id"), F.col("o_orderstatus").alias("status"), F.col("o_orderdate").alias("uploaded_at")
    )
    return uploads.list_uploads(log, status="F").select("upload_id", "bank_id", "status", F.date_format("uploaded_at", "yyyy-MM-dd").alias("day"))


@query("json_round_trip", "SELECT event_id, user_id, event_type, value FROM events")
def _(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select("event_id", "user_id", "event_type", "value")
    return tables.read_json(spark, tables.save(e, durable_dir(spark, "json"), "events", "json"), e.schema)


@query(
    "erase_subjects",
    """SELECT event_id, user_id, value FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'signup' AND value > 150)""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    asked = e.where((F.col("event_type") == "signup") & (F.col("value") > 150)).select("user_id")
    return validate.erase_subjects(e.select("event_id", "user_id", "value"), asked, "user_id")


def _erased(spark: SparkSession, sf: str) -> tuple[erasure.StoredTable, DataFrame, set, DataFrame]:
    """Orders stored in eight files by customer, after the erasure of some customers: (table, audit events, first files, requests)."""
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice").repartitionByRange(8, "o_custkey")
    stored = erasure.StoredTable.create(orders, os.path.join(durable_dir(spark, "erasure"), "orders"))
    first = {r["file"] for r in stored.files().collect()}
    asked = table(spark, sf, "customer").where("c_custkey <= 150 AND c_custkey % 25 = 7").select(F.col("c_custkey").alias("request"), F.col("c_custkey").alias("o_custkey"))
    asked = asked.unionByName(spark.createDataFrame([(-1, -1), (-2, None)], asked.schema))  # unknown subjects
    return stored, erasure.erase(stored, asked, "o_custkey", "request", "erasure-1", F.lit("2026-01-01 00:00:00")), first, asked


@query("erasure_rewrite", "SELECT o_orderkey, o_custkey, round(o_totalprice, 2) AS o_totalprice FROM orders WHERE NOT (o_custkey <= 150 AND o_custkey % 25 = 7)")
def _(spark: SparkSession, sf: str) -> DataFrame:
    """What the stored table holds after its files with requested subjects were rewritten."""
    stored, _, _, _ = _erased(spark, sf)
    return rounded(stored.read(), 2)


@query(
    "erasure_answers",
    """SELECT c_custkey AS request, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n_rows, true AS chain_holds, true AS others_untouched FROM customer WHERE c_custkey <= 150 AND c_custkey % 25 = 7
      UNION ALL SELECT unnest([-1, -2]), 0, true, true""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    """One audit event a request, the chain intact, and files without a requested subject still in place."""
    stored, events, first, asked = _erased(spark, sf)
    now = {r["file"] for r in stored.files().collect()}
    rows = stored.read(0).select("o_custkey", erasure.file_of(stored).alias("file")).join(asked.select("o_custkey").distinct(), "o_custkey", "left_semi")
    touched = {r["file"] for r in rows.select("file").distinct().collect()}
    untouched = first - touched <= now and not touched & now and 0 < len(touched) < len(first)
    said = F.from_json("details", "request string, rows long, files long")
    return events.select(said["request"].cast("long").alias("request"), said["rows"].alias("n_rows"), F.lit(audit.verify(events).isEmpty()).alias("chain_holds"), F.lit(untouched).alias("others_untouched"))


@query(
    "consent_filter",
    """WITH c AS (SELECT c_custkey AS o_custkey, c_acctbal > 0 AS given, TIMESTAMP '1996-01-01' + to_days((c_custkey % 400)::INT) AS given_at,
        CASE WHEN c_custkey % 11 = 0 THEN TIMESTAMP '1997-01-01' END AS withdrawn, 100 + c_custkey % 900 AS days, c_custkey % 5 <> 0 AS purpose FROM customer)
    SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_custkey IN (SELECT o_custkey FROM c WHERE given AND purpose
      AND given_at <= TIMESTAMP '1998-01-01' AND (withdrawn IS NULL OR withdrawn > TIMESTAMP '1998-01-01') AND given_at + to_days(days::INT) > TIMESTAMP '1998-01-01')""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    at = F.timestamp_seconds(F.unix_timestamp(F.lit("1996-01-01 00:00:00")) + (k % 400) * 86400)
    consents = table(spark, sf, "customer").select(
        k.alias("o_custkey"), (F.col("c_acctbal") > 0).alias("consent_given"), at.alias("consent_timestamp"),
        F.when(k % 11 == 0, F.lit("1997-01-01 00:00:00").cast("timestamp")).alias("withdrawal_timestamp"),
        F.when(k % 5 != 0, F.array(F.lit("model_training"), F.lit("risk_scoring"))).otherwise(F.array(F.lit("model_training"))).alias("processing_purposes"),
        (F.lit(100) + k % 900).alias("retention_period_days"),
    )
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return validate.with_valid_consent(orders, consents, "o_custkey", "risk_scoring", F.lit("1998-01-01 00:00:00").cast("timestamp")).select(
        "o_orderkey", "o_custkey", "o_totalprice"
    )


# --- projections and filters --------------------------------------------------------------------------


@query("sample_fraction")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return sample_fraction(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), ["o_orderkey"], 0.2)


@query("label_counts", f"WITH {SCORED} SELECT count(*) FILTER (is_fraud) AS n_fraud, count(*) FILTER (NOT is_fraud) AS n_legit FROM scored")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return scored(spark, sf).agg(F.count_if("is_fraud").alias("n_fraud"), F.count_if(~F.col("is_fraud")).alias("n_legit"))


@query(
    "prepared_features",
    """SELECT l_orderkey, l_linenumber::DOUBLE AS l_linenumber, CASE WHEN l_quantity > 40 THEN 0.0::DOUBLE ELSE l_quantity END AS l_quantity, l_extendedprice,
      CASE WHEN l_discount > 0.08::DOUBLE THEN 0.0::DOUBLE ELSE l_discount END AS l_discount, (l_returnflag = 'R')::INT::DOUBLE AS label FROM lineitem""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    line = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber",
        F.when(F.col("l_quantity") <= 40, F.col("l_quantity")).alias("l_quantity"), "l_extendedprice",
        F.when(F.col("l_discount") > 0.08, F.lit(float("nan"))).otherwise(F.col("l_discount")).alias("l_discount"),
        (F.col("l_returnflag") == "R").alias("is_fraud"), "l_returnflag",
    )
    return models.prepare(line, "is_fraud", exclude=["l_orderkey"], keep=["l_orderkey"])


@query("safe_projection", "SELECT c_custkey, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return profile.safe_projection(table(spark, sf, "customer"))


_RULES = [
    validate.Rule("l_quantity", minimum=5, maximum=45),
    validate.Rule("l_discount", maximum=0.09),
    validate.Rule("l_returnflag", allowed=("A", "R")),
    validate.Rule("l_shipdate", required=True),
]


@query(
    "validation_rules",
    """SELECT 'l_quantity min=5 max=45' AS rule, count(*) FILTER (l_quantity < 5 OR l_quantity > 45) AS n_violations, count(*) AS n_rows FROM lineitem
      UNION ALL SELECT 'l_discount max=0.09', count(*) FILTER (l_discount > 0.09::DOUBLE), count(*) FROM lineitem
      UNION ALL SELECT 'l_returnflag values', count(*) FILTER (l_returnflag NOT IN ('A', 'R')), count(*) FROM lineitem
      UNION ALL SELECT 'l_shipdate required', count(*) FILTER (l_shipdate IS NULL), count(*) FROM lineitem""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return validate.violations(table(spark, sf, "lineitem"), _RULES)


@query(
    "validation_quarantine",
    """SELECT l_returnflag, array_to_string(list_filter([CASE WHEN l_quantity < 5 OR l_quantity > 45 THEN 'l_quantity min=5 max=45' END,
        CASE WHEN l_discount > 0.09::DOUBLE THEN 'l_discount max=0.09' END, CASE WHEN l_returnflag NOT IN ('A','R') THEN 'l_returnflag values' END], lambda x: x IS NOT NULL), ',') AS broken,
        count(*) AS n FROM lineitem WHERE l_quantity < 5 OR l_quantity > 45 OR l_discount > 0.09::DOUBLE OR l_returnflag NOT IN ('A','R') GROUP BY ALL""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    _, bad = validate.quarantine(table(spark, sf, "lineitem"), _RULES)
    return bad.groupBy("l_returnflag", F.array_join("broken_rules", ",").alias("broken")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "missing_values",
    """WITH a AS (SELECT event_id, CASE WHEN event_id % 13 = 0 THEN NULL ELSE value END AS amount, CASE WHEN event_id % 5 = 0 THEN NULL ELSE value * 2 END AS other,
        CASE WHEN event_id % 7 = 0 THEN NULL ELSE event_type END AS kind FROM events),
      k AS (SELECT * FROM a WHERE amount IS NOT NULL),
      m AS (SELECT quantile_cont(other, 0.5) AS med, (SELECT kind FROM k WHERE kind IS NOT NULL GROUP BY kind ORDER BY count(*) DESC, kind LIMIT 1) AS mode FROM k)
    SELECT event_id, amount, round(coalesce(other, med), 6) AS other, coalesce(kind, mode) AS kind FROM k, m""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("event_id")
    a = table(spark, sf, "events").select(
        "event_id", F.when(i % 13 != 0, F.col("value")).alias("amount"), F.when(i % 5 != 0, F.col("value") * 2).alias("other"),
        F.when(i % 7 != 0, F.col("event_type")).alias("kind"),
    )
    return rounded(validate.impute(a, ["other", "kind"], critical=["amount"]), 6, ["other"])


@query(
    "schema_gate",
    """SELECT column_name, issue, (SELECT count(*) FROM customer) AS n_rows FROM (VALUES ('c_mktsegment', 'unknown column'), ('c_phone', 'missing required column'),
      ('c_acctbal', 'expected float, found double')) t(column_name, issue)""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    want = T.StructType(
        [T.StructField("c_custkey", T.LongType()), T.StructField("c_name", T.StringType()), T.StructField("c_nationkey", T.IntegerType()),
         T.StructField("c_acctbal", T.FloatType()), T.StructField("c_phone", T.StringType())]
    )
    c = table(spark, sf, "customer")
    return with_totals(validate.schema_gate(c, want, ["c_custkey", "c_phone"]), c.agg(F.count(F.lit(1)).alias("n_rows")), [])


# --- set operations --------------------------------------------------------------------------------------


@query(
    "relaxed_union",
    """SELECT c_custkey AS key, c_name AS name, c_nationkey::VARCHAR AS place, c_acctbal AS balance, c_mktsegment AS segment, NULL::INT AS active FROM customer
      UNION ALL SELECT s_suppkey, s_name, 'N' || s_nationkey, round(s_acctbal, 0), NULL, 1 FROM supplier""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("place"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment")
    )
    s = table(spark, sf, "supplier").select(
        F.col("s_suppkey").cast("int").alias("key"), F.col("s_name").alias("name"), F.concat(F.lit("N"), F.col("s_nationkey").cast("string")).alias("place"),
        F.round("s_acctbal", 0).cast("bigint").alias("balance"), F.lit(1).alias("active"),
    )
    return fraud.relaxed_union(c, s)
