"""Splits, folds, partitions, balancing, class weights, velocity and card features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerveil.catalog.base import SCORED, query, rounded, scored
from ledgerveil.operators import features, split
from ledgerveil.sources.tables import table

_RANK = f"""WITH {SCORED}, r AS (SELECT *, row_number() OVER (PARTITION BY is_fraud ORDER BY md5('42:' || event_id), event_id) AS rn,
  count(*) OVER (PARTITION BY is_fraud) AS n FROM scored)"""
_ALL = f"""WITH {SCORED}, r AS (SELECT *, row_number() OVER (ORDER BY md5('42:' || event_id), event_id) AS rn, count(*) OVER () AS n FROM scored)"""
_SPLIT = "CASE WHEN rn <= floor(n * 0.7::DOUBLE) THEN 'train' WHEN rn <= floor(n * 0.85::DOUBLE) THEN 'val' ELSE 'test' END"


def _labelled(spark: SparkSession, sf: str) -> DataFrame:
    return scored(spark, sf).select("event_id", "is_fraud")


@query("stratified_split", f"{_RANK} SELECT event_id, is_fraud, {_SPLIT} AS split FROM r")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return split.stratified_split(_labelled(spark, sf), "is_fraud", ["event_id"])


@query("plain_split", f"{_ALL} SELECT event_id, is_fraud, {_SPLIT} AS split FROM r")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return split.stratified_split(_labelled(spark, sf), None, ["event_id"])


@query("split_summary", f"{_RANK} SELECT {_SPLIT} AS split, count(*) AS n_rows, round(avg(is_fraud::INT), 8) AS fraud_ratio FROM r GROUP BY 1")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(split.split_summary(split.stratified_split(_labelled(spark, sf), "is_fraud", ["event_id"]), "is_fraud"), 8)


@query("stratified_folds", f"{_RANK} SELECT event_id, is_fraud, ((rn - 1) % 5)::INT AS fold FROM r")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return split.kfold(_labelled(spark, sf), "is_fraud", ["event_id"])


@query("iid_partition", f"{_ALL} SELECT event_id, is_fraud, least(6, (rn - 1) // greatest(1, n // 7))::INT AS client_id FROM r")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return split.iid_partition(_labelled(spark, sf), ["event_id"], 7)


def _cuts_sql() -> str:
    arms = []
    for lab, cum in split.dirichlet_cuts([False, True], 5, 0.5, 42).items():
        inner = " ".join(f"WHEN rn <= floor(n * {c!r}::DOUBLE) THEN {i}" for i, c in enumerate(cum[:-1]))
        arms.append(f"WHEN is_fraud = {str(lab).lower()} THEN CASE {inner} ELSE 4 END")
    return f"CASE {' '.join(arms)} END"


@query("dirichlet_partition", f"{_RANK} SELECT event_id, is_fraud, {_cuts_sql()} AS client_id FROM r")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return split.dirichlet_partition(_labelled(spark, sf), "is_fraud", ["event_id"], 5)


@query("undersample_majority", f"{_RANK} SELECT event_id, is_fraud FROM r WHERE is_fraud OR rn <= floor((SELECT count(*) FROM scored WHERE is_fraud) * 1.5::DOUBLE)")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return split.undersample(_labelled(spark, sf), "is_fraud", ["event_id"], 1.5)


@query("development_sample", f"{_RANK} SELECT event_id, is_fraud FROM r WHERE rn <= greatest(1, 1000 * n // (SELECT count(*) FROM scored))")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return split.stratified_sample(_labelled(spark, sf), "is_fraud", ["event_id"], 1000)


_TSPLIT = """t AS (SELECT o_orderkey, o_orderdate, epoch(o_orderdate) AS s FROM orders), q AS (SELECT quantile_cont(s, 0.7) AS a, quantile_cont(s, 0.85) AS b FROM t),
  ts AS (SELECT o_orderkey, o_orderdate, CASE WHEN s <= a THEN 'train' WHEN s <= b THEN 'val' ELSE 'test' END AS split FROM t, q)"""


@query("temporal_split", f"WITH {_TSPLIT} SELECT o_orderkey, split FROM ts")
def _(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    return split.temporal_split(o, "o_orderdate").select("o_orderkey", "split")


@query(
    "split_leakage",
    f"""WITH {_TSPLIT} SELECT strftime(max(o_orderdate) FILTER (split = 'train'), '%Y-%m-%d') AS train_end, strftime(min(o_orderdate) FILTER (split = 'val'), '%Y-%m-%d') AS val_start,
      strftime(max(o_orderdate) FILTER (split = 'val'), '%Y-%m-%d') AS val_end, strftime(min(o_orderdate) FILTER (split = 'test'), '%Y-%m-%d') AS test_start, true AS clean FROM ts""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    out = split.leakage(split.temporal_split(o, "o_orderdate"), "o_orderdate")
    return out.select(*[F.date_format(c, "yyyy-MM-dd").alias(c) for c in ("train_end", "val_start", "val_end", "test_start")], "clean")


@query("class_weights", "SELECT event_type, count(*) AS n_label, round((SELECT count(*) FROM events) / ((SELECT count(DISTINCT event_type) FROM events) * count(*)), 8) AS weight FROM events GROUP BY 1")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(split.class_weights(table(spark, sf, "events").select("event_type"), "event_type"), 8)


@query(
    "imbalance_weights",
    f"""WITH {SCORED}, c AS (SELECT count(*) FILTER (is_fraud) AS pos, count(*) FILTER (NOT is_fraud) AS neg FROM scored)
      SELECT pos, neg, round(neg / pos, 8) AS scale_pos_weight, round((pos + neg) / (2 * neg), 8) AS weight_neg, round((pos + neg) / (2 * pos), 8) AS weight_pos FROM c""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(split.imbalance_weights(scored(spark, sf), "is_fraud"), 8)


# --- features ---------------------------------------------------------------------------------------

VELOCITY = """vel AS (SELECT event_id, user_id, ts, value,
  count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW) AS velocity_1h,
  count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 24 HOUR PRECEDING AND CURRENT ROW) AS velocity_24h,
  avg(value) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS m,
  stddev_pop(value) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS s FROM events)"""


@query("account_velocity", f"WITH {VELOCITY} SELECT event_id, velocity_1h, velocity_24h, round(CASE WHEN s > 3.2e-5 THEN (value - m) / s ELSE 0 END, 4) AS amount_zscore FROM vel")
def _(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select("event_id", "user_id", "ts", "value")
    return rounded(features.velocity_features(e, "user_id", "ts", "value").select("event_id", "velocity_1h", "velocity_24h", "amount_zscore"), 4)


@query(
    "card_features",
    """WITH c AS (SELECT event_id, value AS amount, floor(epoch(ts))::BIGINT AS t, value * 2 AS v1, value - 50 AS v2 FROM events),
      g AS (SELECT avg(amount) AS m, stddev_samp(amount) AS s, quantile_cont(amount, 0.99) AS p FROM c)
    SELECT event_id, round(ln(1 + amount), 6) AS amount_log, round((amount - m) / s, 6) AS amount_zscore, (t // 3600) % 24 AS hour_of_day,
      (t // 3600) % 24 IN (0,1,2,3,4,5,22,23) AS is_night, amount > p AS is_high_amount,
      CASE WHEN amount <= 0 THEN NULL WHEN amount <= 10 THEN '0-10' WHEN amount <= 50 THEN '10-50' WHEN amount <= 100 THEN '50-100' WHEN amount <= 500 THEN '100-500' WHEN amount <= 1000 THEN '500-1000' ELSE '1000+' END AS amount_bin,
      round(v1 / (v2 + 0.000001::DOUBLE), 4) AS v1_v2_ratio, round(abs(v1) + abs(v2), 6) AS v_sum_abs FROM c, g""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "events").select(
        "event_id", F.col("value").alias("amount"), F.unix_timestamp(F.col("ts").cast("timestamp")).alias("time_seconds"),
        (F.col("value") * 2).alias("V1"), (F.col("value") - 50).alias("V2"),
    )
    out = features.card_features(c, ["V1", "V2"]).drop("amount", "time_seconds", "V1", "V2")
    return rounded(rounded(out, 4, ["v1_v2_ratio"]), 6, ["amount_log", "amount_zscore", "v_sum_abs"])


@query(
    "application_features",
    """WITH a AS (SELECT o_orderkey, o_totalprice / 1000 AS velocity_6h, o_totalprice / 500 + o_custkey % 7 AS velocity_24h, o_totalprice / 100 AS velocity_4w,
        o_custkey % 100 AS address_months, o_custkey % 50 AS prev, o_orderkey % 5 AS emails, (o_custkey % 10) / 10 AS sim, o_orderkey % 3 AS dev, o_orderkey % 2 AS devf,
        o_custkey % 20 AS bank_months, o_totalprice AS bal, 1000.0::DOUBLE + o_custkey AS lim FROM orders), q AS (SELECT quantile_cont(velocity_6h, 0.95) AS p FROM a)
    SELECT o_orderkey, round(velocity_6h / (velocity_24h + 0.000001::DOUBLE), 6) AS velocity_ratio_6h_24h, round(velocity_24h / (velocity_4w + 0.000001::DOUBLE), 6) AS velocity_ratio_24h_4w,
      round(address_months / (prev + 1), 6) AS address_stability, round(emails * (1 - sim), 6) AS email_risk_score, (dev + devf * 10)::DOUBLE AS device_risk_score,
      velocity_6h > p AS is_high_velocity, bank_months < 3 AS is_new_customer, round(bal / (lim + 1), 6) AS credit_request_ratio FROM a, q""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    p, c, k = F.col("o_totalprice"), F.col("o_custkey"), F.col("o_orderkey")
    a = table(spark, sf, "orders").select(
        "o_orderkey", (p / 1000).alias("velocity_6h"), (p / 500 + c % 7).alias("velocity_24h"), (p / 100).alias("velocity_4w"), (c % 100).alias("address_months"),
        (c % 50).alias("prev_address_months_count"), (k % 5).alias("dob_distinct_emails_4w"), ((c % 10) / 10).alias("name_email_similarity"),
        (k % 3).alias("device_distinct_emails_8w"), (k % 2).alias("device_fraud_count"), (c % 20).alias("bank_months"), p.alias("intended_balance_amount"),
        (F.lit(1000.0) + c).alias("proposed_credit_limit"),
    )
    out = features.account_application_features(a).select(
        "o_orderkey", "velocity_ratio_6h_24h", "velocity_ratio_24h_4w", "address_stability", "email_risk_score", "device_risk_score", "is_high_velocity", "is_new_customer", "credit_request_ratio"
    )
    return rounded(out)
