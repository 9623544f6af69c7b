"""Derived features of the three fraud tables and per-account velocity features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerveil.plans.ranking import exact_quantiles, ordered_prefix, with_hot_totals, with_totals
from ledgerveil.session import materialize

# --- fixed values -------------------------------------------------------------------
NIGHT_HOURS_CARD = [0, 1, 2, 3, 4, 5, 22, 23]
NIGHT_HOURS_PAYMENT = [0, 1, 2, 3, 4, 5]
AMOUNT_BREAKS = [10, 50, 100, 500, 1000]
AMOUNT_LABELS = ["0-10", "10-50", "50-100", "100-500", "500-1000", "1000+"]
PAYMENT_TYPES = ["CASH_IN", "CASH_OUT", "DEBIT", "PAYMENT", "TRANSFER"]
# --------------------------------------------------------------------------------------

_HOUR = 3_600_000_000
_DAY = 24 * _HOUR


def account_application_features(df: DataFrame) -> DataFrame:
    """Ratios and flags of bank-account applications (canonical column names)."""
    p95 = exact_quantiles(df.select(F.col("velocity_6h").cast("double").alias("v")), [], "v", {"_p95": 0.95})
    d = lambda c: F.col(c).cast("double")
    return (
        with_totals(df, p95, [])
        .withColumns(
            {
                "velocity_ratio_6h_24h": d("velocity_6h") / (d("velocity_24h") + F.lit(1e-6)),
                "velocity_ratio_24h_4w": d("velocity_24h") / (d("velocity_4w") + F.lit(1e-6)),
                "address_stability": d("address_months") / (d("prev_address_months_count") + 1),
                "email_risk_score": d("dob_distinct_emails_4w") * (1 - d("name_email_similarity")),
                "device_risk_score": d("device_distinct_emails_8w") + d("device_fraud_count") * 10,
                "is_high_velocity": F.col("velocity_6h") > F.col("_p95"),
                "is_new_customer": F.col("bank_months") < 3,
                "credit_request_ratio": d("intended_balance_amount") / (d("proposed_credit_limit") + 1),
            }
        )
        .drop("_p95")
    )


def amount_bin(amount: Column) -> Column:
    """Right-closed amount bins; zero and below have no bin."""
    out = F.when(amount.isNull() | (amount <= 0), F.lit(None).cast("string"))
    for edge, label in zip(AMOUNT_BREAKS, AMOUNT_LABELS):
        out = out.when(amount <= edge, F.lit(label))
    return out.otherwise(F.lit(AMOUNT_LABELS[-1]))


def card_features(df: DataFrame, components: list[str] | None = None) -> DataFrame:
    """Features of card transactions: log amount, global z-score, time of day, bins, component sums."""
    components = components if components is not None else [f"V{i}" for i in range(1, 29)]
    stats = df.agg(F.avg("amount").alias("_mean"), F.stddev_samp("amount").alias("_std"))
    p99 = exact_quantiles(df.select(F.col("amount").alias("v")), [], "v", {"_p99": 0.99})
    hour = F.pmod(F.floor(F.col("time_seconds") / 3600), F.lit(24))
    out = with_totals(with_totals(df, stats, []), p99, []).withColumns(
        {
            "amount_log": F.log1p("amount"),
            "amount_zscore": (F.col("amount") - F.col("_mean")) / F.col("_std"),
            "hour_of_day": hour,
            "is_night": hour.isin(NIGHT_HOURS_CARD),
            "is_high_amount": F.col("amount") > F.col("_p99"),
            "amount_bin": amount_bin(F.col("amount")),
        }
    )
    if len(components) >= 2:
        out = out.withColumn("v1_v2_ratio", F.col(components[0]) / (F.col(components[1]) + F.lit(1e-6)))
    if components:
        total = F.abs(F.col(components[0]))
        for c in components[1:]:
            total = total + F.abs(F.col(c))
        out = out.withColumn("v_sum_abs", total)
    return out.drop("_mean", "_std", "_p99")


def payment_features(df: DataFrame) -> DataFrame:
    """Features of mobile payments: balance movements, drains, clock, type code, rule flags."""
    before, after = F.col("balance_orig_before"), F.col("balance_orig_after")
    kind, amount = F.col("transaction_type"), F.col("amount")
    drain = (before > 0) & (after == 0)
    hour = F.pmod(F.col("step"), F.lit(24))
    code = F.lit(None).cast("int")
    for i, name in enumerate(PAYMENT_TYPES):
        code = F.when(kind == name, F.lit(i)).otherwise(code)
    return df.withColumns(
        {
            "balance_change_orig": before - after,
            "balance_change_dest": F.col("balance_dest_after") - F.col("balance_dest_before"),
            "balance_ratio_orig": after / (before + 1),
            "is_zero_balance_after": after == 0,
            "is_full_drain": drain,
            "amount_log": F.log1p(amount),
            "amount_to_balance_ratio": amount / (before + 1),
            "is_exact_balance": amount == before,
            "is_transfer_then_cashout": kind == "TRANSFER",
            "hour_of_day": hour,
            "day_of_week": F.pmod(F.floor(F.col("step") / 24), F.lit(7)),
            "is_night_txn": hour.isin(NIGHT_HOURS_PAYMENT),
            "type_encoded": code,
            "fraud_pattern_1": (kind == "TRANSFER") & drain,
            "fraud_pattern_2": (amount > 200000) & (kind == "TRANSFER"),
        }
    )


def velocity_features(df: DataFrame, account: str, time: str, amount: str) -> DataFrame:
    """Add velocity_1h, velocity_24h and the running amount_zscore of each row's account.

    A sweep: an account's instants and, for each, the points just outside its look-back hour and day lie on one line, and
    one running count over ranges of (account, time) reaches them all. A velocity is the difference of two counts, so no
    account, the null account included, is held in one task. The z-score uses all rows up to and including the row's
    instant (population deviation), from running sums over distinct instants on the same line.
    """
    base = df.withColumn("_t", F.unix_micros(F.col(time).cast("timestamp")))
    n = F.count(amount)
    instants = base.groupBy(F.col(account).alias("_a"), "_t").agg(
        F.count(F.lit(1)).alias("_m"), n.alias("_n"), F.coalesce(F.avg(amount), F.lit(0.0)).alias("_mean"), F.coalesce(F.var_pop(amount) * n, F.lit(0.0)).alias("_within")
    )
    instants = materialize(instants, "instants")
    # amounts are taken relative to the account's own mean, so squares stay as small as the spread
    centre = instants.groupBy("_a").agg(F.try_divide(F.sum(F.col("_mean") * F.col("_n")), F.sum("_n")).alias("_c"), F.count(F.lit(1)).alias("_rows"))
    placed = with_hot_totals(instants, centre, ["_a"], "_rows").withColumn("_d", F.coalesce(F.col("_mean") - F.col("_c"), F.lit(0.0)))
    measures = ["_m", "_n", "_s", "_q"]
    own = F.struct(
        F.col("_t").alias("at"), F.col("_m"), F.col("_n"), (F.col("_d") * F.col("_n")).alias("_s"), (F.col("_within") + F.col("_n") * F.col("_d") * F.col("_d")).alias("_q"),
        F.lit(True).alias("now"), F.lit(False).alias("hour"), F.lit(False).alias("day"),
    )

    def before(length: int, hour: bool) -> Column:
        zero = F.lit(0).cast("long")
        return F.struct(
            (F.col("_t") - length - 1).alias("at"), zero.alias("_m"), zero.alias("_n"), F.lit(0.0).alias("_s"), F.lit(0.0).alias("_q"), F.lit(False).alias("now"), F.lit(hour).alias("hour"), F.lit(not hour).alias("day"),
        )

    points = placed.select("_a", F.explode(F.array(own, before(_HOUR, True), before(_DAY, False))).alias("p")).select("_a", "p.*")
    line = points.groupBy("_a", "at").agg(*[F.sum(c).alias(c) for c in measures], *[F.bool_or(c).alias(c) for c in ("now", "hour", "day")])
    run = ordered_prefix(line, ["_a"], "at", measures)
    # what each point says about an instant: about its own, and about those an hour and a day later
    said = F.array(
        F.when(F.col("now"), F.struct(F.col("at").alias("_t"), F.lit(0).alias("of"))),
        F.when(F.col("hour"), F.struct((F.col("at") + _HOUR + 1).alias("_t"), F.lit(1).alias("of"))),
        F.when(F.col("day"), F.struct((F.col("at") + _DAY + 1).alias("_t"), F.lit(2).alias("of"))),
    )
    told = run.select("_a", *[f"cum_{m}" for m in measures], F.explode(F.array_compact(said)).alias("w")).select("_a", "w._t", "w.of", *[f"cum_{m}" for m in measures])
    at = lambda c, of: F.max(F.when(F.col("of") == of, F.col(c)))
    each = told.groupBy("_a", "_t").agg(
        (at("cum__m", 0) - at("cum__m", 1)).alias("velocity_1h"), (at("cum__m", 0) - at("cum__m", 2)).alias("velocity_24h"),
        *[at(f"cum_{m}", 0).alias(f"cum_{m}") for m in ("_n", "_s", "_q")],
    )
    each = with_totals(each, placed.select("_a", "_t", "_c"), ["_a", "_t"])
    joined = with_totals(base.withColumn("_a", F.col(account)), each, ["_a", "_t"])  # null accounts are an account of their own
    mean = F.try_divide(F.col("cum__s"), F.col("cum__n"))
    square = F.try_divide(F.col("cum__q"), F.col("cum__n"))
    var = F.greatest(F.lit(0.0), square - mean * mean)
    spread = var > 1e-12 * square + 1e-24 * F.col("_c") * F.col("_c")  # beyond rounding of what was summed
    z = F.when(spread, (F.col(amount) - F.col("_c") - mean) / F.sqrt(var)).otherwise(F.lit(0.0))
    return joined.withColumn("amount_zscore", z).drop("_a", "_t", "_c", "cum__n", "cum__s", "cum__q")
