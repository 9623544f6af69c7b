"""Cross-institution profiles, trends, risk and snapshots over all ingested rounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerveil.operators import alerts, library, mining
from ledgerveil.plans.ranking import ordered_prefix, with_totals
from ledgerveil.session import materialize

EMA_NEW = 0.3
IMPORTANCE_WINDOW = 50


def smoothed_rates(metrics: DataFrame) -> DataFrame:
    """(bank_id, avg_fraud_rate): r <- 0.7 r + 0.3 x over rounds from 0, nulls skipped.

    The recursion has the closed form sum of 0.3 * 0.7^(n - i) * x_i, so positions come
    from an exact running count and the rest is one aggregation per institution.
    """
    seen = metrics.where(F.col("fraud_rate").isNotNull()).select("bank_id", "round", "fraud_rate", F.lit(1).alias("one"))
    placed = ordered_prefix(seen, ["bank_id"], "round", ["one"])
    sizes = placed.groupBy("bank_id").agg(F.count(F.lit(1)).alias("n"))
    weight = F.lit(EMA_NEW) * F.pow(F.lit(1.0 - EMA_NEW), F.col("n") - F.col("cum_one"))
    return with_totals(placed, sizes, ["bank_id"]).groupBy("bank_id").agg(
        F.sum(weight * F.col("fraud_rate")).alias("avg_fraud_rate")
    )


def bank_profiles(metrics: DataFrame, registered: DataFrame | None = None) -> DataFrame:
    """One row per institution; institutions never seen before are added on the way."""
    sums = metrics.groupBy("bank_id").agg(
        F.sum(F.coalesce("num_samples", F.lit(0))).alias("total_transactions"),
        F.sum(F.coalesce("num_fraud", F.lit(0))).alias("total_fraud_flagged"),
        F.count(F.lit(1)).alias("rounds_participated"),
        F.max_by("accuracy", F.when(F.col("accuracy").isNotNull(), F.col("round"))).alias("model_accuracy"),
        F.max("round").alias("last_round"),
    )
    out = sums.join(smoothed_rates(metrics), "bank_id", "left")
    if registered is not None:
        out = registered.select("bank_id").join(out, "bank_id", "full")
    return out.select(
        "bank_id",
        *[F.coalesce(c, F.lit(0)).alias(c) for c in ("total_transactions", "total_fraud_flagged", "rounds_participated")],
        *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("model_accuracy", "avg_fraud_rate")],
        "last_round",
    )


def risk_scores(profiles: DataFrame) -> DataFrame:
    """(bank_id, risk_score) in [0, 1]: 60% relative fraud rate, 40% missing accuracy."""
    top = profiles.agg(F.max(F.when(F.col("avg_fraud_rate") > 0, F.col("avg_fraud_rate"))).alias("_max"))
    acc = F.when(F.col("model_accuracy") > 0, F.lit(1.0) - F.least(F.col("model_accuracy"), F.lit(1.0))).otherwise(0.5)
    risk = F.lit(0.6) * F.col("avg_fraud_rate") / (F.col("_max") + F.lit(1e-9)) + F.lit(0.4) * acc
    score = F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), risk)), 4)
    return with_totals(profiles, top, []).select("bank_id", F.coalesce(score, F.lit(0.5)).alias("risk_score"))


def feature_ranking(importances: DataFrame, top_n: int | None = 20, window: int = IMPORTANCE_WINDOW) -> DataFrame:
    """Features by the mean of their last ``window`` reports, with deviation and total reports.

    The per-feature limit is applied inside each partition before the shuffle.
    """
    w = Window.partitionBy("feature").orderBy(F.col("round").desc(), F.col("bank_id").desc())
    recent = importances.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= window)
    stats = recent.groupBy("feature").agg(
        F.round(F.avg("importance"), 6).alias("mean_importance"), F.round(F.stddev_pop("importance"), 6).alias("std")
    )
    totals = importances.groupBy("feature").agg(F.count(F.lit(1)).alias("observations"))
    out = stats.join(totals, "feature").select("feature", "mean_importance", "std", "observations")
    return out if top_n is None else out.orderBy(F.col("mean_importance").desc(), "feature").limit(top_n)


def global_statistics(profiles: DataFrame, rounds: DataFrame) -> DataFrame:
    """One row over all institutions."""
    positive = F.when(F.col("avg_fraud_rate") > 0, F.col("avg_fraud_rate"))
    p = profiles.agg(
        F.count(F.lit(1)).alias("total_banks"),
        F.count_if(F.col("rounds_participated") > 0).alias("active_banks"),
        F.coalesce(F.sum("total_transactions"), F.lit(0)).alias("total_transactions"),
        F.coalesce(F.sum("total_fraud_flagged"), F.lit(0)).alias("total_fraud_flagged"),
        F.round(F.coalesce(F.avg(positive), F.lit(0.0)), 6).alias("global_avg_fraud_rate"),
    )
    return with_totals(p, rounds.agg(F.count(F.lit(1)).alias("total_rounds")), [])


def round_history(metrics: DataFrame) -> DataFrame:
    """(round, banks_participated, global_accuracy, global_loss) from per-institution metrics."""
    return metrics.groupBy("round").agg(
        F.count(F.lit(1)).alias("banks_participated"),
        F.avg("accuracy").alias("global_accuracy"),
        F.avg("loss").alias("global_loss"),
    )


def trend(rounds: DataFrame, window: int = 10) -> DataFrame:
    """One row over the last ``window`` rounds: current, mean and direction."""
    recent = rounds.orderBy(F.col("round").desc()).limit(window)

    def last(c: str) -> Column:
        return F.max_by(c, "round")

    def first(c: str) -> Column:
        return F.min_by(c, "round")

    a = recent.agg(
        F.count(F.lit(1)).alias("rounds_analyzed"),
        F.round(last("global_accuracy"), 4).alias("accuracy_current"),
        F.round(F.avg("global_accuracy"), 4).alias("accuracy_mean"),
        F.when(last("global_accuracy") > first("global_accuracy"), "improving").otherwise("declining").alias("accuracy_direction"),
        F.round(last("global_loss"), 4).alias("loss_current"),
        F.round(F.avg("global_loss"), 4).alias("loss_mean"),
        F.when(last("global_loss") < first("global_loss"), "improving").otherwise("worsening").alias("loss_direction"),
        last("banks_participated").alias("participation_current"),
        F.round(F.avg("banks_participated"), 1).alias("participation_mean"),
    )
    enough = F.col("rounds_analyzed") >= 2
    return a.withColumn("message", F.when(enough, F.lit("ok")).otherwise(F.lit("Insufficient data for trend analysis")))


def snapshot(
    version: int, as_of: str, library_stats: DataFrame, global_stats: DataFrame, ranking: DataFrame, rounds: DataFrame
) -> DataFrame:
    """One row to append to a snapshot table."""
    top = ranking.orderBy(F.col("mean_importance").desc(), "feature").limit(5)
    vectors = top.agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct((-F.col("mean_importance")).alias("o"), "feature", "mean_importance"))),
            lambda s: F.struct(s["feature"].alias("feature"), s["mean_importance"].alias("importance")),
        ).alias("top_attack_vectors")
    )
    acc = rounds.agg(F.coalesce(F.max_by("global_accuracy", "round"), F.lit(0.0)).alias("accuracy"))
    j = with_totals(with_totals(with_totals(global_stats, library_stats, []), vectors, []), acc, [])
    return j.select(
        F.lit(version).alias("version"),
        F.lit(as_of).cast("timestamp").alias("created_at"),
        F.col("total").alias("total_patterns"),
        F.col("total_banks").alias("bank_count"),
        F.col("global_avg_fraud_rate").alias("global_fraud_rate"),
        "top_attack_vectors",
        "accuracy",
    )


def top_banks(profiles: DataFrame, k: int = 10) -> DataFrame:
    """Institutions with a positive rate, highest first, as percentages."""
    return (
        profiles.where(F.col("avg_fraud_rate") > 0)
        .orderBy(F.col("avg_fraud_rate").desc(), "bank_id")
        .limit(k)
        .select(
            "bank_id",
            F.round(F.col("avg_fraud_rate") * 100, 2).alias("fraud_rate_pct"),
            F.round(F.col("model_accuracy") * 100, 2).alias("accuracy_pct"),
        )
    )


def ingest(
    importances: DataFrame, metrics: DataFrame, store: DataFrame, as_of: Column, dp_noise_scale: float = 0.1,
    seed: int | None = None,
) -> dict[str, DataFrame]:
    """All results of new rounds: profiles, mined patterns, alerts and the next library snapshot.

    The mined patterns are written once; both the result and the snapshot read them.
    """
    noised = mining.divergence_patterns(importances, dp_noise_scale, seed).unionByName(mining.fraud_rate_anomalies(metrics))
    mined = materialize(mining.mine(importances, metrics), "mined")
    entries = library.as_entries(mining.to_entries(noised.unionByName(mined, allowMissingColumns=True)), as_of)
    nxt = library.promote(library.upsert(store, entries, as_of), as_of)
    return {
        "profiles": bank_profiles(metrics),
        "patterns": mined,
        "alerts": alerts.analyze(importances, metrics),
        "library": nxt,
    }
