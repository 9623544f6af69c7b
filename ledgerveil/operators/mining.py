"""Pattern mining over rounds of per-institution importances and metrics.

Inputs are long tables: importances (round, bank_id, feature, importance) and metrics
(round, bank_id, fraud_rate, ...). Every function handles all rounds of the input at once.
A feature an institution does not report counts as 0, which is arithmetic on sums and
institution counts; the dense institution x feature table is never built. The miners read
their inputs several times: pass stored tables, not long uncached plans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerveil.functions import noise
from ledgerveil.plans.ranking import with_totals
from ledgerveil.session import materialize

# thresholds are strict; a hair's breadth keeps exact ties out however sums were ordered
_EPS = 1e-9
BASELINE_LENGTH = 100

FOUND = [
    "round", "strategy", "pattern_id", "name", "pattern_type", "severity", "confidence", "observation_count",
    "source_bank_count", "feature", "signature", "attack_vector", "tags", "description",
]


def banks_per_round(importances: DataFrame) -> DataFrame:
    """(round, n_banks): institutions that reported anything, counted in two steps."""
    return importances.groupBy("round", "bank_id").agg(F.count(F.lit(1)).alias("_")).groupBy("round").agg(
        F.count(F.lit(1)).alias("n_banks")
    )


def feature_stats(importances: DataFrame) -> DataFrame:
    """(round, feature, n_banks, n_present, mean, std) with absent reports counted as 0."""
    sums = importances.groupBy("round", "feature").agg(
        F.sum("importance").alias("s"),
        F.var_pop("importance").alias("v"),
        F.count(F.lit(1)).alias("n_present"),
    )
    # the reports' own spread, merged with the absent institutions' zeros: no difference of large squares
    n, k = F.col("n_banks"), F.col("n_present")
    own = F.col("s") / k
    spread = F.col("v") * k / n + own * own * k * (n - k) / (n * n)
    return with_totals(sums, banks_per_round(importances), ["round"]).select(
        "round", "feature", "n_banks", "n_present", (F.col("s") / n).alias("mean"), F.sqrt(spread).alias("std"),
    )


def round_over_round(importances: DataFrame, stats: DataFrame | None = None) -> DataFrame:
    """(round, feature, n_banks, curr_mean, prev_mean) for rounds that have a predecessor.

    ``stats``: the result of feature_stats, when the caller already has it.
    """
    known = feature_stats(importances) if stats is None else stats
    stats = known.select("round", "feature", "mean")
    prev = stats.select((F.col("round") + 1).alias("round"), "feature", F.col("mean").alias("prev_mean"))
    both = stats.withColumnRenamed("mean", "curr_mean").join(prev, ["round", "feature"], "full")
    banks = known.groupBy("round").agg(F.max("n_banks").alias("n_banks"))
    has_prev = banks.select((F.col("round") + 1).alias("round"))
    rounds = banks.join(has_prev, "round", "left_semi")
    return with_totals(both, rounds, ["round"]).select(
        "round", "feature", "n_banks",
        F.coalesce("curr_mean", F.lit(0.0)).alias("curr_mean"),
        F.coalesce("prev_mean", F.lit(0.0)).alias("prev_mean"),
    )


def above(value: Column, bound: Column | float) -> Column:
    """value > bound, with equality up to rounding error counted as not above."""
    return value > bound * F.lit(1.0 + _EPS) if isinstance(bound, Column) else value > F.lit(bound * (1.0 + _EPS))


def _text(c: Column) -> Column:
    return c.cast("string")


def feature_deltas(
    importances: DataFrame, threshold: float = 0.3, minimum: float = 0.01, stats: DataFrame | None = None
) -> DataFrame:
    """Importance that moved by at least the threshold relative to max(previous, minimum)."""
    j = round_over_round(importances, stats)
    cur, prev = F.col("curr_mean"), F.col("prev_mean")
    delta = F.abs(cur - prev) / F.greatest(prev, F.lit(minimum))
    direction = F.when(cur > prev, F.lit("increased")).otherwise(F.lit("decreased"))
    found = j.where((prev >= minimum) | (cur >= minimum)).withColumn("d", delta).where(F.col("d") >= threshold)
    big = F.col("d") > 0.7
    return found.select(
        "round",
        F.lit(1).alias("strategy"),
        F.concat(F.lit("DELTA-R"), _text(F.col("round")), F.lit("-"), "feature").alias("pattern_id"),
        F.concat(F.lit("Feature Delta: "), "feature", F.lit(" ("), direction, F.lit(")")).alias("name"),
        F.when(big, "emergent").otherwise("variant").alias("pattern_type"),
        F.when(big, "high").otherwise("medium").alias("severity"),
        F.round(F.least(F.lit(0.9), F.lit(0.5) + F.col("d") * 0.3), 3).alias("confidence"),
        F.col("n_banks").alias("observation_count"),
        F.col("n_banks").alias("source_bank_count"),
        "feature",
        F.round(cur, 6).alias("signature"),
        F.lit("feature_delta").alias("attack_vector"),
        F.array(F.lit("delta"), direction, F.concat(F.lit("round-"), _text(F.col("round")))).alias("tags"),
        F.format_string(
            "Importance of %s %s by %.1f%% (from %.4f to %.4f) over %d institutions.",
            "feature", direction, F.col("d") * 100, prev, cur, "n_banks",
        ).alias("description"),
    )


def cross_bank_outliers(importances: DataFrame, z: float = 2.0, stats: DataFrame | None = None) -> DataFrame:
    """Features some institution weighs more than z deviations away from the mean (>= 3 institutions)."""
    stats = (feature_stats(importances) if stats is None else stats).where((F.col("n_banks") >= 3) & (F.col("std") >= 1e-6))
    away = above(F.abs(F.col("importance") - F.col("mean")), F.lit(z) * F.col("std"))
    present = (
        importances.join(stats.select("round", "feature", "mean", "std"), ["round", "feature"])
        .groupBy("round", "feature")
        .agg(F.count_if(away).alias("n_out"))
    )
    absent = F.when(above(F.col("mean"), F.lit(z) * F.col("std")), F.col("n_banks") - F.col("n_present")).otherwise(F.lit(0))
    found = (
        stats.join(present, ["round", "feature"]).withColumn("n_outliers", F.col("n_out") + absent).where("n_outliers > 0")
    )
    return found.select(
        "round",
        F.lit(2).alias("strategy"),
        F.concat(F.lit("OUTLIER-R"), _text(F.col("round")), F.lit("-"), "feature").alias("pattern_id"),
        F.concat(F.lit("Cross-Bank Outlier: "), "feature").alias("name"),
        F.lit("variant").alias("pattern_type"),
        F.lit("medium").alias("severity"),
        F.round(F.least(F.lit(0.8), F.lit(0.4) + F.col("n_outliers") * 0.1), 3).alias("confidence"),
        F.col("n_banks").alias("observation_count"),
        F.col("n_outliers").alias("source_bank_count"),
        "feature",
        F.round("mean", 6).alias("signature"),
        F.lit("cross_bank_outlier").alias("attack_vector"),
        F.array(F.lit("outlier"), F.col("feature"), F.concat(F.lit("round-"), _text(F.col("round")))).alias("tags"),
        F.format_string(
            "%d institutions weigh %s far from the mean %.4f.", "n_outliers", "feature", "mean"
        ).alias("description"),
    )


def baselines(importances: DataFrame, length: int = BASELINE_LENGTH) -> DataFrame:
    """(round, feature, baseline): mean of the last ``length`` reports before each round.

    Reports are ordered by round, then institution. Each (feature, round) first keeps its
    last ``length`` values; then one small row per round is carried along the feature.
    """
    last = Window.partitionBy("feature", "round").orderBy(F.col("bank_id").desc())
    kept = importances.withColumn("rn", F.row_number().over(last)).where(F.col("rn") <= length)
    per_round = kept.groupBy("feature", "round").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("bank_id", "importance"))), lambda s: s["importance"]).alias("v")
    )
    before = Window.partitionBy("feature").orderBy("round").rowsBetween(-length, -1)
    seen = F.flatten(F.collect_list("v").over(before))
    tail = F.slice(seen, F.greatest(F.lit(1), F.size(seen) - length + 1), F.lit(length))
    return per_round.select("round", "feature", tail.alias("t")).select(
        "round", "feature",
        F.when(F.size("t") > 0, F.aggregate("t", F.lit(0.0), lambda s, v: s + v) / F.size("t")).alias("baseline"),
    )


def feature_consensus(
    importances: DataFrame, minimum: float = 0.05, max_cv: float = 0.3, stats: DataFrame | None = None
) -> DataFrame:
    """Features all institutions agree on, unless the baseline already knows that level (>= 2 institutions)."""
    stats = (feature_stats(importances) if stats is None else stats).where(F.col("n_banks") >= 2)
    cv = F.col("std") / (F.col("mean") + F.lit(1e-9))
    cand = stats.withColumn("cv", cv).where(above(F.col("mean"), minimum) & (F.col("cv") < max_cv))
    known = F.col("baseline").isNotNull() & (F.abs(F.col("mean") - F.col("baseline")) < F.lit(0.1) * F.col("mean"))
    found = cand.join(baselines(importances), ["round", "feature"], "left").where(~known)
    return found.select(
        "round",
        F.lit(3).alias("strategy"),
        F.concat(F.lit("CONSENSUS-R"), _text(F.col("round")), F.lit("-"), "feature").alias("pattern_id"),
        F.concat(F.lit("Consensus Feature: "), "feature").alias("name"),
        F.lit("fact").alias("pattern_type"),
        F.lit("low").alias("severity"),
        F.round(F.least(F.lit(0.95), F.lit(0.7) + (F.lit(1.0) - F.col("cv")) * 0.2), 3).alias("confidence"),
        F.col("n_banks").alias("observation_count"),
        F.col("n_banks").alias("source_bank_count"),
        "feature",
        F.round("mean", 6).alias("signature"),
        F.lit("consensus").alias("attack_vector"),
        F.array(F.lit("consensus"), F.col("feature"), F.concat(F.lit("round-"), _text(F.col("round")))).alias("tags"),
        F.format_string(
            "%d institutions agree on %s (mean %.4f, variation %.3f).", "n_banks", "feature", "mean", "cv"
        ).alias("description"),
    )


def metric_stats(metrics: DataFrame) -> DataFrame:
    return metrics.groupBy("round").agg(
        F.avg(F.coalesce("fraud_rate", F.lit(0.0))).alias("mean_fr"),
        F.stddev_pop(F.coalesce("fraud_rate", F.lit(0.0))).alias("std_fr"),
        F.count(F.lit(1)).alias("n_metric_banks"),
    )


def combined_indicators(importances: DataFrame, metrics: DataFrame, high: float = 1.5, ratio: float = 2.0) -> DataFrame:
    """Features weighing more than twice as much where fraud is elevated (>= 3 institutions)."""
    stats = metric_stats(metrics).where(F.col("n_metric_banks") >= 3)
    flagged = with_totals(metrics.select("round", "bank_id", "fraud_rate"), stats, ["round"]).select(
        "round", "bank_id", above(F.coalesce("fraud_rate", F.lit(0.0)), F.col("mean_fr") * F.lit(high)).alias("is_high")
    )
    n_high = flagged.groupBy("round").agg(F.count_if("is_high").alias("n_high"))
    bank_rounds = importances.groupBy("round", "bank_id").agg(F.count(F.lit(1)).alias("_c")).drop("_c")
    sides = (
        bank_rounds.join(flagged, ["round", "bank_id"], "left")
        .groupBy("round")
        .agg(
            F.count_if(F.coalesce("is_high", F.lit(False))).alias("high_banks"),
            F.count_if(~F.coalesce("is_high", F.lit(False))).alias("low_banks"),
        )
    )
    hi = F.coalesce("is_high", F.lit(False))
    sums = (
        importances.join(flagged, ["round", "bank_id"], "left")
        .groupBy("round", "feature")
        .agg(
            F.coalesce(F.sum(F.when(hi, F.col("importance"))), F.lit(0.0)).alias("high_sum"),
            F.coalesce(F.sum(F.when(~hi, F.col("importance"))), F.lit(0.0)).alias("low_sum"),
        )
    )
    j = with_totals(with_totals(with_totals(sums, sides, ["round"]), n_high, ["round"]), stats, ["round"])
    hm, lm = F.col("high_sum") / F.col("high_banks"), F.col("low_sum") / F.col("low_banks")
    found = (
        j.where((F.col("high_banks") > 0) & (F.col("low_banks") > 0))
        .withColumns({"hm": hm, "r": hm / (lm + F.lit(1e-9))})
        .where(above(F.col("r"), ratio))
    )
    return found.select(
        "round",
        F.lit(4).alias("strategy"),
        F.concat(F.lit("COMBINED-R"), _text(F.col("round")), F.lit("-"), "feature").alias("pattern_id"),
        F.concat(F.lit("Fraud-Correlated Feature: "), "feature").alias("name"),
        F.lit("emergent").alias("pattern_type"),
        F.lit("high").alias("severity"),
        F.round(F.least(F.lit(0.9), F.lit(0.5) + (F.col("r") - 2) * 0.1), 3).alias("confidence"),
        F.col("n_metric_banks").alias("observation_count"),
        F.col("n_high").alias("source_bank_count"),
        "feature",
        F.round("hm", 6).alias("signature"),
        F.lit("combined").alias("attack_vector"),
        F.array(F.lit("combined"), F.col("feature"), F.concat(F.lit("round-"), _text(F.col("round")))).alias("tags"),
        F.format_string(
            "%s weighs %.1f times as much where fraud exceeds %.4f.", "feature", "r", F.col("mean_fr") * high
        ).alias("description"),
    )


def deduplicate(found: DataFrame) -> DataFrame:
    """First pattern per round and normalised name, in strategy order."""
    w = Window.partitionBy("round", F.lower(F.trim("name"))).orderBy("strategy", "pattern_id")
    return found.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")


def mine(importances: DataFrame, metrics: DataFrame, limit: int | None = None) -> DataFrame:
    """All four strategies, deduplicated; with a ``limit``, only each round's first patterns, as for a report.

    The statistics per (round, feature) are written once for the three miners that use them.
    """
    stats = materialize(feature_stats(importances), "feature-stats")
    found = (
        feature_deltas(importances, stats=stats)
        .unionByName(cross_bank_outliers(importances, stats=stats))
        .unionByName(feature_consensus(importances, stats=stats))
        .unionByName(combined_indicators(importances, metrics))
    )
    found = deduplicate(found).select(*FOUND)
    if limit is None:
        return found
    w = Window.partitionBy("round").orderBy("strategy", "pattern_id")
    return found.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= limit).select(*FOUND)


def run_summary(found: DataFrame, importances: DataFrame, metrics: DataFrame) -> DataFrame:
    """(round, patterns_discovered, features_analyzed, banks_analyzed)."""
    features = importances.groupBy("round", "feature").agg(F.count(F.lit(1)).alias("_")).groupBy("round").agg(
        F.count(F.lit(1)).alias("features_analyzed")
    )
    banks = metrics.groupBy("round").agg(F.count(F.lit(1)).alias("banks_analyzed"))
    hits = found.groupBy("round").agg(F.count(F.lit(1)).alias("patterns_discovered"))
    return features.join(banks, "round", "left").join(hits, "round", "left").select(
        "round",
        F.coalesce("patterns_discovered", F.lit(0)).alias("patterns_discovered"),
        "features_analyzed",
        F.coalesce("banks_analyzed", F.lit(0)).alias("banks_analyzed"),
    )


def to_entries(found: DataFrame) -> DataFrame:
    """Mined patterns with the columns of a library entry."""
    return found.select(
        "pattern_id", "name", "description", "pattern_type", "severity", "confidence", "observation_count",
        "source_bank_count",
        F.when(F.col("feature").isNotNull(), F.create_map("feature", "signature"))
        .otherwise(F.create_map().cast("map<string,double>"))
        .alias("feature_signature"),
        "attack_vector", "tags",
    )


# --- ingest of a round into the library ------------------------------------------------------


def divergence_patterns(importances: DataFrame, dp_noise_scale: float = 0.1, seed: int | None = None) -> DataFrame:
    """Features whose (noised, floored) importance diverges over the reporting institutions."""
    v = F.col("importance") if dp_noise_scale == 0 else F.col("importance") + noise.laplace(dp_noise_scale, seed)
    base = importances.withColumn("v", F.greatest(F.lit(0.0), v))
    stats = base.groupBy("round", "feature").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"))
    found = (
        with_totals(stats, banks_per_round(importances), ["round"])
        .where(above(F.col("mean"), 0.05))
        .where(above(F.col("std") / (F.col("mean") + F.lit(1e-9)), 0.3))
    )
    rnd = _text(F.col("round"))
    return found.select(
        "round",
        F.lit(0).alias("strategy"),
        F.concat(F.lit("PAT-FL-R"), rnd, F.lit("-"), "feature").alias("pattern_id"),
        F.concat(F.lit("FL Round "), rnd, F.lit(": "), "feature", F.lit(" divergence")).alias("name"),
        F.lit("emergent").alias("pattern_type"),
        F.when(above(F.col("mean"), 0.1), "high").otherwise("medium").alias("severity"),
        F.round(F.least(F.lit(0.95), F.col("mean") * 5), 3).alias("confidence"),
        F.col("n_banks").alias("observation_count"),
        F.col("n_banks").alias("source_bank_count"),
        "feature",
        F.round("mean", 6).alias("signature"),
        F.concat(F.lit("feature_divergence_"), "feature").alias("attack_vector"),
        F.array(F.lit("fl_round"), F.concat(F.lit("round_"), rnd), F.lit("auto_detected")).alias("tags"),
        F.format_string(
            "%s diverges over %d institutions (mean %.4f, deviation %.4f).", "feature", "n_banks", "mean", "std"
        ).alias("description"),
    )


def fraud_rate_anomalies(metrics: DataFrame) -> DataFrame:
    """Institutions whose fraud rate is more than two deviations from the round's mean."""
    j = with_totals(metrics, metric_stats(metrics), ["round"])
    fr = F.coalesce("fraud_rate", F.lit(0.0))
    gap = F.abs(fr - F.col("mean_fr"))
    found = j.where((F.col("std_fr") > 1e-12) & above(gap, 2 * F.col("std_fr")))
    rnd = _text(F.col("round"))
    return found.select(
        "round",
        F.lit(0).alias("strategy"),
        F.concat(F.lit("PAT-ANOM-R"), rnd, F.lit("-"), _text(F.col("bank_id"))).alias("pattern_id"),
        F.concat(F.lit("Anomalous fraud rate: Round "), rnd).alias("name"),
        F.lit("emergent").alias("pattern_type"),
        F.lit("critical").alias("severity"),
        F.round(F.least(F.lit(0.95), gap / (F.col("std_fr") + F.lit(1e-9)) * 0.3), 3).alias("confidence"),
        F.lit(1).cast("bigint").alias("observation_count"),
        F.lit(1).cast("bigint").alias("source_bank_count"),
        F.lit(None).cast("string").alias("feature"),
        F.lit(None).cast("double").alias("signature"),
        F.lit("").alias("attack_vector"),
        F.array(F.lit("anomaly"), F.concat(F.lit("round_"), rnd), F.lit("fraud_rate_spike")).alias("tags"),
        F.format_string("Fraud rate %.4f against a mean of %.4f.", fr, "mean_fr").alias("description"),
    )
