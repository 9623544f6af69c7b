"""Pattern mining, alerts, profiles, library and reports over monthly rounds of institutions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerveil.catalog.base import KN, both, importances, metrics, query, rounded
from ledgerveil.operators import alerts, central, library, mining, reports
from ledgerveil.session import durable_dir, materialize
from ledgerveil.sources import tables

_NB = "nb AS (SELECT round, count(DISTINCT bank_id) AS n_banks FROM imp GROUP BY 1)"
_FS = f"""{_NB}, fs AS (SELECT imp.round, feature, any_value(n_banks) AS n_banks, count(*) AS n_present, sum(importance) / any_value(n_banks) AS mean,
  sqrt(greatest(0, sum(importance * importance) / any_value(n_banks) - (sum(importance) / any_value(n_banks)) ** 2)) AS std
  FROM imp JOIN nb ON imp.round = nb.round GROUP BY 1, 2)"""
_RR = f"""{_FS}, rr AS (SELECT nb.round, feature, n_banks, coalesce(c, 0) AS curr_mean, coalesce(p, 0) AS prev_mean FROM
  (SELECT coalesce(a.round, b.round + 1) AS round, coalesce(a.feature, b.feature) AS feature, a.mean AS c, b.mean AS p FROM fs a FULL JOIN fs b ON a.round = b.round + 1 AND a.feature = b.feature) j
  JOIN nb ON nb.round = j.round WHERE nb.round - 1 IN (SELECT round FROM nb))"""
_MS = "ms AS (SELECT round, avg(fraud_rate) AS mean_fr, stddev_pop(fraud_rate) AS std_fr, count(*) AS k FROM met GROUP BY 1)"


@query("feature_statistics", f"{KN}, {_FS} SELECT round, feature, n_banks, n_present, round(mean, 8) AS mean, round(std, 6) AS std FROM fs")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(rounded(mining.feature_stats(importances(spark, sf)), 8, ["mean"]), 6, ["std"])


@query("round_over_round", f"{KN}, {_RR} SELECT round, feature, n_banks, round(curr_mean, 8) AS curr_mean, round(prev_mean, 8) AS prev_mean FROM rr")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(mining.round_over_round(importances(spark, sf)), 8)


_SHOW = ["round", "pattern_id", "name", "pattern_type", "severity", "confidence", "observation_count", "source_bank_count", "feature", "signature", "attack_vector"]
_DELTA = f"""{_RR}, dl AS (SELECT *, abs(curr_mean - prev_mean) / greatest(prev_mean, 0.01::DOUBLE) AS d, CASE WHEN curr_mean > prev_mean THEN 'increased' ELSE 'decreased' END AS dir
    FROM rr WHERE curr_mean >= 0.01 OR prev_mean >= 0.01),
  p1 AS (SELECT round, 1 AS strategy, 'DELTA-R' || round || '-' || feature AS pattern_id, 'Feature Delta: ' || feature || ' (' || dir || ')' AS name,
    CASE WHEN d > 0.7 THEN 'emergent' ELSE 'variant' END AS pattern_type, CASE WHEN d > 0.7 THEN 'high' ELSE 'medium' END AS severity,
    round(least(0.9::DOUBLE, 0.5::DOUBLE + d * 0.3::DOUBLE), 3) AS confidence, n_banks AS observation_count, n_banks AS source_bank_count, feature, round(curr_mean, 6) AS signature,
    'feature_delta' AS attack_vector FROM dl WHERE d >= 0.3)"""
_OUT = """ou AS (SELECT fs.round, fs.feature, any_value(fs.n_banks) AS n_banks, any_value(mean) AS mean, count(*) FILTER (abs(importance - mean) > 2 * std * 1.000000001::DOUBLE) + any_value(CASE WHEN mean > 2 * std * 1.000000001::DOUBLE THEN fs.n_banks - n_present ELSE 0 END) AS k
    FROM fs JOIN imp ON fs.round = imp.round AND fs.feature = imp.feature WHERE fs.n_banks >= 3 AND std >= 0.000001 GROUP BY 1, 2),
  p2 AS (SELECT round, 2 AS strategy, 'OUTLIER-R' || round || '-' || feature AS pattern_id, 'Cross-Bank Outlier: ' || feature AS name, 'variant' AS pattern_type, 'medium' AS severity,
    round(least(0.8::DOUBLE, 0.4::DOUBLE + k * 0.1::DOUBLE), 3) AS confidence, n_banks AS observation_count, k::BIGINT AS source_bank_count, feature, round(mean, 6) AS signature, 'cross_bank_outlier' AS attack_vector
    FROM ou WHERE k > 0)"""
_BASE = """bs AS (SELECT a.round, a.feature, avg(importance) FILTER (rk <= 100) AS baseline FROM (SELECT DISTINCT round, feature FROM imp) a JOIN LATERAL
    (SELECT importance, row_number() OVER (ORDER BY b.round DESC, bank_id DESC) AS rk FROM imp b WHERE b.feature = a.feature AND b.round < a.round) z ON true GROUP BY 1, 2)"""
_CONS = f"""{_BASE}, cn AS (SELECT fs.*, std / (mean + 0.000000001::DOUBLE) AS cv, baseline FROM fs LEFT JOIN bs ON fs.round = bs.round AND fs.feature = bs.feature WHERE n_banks >= 2),
  p3 AS (SELECT round, 3 AS strategy, 'CONSENSUS-R' || round || '-' || feature AS pattern_id, 'Consensus Feature: ' || feature AS name, 'fact' AS pattern_type, 'low' AS severity,
    round(least(0.95::DOUBLE, 0.7::DOUBLE + (1 - cv) * 0.2::DOUBLE), 3) AS confidence, n_banks AS observation_count, n_banks AS source_bank_count, feature, round(mean, 6) AS signature, 'consensus' AS attack_vector
    FROM cn WHERE mean > 0.05 * 1.000000001::DOUBLE AND cv < 0.3 AND NOT (baseline IS NOT NULL AND abs(mean - baseline) < 0.1::DOUBLE * mean))"""
_COMB = f"""{_MS}, hb AS (SELECT met.round, bank_id, fraud_rate > mean_fr * 1.5::DOUBLE * 1.000000001::DOUBLE AS hi FROM met JOIN ms ON met.round = ms.round WHERE k >= 3),
  ib AS (SELECT i.round, i.bank_id, coalesce(hi, false) AS hi FROM (SELECT DISTINCT round, bank_id FROM imp) i LEFT JOIN hb ON i.round = hb.round AND i.bank_id = hb.bank_id),
  sd AS (SELECT round, count(*) FILTER (hi) AS hb, count(*) FILTER (NOT hi) AS lb FROM ib GROUP BY 1),
  cs AS (SELECT imp.round, feature, coalesce(sum(importance) FILTER (hi), 0) AS hs, coalesce(sum(importance) FILTER (NOT hi), 0) AS ls FROM imp JOIN ib ON imp.round = ib.round AND imp.bank_id = ib.bank_id GROUP BY 1, 2),
  cb AS (SELECT cs.round, feature, hs / hb AS hm, (hs / hb) / (ls / lb + 0.000000001::DOUBLE) AS r, ms.k AS nm, (SELECT count(*) FROM hb h WHERE h.round = cs.round AND h.hi) AS nh
    FROM cs JOIN sd ON cs.round = sd.round JOIN ms ON cs.round = ms.round WHERE hb > 0 AND lb > 0 AND ms.k >= 3),
  p4 AS (SELECT round, 4 AS strategy, 'COMBINED-R' || round || '-' || feature AS pattern_id, 'Fraud-Correlated Feature: ' || feature AS name, 'emergent' AS pattern_type, 'high' AS severity,
    round(least(0.9::DOUBLE, 0.5::DOUBLE + (r - 2) * 0.1::DOUBLE), 3) AS confidence, nm AS observation_count, nh AS source_bank_count, feature, round(hm, 6) AS signature, 'combined' AS attack_vector FROM cb WHERE r > 2 * 1.000000001::DOUBLE)"""
_COLS = ", ".join(_SHOW)


@query("mine_feature_deltas", f"{KN}, {_DELTA} SELECT {_COLS} FROM p1")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(mining.feature_deltas(importances(spark, sf)).select(*_SHOW))


@query("mine_outliers", f"{KN}, {_FS}, {_OUT} SELECT {_COLS} FROM p2")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(mining.cross_bank_outliers(importances(spark, sf)).select(*_SHOW))


@query("feature_baselines", f"{KN}, {_BASE} SELECT round, feature, round(baseline, 8) AS baseline FROM bs")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(mining.baselines(importances(spark, sf)).where(F.col("baseline").isNotNull()), 8)


@query("mine_consensus", f"{KN}, {_FS}, {_CONS} SELECT {_COLS} FROM p3")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(mining.feature_consensus(importances(spark, sf)).select(*_SHOW))


@query("mine_combined", f"{KN}, {_COMB} SELECT {_COLS} FROM p4")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(mining.combined_indicators(*both(spark, sf)).select(*_SHOW))


_MINE = f"""{KN}, {_DELTA}, {_OUT}, {_CONS}, {_COMB}, al AS (SELECT * FROM p1 UNION ALL SELECT * FROM p2 UNION ALL SELECT * FROM p3 UNION ALL SELECT * FROM p4),
  dd AS (SELECT *, row_number() OVER (PARTITION BY round, lower(trim(name)) ORDER BY strategy, pattern_id) AS rn FROM al),
  mi AS (SELECT * FROM dd WHERE rn = 1)"""


@query("mining_run", f"{_MINE} SELECT {_COLS} FROM mi")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(mining.mine(*both(spark, sf)).select(*_SHOW))


@query(
    "mining_summary",
    f"""{_MINE} SELECT a.round, coalesce(c.n, 0) AS patterns_discovered, a.n AS features_analyzed, coalesce(b.n, 0) AS banks_analyzed FROM (SELECT round, count(DISTINCT feature) AS n FROM imp GROUP BY 1) a
      LEFT JOIN (SELECT round, count(*) AS n FROM met GROUP BY 1) b ON a.round = b.round LEFT JOIN (SELECT round, count(*) AS n FROM mi GROUP BY 1) c ON a.round = c.round""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    i, m = both(spark, sf)
    return mining.run_summary(mining.mine(i, m), i, m)


_DIV = f"""{_NB}, dv AS (SELECT imp.round, feature, any_value(n_banks) AS n_banks, avg(importance) AS mean, stddev_pop(importance) AS std FROM imp JOIN nb ON imp.round = nb.round GROUP BY 1, 2),
  p0 AS (SELECT round, 'PAT-FL-R' || round || '-' || feature AS pattern_id, 'FL Round ' || round || ': ' || feature || ' divergence' AS name, 'emergent' AS pattern_type,
    CASE WHEN mean > 0.1 * 1.000000001::DOUBLE THEN 'high' ELSE 'medium' END AS severity, round(least(0.95::DOUBLE, mean * 5), 3) AS confidence, n_banks AS observation_count, n_banks AS source_bank_count, feature,
    round(mean, 6) AS signature, 'feature_divergence_' || feature AS attack_vector FROM dv WHERE mean > 0.05 * 1.000000001::DOUBLE AND std / (mean + 0.000000001::DOUBLE) > 0.3 * 1.000000001::DOUBLE)"""


@query("divergence_patterns", f"{KN}, {_DIV} SELECT {_COLS} FROM p0")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(mining.divergence_patterns(importances(spark, sf), 0.0).select(*_SHOW))


@query("divergence_patterns_noised")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return mining.divergence_patterns(importances(spark, sf), 0.05, seed=9).select(*_SHOW)


@query(
    "fraud_rate_anomalies",
    f"""{KN}, {_MS} SELECT met.round, 'PAT-ANOM-R' || met.round || '-' || bank_id AS pattern_id, 'Anomalous fraud rate: Round ' || met.round AS name, 'critical' AS severity,
      round(least(0.95::DOUBLE, abs(fraud_rate - mean_fr) / (std_fr + 0.000000001::DOUBLE) * 0.3::DOUBLE), 3) AS confidence FROM met JOIN ms ON met.round = ms.round WHERE std_fr > 1e-12 AND abs(fraud_rate - mean_fr) > 2 * std_fr * 1.000000001::DOUBLE""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(mining.fraud_rate_anomalies(metrics(spark, sf)).select("round", "pattern_id", "name", "severity", "confidence"))


# --- alerts -----------------------------------------------------------------------------------------

_ASHOW = ["round", "alert_id", "alert_type", "severity", "title", "confidence", "affected_banks"]
_AC = ", ".join(_ASHOW)
_SHIFT = f"""{_RR}, a1 AS (SELECT round, 'ALERT-SHIFT-R' || round || '-' || feature AS alert_id, CASE WHEN s < 1 THEN 'variant' ELSE 'zero_day' END AS alert_type,
    CASE WHEN s > 1 THEN 'critical' ELSE 'high' END AS severity, 'Feature Shift Detected: ' || feature AS title, round(least(0.95::DOUBLE, s * 0.5::DOUBLE), 3) AS confidence, n_banks AS affected_banks
    FROM (SELECT *, abs(curr_mean - prev_mean) / (prev_mean + 0.000000001::DOUBLE) AS s FROM rr) WHERE s > 0.5 * 1.000000001::DOUBLE)"""
SPIKE_SQL = f"""{_MS}, a2 AS (SELECT met.round, 'ALERT-SPIKE-R' || met.round || '-' || bank_id AS alert_id, 'spike' AS alert_type, 'critical' AS severity,
    'Fraud Rate Spike Detected (Round ' || met.round || ')' AS title, round(least(0.95::DOUBLE, (fraud_rate - mean_fr) / (std_fr + 0.000000001::DOUBLE) * 0.25::DOUBLE), 3) AS confidence, 1::BIGINT AS affected_banks
    FROM met JOIN ms ON met.round = ms.round WHERE k >= 2 AND std_fr > 1e-12 AND fraud_rate > (mean_fr + 2.5::DOUBLE * std_fr) * 1.000000001::DOUBLE),
  a3 AS (SELECT round, 'ALERT-CORR-R' || round AS alert_id, 'correlation' AS alert_type, 'critical' AS severity, 'Coordinated Attack Pattern (Round ' || round || ')' AS title, round(least(0.95::DOUBLE, e / n), 3) AS confidence, e AS affected_banks
    FROM (SELECT met.round, count(*) FILTER (fraud_rate > mean_fr * 1.5::DOUBLE * 1.000000001::DOUBLE) AS e, count(*) AS n FROM met JOIN ms ON met.round = ms.round GROUP BY 1) WHERE n >= 3 AND e >= 2)"""
_ALERTS = f"{KN}, {_SHIFT}, {SPIKE_SQL}, aa AS (SELECT * FROM a1 UNION ALL SELECT * FROM a2 UNION ALL SELECT * FROM a3)"


@query("alert_feature_shifts", f"{KN}, {_SHIFT} SELECT {_AC} FROM a1")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(alerts.feature_shifts(importances(spark, sf)).select(*_ASHOW))


@query("alert_spikes", f"{KN}, {SPIKE_SQL} SELECT {_AC} FROM a2")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(alerts.fraud_rate_spikes(metrics(spark, sf)).select(*_ASHOW))


@query("alert_correlation", f"{KN}, {SPIKE_SQL} SELECT {_AC} FROM a3")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(alerts.cross_bank_correlation(metrics(spark, sf)).select(*_ASHOW))


def _alerts(spark: SparkSession, sf: str, rounds: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    return materialize(alerts.analyze(*(rounds or both(spark, sf))), "alerts")


@query("alert_filter", f"{_ALERTS} SELECT {_AC} FROM aa WHERE severity = 'critical' ORDER BY round DESC, alert_id LIMIT 20")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(alerts.newest(_alerts(spark, sf), severity="critical", limit=20).select(*_ASHOW))


@query("alerts_for_banks", f"{_ALERTS} SELECT {_AC} FROM aa WHERE affected_banks > 1 OR alert_type = 'correlation'")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(alerts.relevant_to_banks(_alerts(spark, sf)).select(*_ASHOW))


@query(
    "alert_summary",
    f"""{_ALERTS} SELECT 'total' AS kind, 'all' AS name, count(*) AS n FROM aa
      UNION ALL SELECT 'severity', s, (SELECT count(*) FROM aa WHERE severity = s) FROM unnest(['critical','high','medium','low','info']) t(s)
      UNION ALL SELECT 'alert_type', s, (SELECT count(*) FROM aa WHERE alert_type = s) FROM unnest(['variant','zero_day','spike','correlation']) t(s)
      UNION ALL SELECT 'newest', alert_id, n FROM (SELECT alert_id, row_number() OVER (ORDER BY round DESC, alert_id) AS n FROM aa) WHERE n <= 5""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return alerts.summary(_alerts(spark, sf))


# --- profiles -----------------------------------------------------------------------------------------

_PROF = """oo AS (SELECT *, row_number() OVER (PARTITION BY bank_id ORDER BY round) AS i, count(*) OVER (PARTITION BY bank_id) AS n FROM met),
  pf AS (SELECT bank_id, sum(num_samples)::BIGINT AS total_transactions, sum(num_fraud)::BIGINT AS total_fraud_flagged, count(*) AS rounds_participated, arg_max(accuracy, round) AS model_accuracy,
    sum(0.3::DOUBLE * 0.7::DOUBLE ** (n - i) * fraud_rate) AS avg_fraud_rate, max(round) AS last_round FROM oo GROUP BY 1)"""


@query("bank_profiles", f"{KN}, {_PROF} SELECT bank_id, total_transactions, total_fraud_flagged, rounds_participated, round(model_accuracy, 8) AS model_accuracy, round(avg_fraud_rate, 8) AS avg_fraud_rate, last_round FROM pf")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(central.bank_profiles(metrics(spark, sf)), 8)


@query(
    "smoothed_fraud_rates",
    f"""WITH RECURSIVE {KN.removeprefix('WITH ')}, o AS (SELECT bank_id, fraud_rate AS x, row_number() OVER (PARTITION BY bank_id ORDER BY round) AS i FROM met),
      e AS (SELECT bank_id, i, 0.3::DOUBLE * x AS r FROM o WHERE i = 1 UNION ALL SELECT o.bank_id, o.i, 0.7::DOUBLE * e.r + 0.3::DOUBLE * o.x FROM e JOIN o ON o.bank_id = e.bank_id AND o.i = e.i + 1)
      SELECT bank_id, round(arg_max(r, i), 8) AS avg_fraud_rate FROM e GROUP BY 1""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    """The closed form against the step-by-step recursion."""
    return rounded(central.smoothed_rates(metrics(spark, sf)), 8)


@query(
    "bank_risk_scores",
    f"""{KN}, {_PROF} SELECT bank_id, round(greatest(0, least(1, 0.6::DOUBLE * avg_fraud_rate / ((SELECT max(avg_fraud_rate) FROM pf) + 0.000000001::DOUBLE) + 0.4::DOUBLE * (CASE WHEN model_accuracy > 0 THEN 1 - least(model_accuracy, 1) ELSE 0.5 END))), 4) AS risk_score FROM pf""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return central.risk_scores(central.bank_profiles(metrics(spark, sf)))


_FR = """rk AS (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY round DESC, bank_id DESC) AS rn FROM imp),
  fr AS (SELECT feature, round(avg(importance) FILTER (rn <= 50), 6) AS mean_importance, round(stddev_pop(importance) FILTER (rn <= 50), 6) AS std, count(*) AS observations FROM rk GROUP BY 1)"""


@query("feature_ranking", f"{KN}, {_FR} SELECT * FROM fr ORDER BY mean_importance DESC, feature LIMIT 20")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return central.feature_ranking(importances(spark, sf))


@query(
    "global_statistics",
    f"""{KN}, {_PROF} SELECT count(*) AS total_banks, count(*) FILTER (rounds_participated > 0) AS active_banks, sum(total_transactions)::BIGINT AS total_transactions, sum(total_fraud_flagged)::BIGINT AS total_fraud_flagged,
      round(avg(avg_fraud_rate) FILTER (avg_fraud_rate > 0), 6) AS global_avg_fraud_rate, (SELECT count(DISTINCT round) FROM met) AS total_rounds FROM pf""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    m = metrics(spark, sf)
    return central.global_statistics(central.bank_profiles(m), central.round_history(m))


@query(
    "trend",
    f"""{KN}, h AS (SELECT round, count(*) AS b, avg(accuracy) AS a, avg(loss) AS l FROM met GROUP BY 1 ORDER BY round DESC LIMIT 10)
      SELECT count(*) AS rounds_analyzed, round(arg_max(a, round), 4) AS accuracy_current, round(avg(a), 4) AS accuracy_mean, CASE WHEN arg_max(a, round) > arg_min(a, round) THEN 'improving' ELSE 'declining' END AS accuracy_direction,
        round(arg_max(l, round), 4) AS loss_current, round(avg(l), 4) AS loss_mean, CASE WHEN arg_max(l, round) < arg_min(l, round) THEN 'improving' ELSE 'worsening' END AS loss_direction,
        arg_max(b, round) AS participation_current, round(avg(b), 1) AS participation_mean, 'ok' AS message FROM h""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return central.trend(central.round_history(metrics(spark, sf)))


@query(
    "top_banks",
    f"{KN}, {_PROF} SELECT bank_id, round(avg_fraud_rate * 100, 2) AS fraud_rate_pct, round(model_accuracy * 100, 2) AS accuracy_pct FROM pf WHERE avg_fraud_rate > 0 ORDER BY avg_fraud_rate DESC, bank_id LIMIT 10",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return central.top_banks(central.bank_profiles(metrics(spark, sf)))


# --- library --------------------------------------------------------------------------------------------

_AS_OF = "2026-01-01 00:00:00"


def _when() -> Column:
    return F.lit(_AS_OF).cast("timestamp")


def _store(spark: SparkSession, sf: str, rounds: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """Patterns mined from all rounds, last seen as many days ago as their round is old."""
    found = mining.mine(*(rounds or both(spark, sf)))
    dated = mining.to_entries(found).withColumn("r", F.regexp_extract("pattern_id", r"-R(\d+)-", 1).cast("int"))
    age = F.lit(2001 * 12 + 12) - F.col("r")
    entries = library.as_entries(
        dated.withColumns(
            {"last_seen": F.timestamp_seconds(F.unix_timestamp(_when()) - age * 86400), "updated_at": F.timestamp_seconds(F.unix_timestamp(_when()) - age * 3600),
             "frequency_per_day": F.col("source_bank_count") / 10}
        ).drop("r"),
        _when(),
    )
    return materialize(entries, "library")


_LIB = f"""{_MINE}, lb AS (SELECT pattern_id, name, pattern_type, severity, confidence, observation_count, source_bank_count, feature, signature, round, (2001 * 12 + 12) - round AS age FROM mi),
  nv AS (SELECT *, round(greatest(0, 1 - age / 90) * 0.4::DOUBLE + (1 - confidence) * 0.3::DOUBLE + (1 - least(source_bank_count / 5, 1)) * 0.3::DOUBLE, 4) AS novelty FROM lb)"""


@query("pattern_listing", f"{_LIB} SELECT pattern_id, severity, confidence FROM lb WHERE pattern_type = 'variant' AND confidence >= 0.6 ORDER BY age, pattern_id LIMIT 25 OFFSET 5")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return library.listing(_store(spark, sf), pattern_type="variant", min_confidence=0.6, offset=5, limit=25).select("pattern_id", "severity", "confidence")


@query("pattern_search", f"{_LIB} SELECT pattern_id, name FROM lb WHERE contains(lower(name), 'economy') OR contains(lower(feature), 'economy')")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return library.search(_store(spark, sf), "Economy").select("pattern_id", "name")


@query("pattern_novelty", f"{_LIB} SELECT pattern_id, novelty FROM nv")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return library.with_novelty(_store(spark, sf), _when()).select("pattern_id", "novelty")


@query("fact_based_patterns", f"{_LIB} SELECT pattern_id, confidence FROM lb WHERE observation_count >= 10 AND confidence >= 0.7 AND source_bank_count >= 2")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return library.fact_based(_store(spark, sf)).select("pattern_id", "confidence")


@query("emergent_patterns", f"{_LIB} SELECT pattern_id, novelty FROM nv WHERE pattern_type IN ('emergent', 'zero_day') AND novelty >= 0.3")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return library.emergent(_store(spark, sf), _when()).select("pattern_id", "novelty")


@query("trending_patterns", f"{_LIB} SELECT pattern_id, round(0.5::DOUBLE * source_bank_count / 10 + 0.5::DOUBLE * novelty, 6) AS trend FROM nv ORDER BY 0.5::DOUBLE * (source_bank_count / 10) + 0.5::DOUBLE * novelty DESC, pattern_id LIMIT 10")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(library.trending(_store(spark, sf), _when(), 10).select("pattern_id", "trend"))


_STAT_SQL = ", ".join([f"count(*) FILTER (pattern_type = '{t}') AS type_{t}" for t in library.PATTERN_TYPES] + [f"count(*) FILTER (severity = '{s}') AS severity_{s}" for s in library.SEVERITIES])


@query(
    "library_statistics",
    f"""{_LIB} SELECT count(*) AS total, {_STAT_SQL}, count(*) FILTER (observation_count >= 10 AND confidence >= 0.7 AND source_bank_count >= 2) AS fact_based, count(*) FILTER (pattern_type IN ('emergent', 'zero_day')) AS emergent,
      round(avg(confidence), 4) AS avg_confidence, sum(observation_count)::BIGINT AS total_observations, max(source_bank_count) AS banks_contributing FROM lb""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return library.statistics(_store(spark, sf))


@query(
    "pattern_upsert",
    f"""{_LIB}, ex AS (SELECT * FROM lb WHERE round < 24000), inc AS (SELECT * FROM lb WHERE round >= 23990)
      SELECT coalesce(i.pattern_id, e.pattern_id) AS pattern_id, coalesce(i.confidence, e.confidence) AS confidence, CASE WHEN e.pattern_id IS NOT NULL AND i.pattern_id IS NOT NULL THEN 2 ELSE 1 END AS version,
        greatest(coalesce(i.observation_count + 0, 0), coalesce(e.observation_count + 3, 0)) AS observation_count FROM ex e FULL JOIN inc i ON e.pattern_id = i.pattern_id""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    """Two overlapping sets of rounds; the stored set has slightly more observations."""
    both = _store(spark, sf).withColumn("r", F.regexp_extract("pattern_id", r"-R(\d+)-", 1).cast("int"))
    old = both.where("r < 24000").withColumn("observation_count", F.col("observation_count") + 3).drop("r")
    return library.upsert(old, both.where("r >= 23990").drop("r"), _when()).select("pattern_id", "confidence", "version", "observation_count")


@query(
    "pattern_promotion",
    f"""{_LIB} SELECT pattern_id, CASE WHEN ok THEN 'fact' ELSE pattern_type END AS pattern_type, CASE WHEN ok THEN 'confirmed' ELSE 'active' END AS status, CASE WHEN ok THEN 2 ELSE 1 END AS version
      FROM (SELECT *, pattern_type = 'emergent' AND observation_count >= 10 AND confidence >= 0.7 AND source_bank_count >= 2 AS ok FROM lb)""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return library.promote(_store(spark, sf), _when()).select("pattern_id", "pattern_type", "status", "version")


_ANOM = f"""{_MINE}, {_DIV.removeprefix(_NB + ", ")},
  an AS (SELECT 'PAT-ANOM-R' || met.round || '-' || bank_id AS pattern_id FROM met JOIN ms ON met.round = ms.round WHERE std_fr > 1e-12 AND abs(fraud_rate - mean_fr) > 2 * std_fr * 1.000000001::DOUBLE)"""


def _ingested(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    return central.ingest(*both(spark, sf), library.empty(spark), _when(), 0.0)


@query(
    "combined_ingest",
    f"""{_ANOM}, {_SHIFT.removeprefix(_RR + ", ")}, {SPIKE_SQL.removeprefix(_MS + ", ")}
      SELECT 'patterns' AS part, count(*) AS n FROM mi UNION ALL SELECT 'profiles', count(DISTINCT bank_id) FROM met
      UNION ALL SELECT 'alerts', (SELECT count(*) FROM a1) + (SELECT count(*) FROM a2) + (SELECT count(*) FROM a3)
      UNION ALL SELECT 'library', (SELECT count(*) FROM mi) + (SELECT count(*) FROM p0) + (SELECT count(*) FROM an)""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    """Central profiles, mining, alerts and library of all rounds in one job."""
    out = _ingested(spark, sf)
    parts = [out[k].agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("part"), "n") for k in ("patterns", "profiles", "alerts", "library")]
    return reduce(DataFrame.unionByName, parts)


@query(
    "anomalies_after_ingest",
    f"""{KN}, {_MS} SELECT 'PAT-ANOM-R' || met.round || '-INSTITUTION_' || bank_id AS pattern_id FROM met JOIN ms ON met.round = ms.round
      WHERE std_fr > 1e-12 AND abs(fraud_rate - mean_fr) > 2 * std_fr * 1.000000001::DOUBLE""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    """Every anomalous institution reaches the library, however alike the names are."""
    i, m = both(spark, sf)
    named = F.concat(F.lit("INSTITUTION_"), "bank_id")
    out = central.ingest(i.withColumn("bank_id", named), m.withColumn("bank_id", named), library.empty(spark), _when(), 0.0)
    return out["library"].where(F.col("pattern_id").startswith("PAT-ANOM")).select("pattern_id")


@query(
    "library_after_ingest",
    f"""{_ANOM}, lib AS (SELECT observation_count, confidence, source_bank_count FROM mi UNION ALL SELECT observation_count, confidence, source_bank_count FROM p0)
      SELECT count(*) + (SELECT count(*) FROM an) AS total, coalesce(max(source_bank_count), 0)::BIGINT AS banks_contributing FROM lib""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return library.statistics(_ingested(spark, sf)["library"]).select("total", "banks_contributing")


@query("library_json_round_trip", f"{_LIB} SELECT pattern_id, severity, signature FROM lb")
def _(spark: SparkSession, sf: str) -> DataFrame:
    path = tables.save(_store(spark, sf), durable_dir(spark, "library"), "index", "json")
    return tables.read_json(spark, path, library.SCHEMA).select("pattern_id", "severity", F.map_values("feature_signature")[0].alias("signature"))


# --- reports ----------------------------------------------------------------------------------------------


@query("knowledge_snapshot")
def _(spark: SparkSession, sf: str) -> DataFrame:
    i, m = both(spark, sf)
    rounds = central.round_history(m)
    stats = central.global_statistics(central.bank_profiles(m), rounds)
    return central.snapshot(1, _AS_OF, library.statistics(_store(spark, sf, (i, m))), stats, central.feature_ranking(i), rounds)


@query("global_report")
def _(spark: SparkSession, sf: str) -> DataFrame:
    i, m = both(spark, sf)
    profiles, rounds = central.bank_profiles(m), central.round_history(m)
    return reports.global_report(
        central.global_statistics(profiles, rounds), central.trend(rounds), central.feature_ranking(i), _store(spark, sf, (i, m)), _alerts(spark, sf, (i, m)), central.risk_scores(profiles), _when()
    )


@query("bank_report")
def _(spark: SparkSession, sf: str) -> DataFrame:
    i, m = both(spark, sf)
    return reports.bank_report("7", central.bank_profiles(m), _store(spark, sf, (i, m)), _alerts(spark, sf, (i, m)), _when())


@query("emergent_briefing")
def _(spark: SparkSession, sf: str) -> DataFrame:
    i, m = both(spark, sf)
    return reports.emergent_briefing(_store(spark, sf, (i, m)), _alerts(spark, sf, (i, m)))


@query(
    "briefing_details",
    f"""{_ALERTS} SELECT 'EMERGENT-all' AS report_id, 2 AS ord, row_number() OVER (ORDER BY alert_id) AS position, alert_id, title FROM aa WHERE severity = 'critical'""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    """Every critical alert of the briefing, numbered."""
    i, m = both(spark, sf)
    rows = reports.emergent_details(_store(spark, sf, (i, m)), _alerts(spark, sf, (i, m))).where("ord = 2")
    return rows.select("report_id", "ord", "position", *[F.get_json_object("data", f"$.{c}").alias(c) for c in ("alert_id", "title")])


@query(
    "bank_network_alerts",
    f"""{_ALERTS} SELECT 'BANK-7' AS report_id, 4 AS ord, row_number() OVER (ORDER BY alert_id) AS position, alert_id, severity FROM aa WHERE affected_banks > 1 OR alert_type = 'correlation'""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    """Every network alert of one institution's report, numbered."""
    i, m = both(spark, sf)
    rows = reports.bank_details("7", central.bank_profiles(m), _store(spark, sf, (i, m)), _alerts(spark, sf, (i, m)), _when()).where("ord = 4")
    return rows.select("report_id", "ord", "position", *[F.get_json_object("data", f"$.{c}").alias(c) for c in ("alert_id", "severity")])


@query("compliance_report")
def _(spark: SparkSession, sf: str) -> DataFrame:
    i, m = both(spark, sf)
    return reports.compliance_report(central.global_statistics(central.bank_profiles(m), central.round_history(m)), _store(spark, sf, (i, m)))


@query(
    "latest_reports",
    """SELECT o_orderkey AS report_id, o_orderpriority AS report_type, o_orderstatus AS generated_for FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus IN ('F', 'all')
      ORDER BY o_orderdate DESC, o_orderkey LIMIT 20""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    r = tables.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("report_id"), F.col("o_orderpriority").alias("report_type"), F.col("o_orderstatus").alias("generated_for"), F.col("o_orderdate").alias("generated_at")
    )
    return reports.latest(r, "1-URGENT", "F").drop("generated_at")
