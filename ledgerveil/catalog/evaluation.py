"""Evaluation of scores: confusion, curves, exact areas, thresholds, costs, comparison, drift."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerveil.catalog.base import SCORED, TX, query, rounded, scored, transactions
from ledgerveil.operators import evaluate, reports

_CM = """count(*) FILTER (score >= {t} AND is_fraud) AS tp, count(*) FILTER (score >= {t} AND NOT is_fraud) AS fp,
  count(*) FILTER (score < {t} AND NOT is_fraud) AS tn, count(*) FILTER (score < {t} AND is_fraud) AS fn"""
_RATES = """round((tp + tn) / (tp + fp + tn + fn), 10) AS accuracy, round(coalesce(tp / nullif(tp + fp, 0), 0), 10) AS "precision", round(coalesce(tp / nullif(tp + fn, 0), 0), 10) AS recall,
  round(coalesce(tn / nullif(tn + fp, 0), 0), 10) AS specificity, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 10) AS f1,
  round(coalesce(5 * tp / nullif(5 * tp + 4 * fn + fp, 0), 0), 10) AS f2, round(coalesce(fp / nullif(fp + tn, 0), 0), 10) AS fpr, round(coalesce(fn / nullif(fn + tp, 0), 0), 10) AS fnr"""


@query("confusion_matrix", f"WITH {SCORED}, c AS (SELECT {_CM.format(t=0.5)} FROM scored) SELECT *, {_RATES} FROM c")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(evaluate.confusion(scored(spark, sf), "is_fraud", "score"), 10)


_CURVE = """g AS (SELECT score AS threshold, count(*) FILTER (is_fraud) AS pos, count(*) FILTER (NOT is_fraud) AS neg FROM scored GROUP BY 1),
  r AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER () AS p, sum(neg) OVER () AS n FROM g WINDOW w AS (ORDER BY threshold DESC ROWS UNBOUNDED PRECEDING)),
  k AS (SELECT *, tp / p AS recall, tp / (tp + fp) AS prec, 2 * tp / (p + tp + fp) AS f1 FROM r)"""


@query("score_curve", f"""WITH {SCORED}, {_CURVE} SELECT threshold, pos, neg, tp::BIGINT AS tp, fp::BIGINT AS fp, round(recall, 10) AS tpr, round(fp / n, 10) AS fpr,
  round(prec, 10) AS "precision", round(recall, 10) AS recall, round(f1, 10) AS f1 FROM k""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(evaluate.curve(scored(spark, sf), "is_fraud", "score"), 10)


_AREAS = """round(sum(neg * (tp - pos + pos / 2)) / (max(p) * max(n)), 10) AS roc_auc, round(sum(pos * prec) / max(p), 10) AS average_precision"""


@query(
    "ranking_metrics",
    f"""WITH {SCORED}, {_CURVE} SELECT max(p)::BIGINT AS positives, max(n)::BIGINT AS negatives, {_AREAS},
      (SELECT threshold FROM k ORDER BY f1 DESC, threshold LIMIT 1) AS best_threshold, round(max(f1), 10) AS best_f1,
      round(coalesce(max(recall) FILTER (prec >= 0.9), 0), 10) AS recall_at_p90 FROM k""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(evaluate.ranking_metrics(scored(spark, sf), "is_fraud", "score"), 10)


def _tx_scores(spark: SparkSession, sf: str) -> DataFrame:
    """transactions with a continuous score (almost every row its own value)."""
    return transactions(spark, sf).select("bank_id", "is_fraud", (F.col("l_extendedprice") * (F.col("l_discount") + 0.01)).alias("score"))


@query(
    "ranking_metrics_continuous",
    f"""WITH {TX}, scored AS (SELECT is_fraud, l_extendedprice * (l_discount + 0.01::DOUBLE) AS score FROM tx), {_CURVE}
      SELECT max(p)::BIGINT AS positives, max(n)::BIGINT AS negatives, {_AREAS} FROM k""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    m = evaluate.ranking_metrics(_tx_scores(spark, sf), "is_fraud", "score")
    return rounded(m.select("positives", "negatives", "roc_auc", "average_precision"), 10)


@query(
    "cost_metrics",
    f"""WITH {SCORED}, c AS (SELECT {_CM.format(t=0.5)}, count(*) AS n FROM scored) SELECT fp * 1.0::DOUBLE + fn * 10.0::DOUBLE AS total_cost, fp * 1.0::DOUBLE AS fp_cost,
      fn * 10.0::DOUBLE AS fn_cost, round((fp + fn * 10) / n, 10) AS cost_per_sample, round((fp + fn * 10) / (n * 10), 10) AS normalized_cost FROM c""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(evaluate.cost_metrics(scored(spark, sf), "is_fraud", "score"), 10)


def _models(spark: SparkSession, sf: str) -> DataFrame:
    """Three deterministic scorers of the same events, as (model, is_fraud, score)."""
    v = F.floor(F.least(F.col("value"), F.lit(100.0)) * 10) / 1000
    s = F.array(
        F.struct(F.lit("amount").alias("model"), v.alias("score")),
        F.struct(F.lit("mixed").alias("model"), F.col("score").alias("score")),
        F.struct(F.lit("inverse").alias("model"), (F.lit(1.0) - v).alias("score")),
    )
    return scored(spark, sf).select("event_id", "is_fraud", F.explode(s).alias("s")).select("event_id", "is_fraud", "s.model", "s.score")


_MODELS = f"""{SCORED}, ml AS (SELECT event_id, is_fraud, 'amount' AS model, floor(least(value, 100.0::DOUBLE) * 10) / 1000 AS score FROM scored
  UNION ALL SELECT event_id, is_fraud, 'mixed', score FROM scored UNION ALL SELECT event_id, is_fraud, 'inverse', 1 - floor(least(value, 100.0::DOUBLE) * 10) / 1000 FROM scored),
cm AS (SELECT model, {_CM.format(t=0.5)} FROM ml GROUP BY 1), rt AS (SELECT model, {_RATES} FROM cm),
g AS (SELECT model, score AS threshold, count(*) FILTER (is_fraud) AS pos, count(*) FILTER (NOT is_fraud) AS neg FROM ml GROUP BY 1, 2),
r AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER (PARTITION BY model) AS p, sum(neg) OVER (PARTITION BY model) AS n FROM g
  WINDOW w AS (PARTITION BY model ORDER BY threshold DESC ROWS UNBOUNDED PRECEDING)),
ar AS (SELECT model, {_AREAS} FROM (SELECT *, tp / (tp + fp) AS prec FROM r) GROUP BY 1),
mm AS (SELECT rt.model, accuracy, "precision", recall, f1, roc_auc, average_precision FROM rt JOIN ar ON rt.model = ar.model)"""


@query("model_comparison", f"WITH {_MODELS} SELECT * FROM mm")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.rank_models(rounded(evaluate.model_metrics(_models(spark, sf), "model", "is_fraud", "score"), 10), "model")


@query(
    "best_model_per_metric",
    f"""WITH {_MODELS}, lg AS (UNPIVOT mm ON accuracy, "precision", recall, f1, roc_auc, average_precision INTO NAME metric VALUE value)
      SELECT metric, max(value) AS best_value, min(model) FILTER (value = mx) AS best_model FROM (SELECT *, max(value) OVER (PARTITION BY metric) AS mx FROM lg) GROUP BY metric""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    m = rounded(evaluate.model_metrics(_models(spark, sf), "model", "is_fraud", "score"), 10)
    return evaluate.best_per_metric(m, "model")


@query(
    "cross_validation",
    f"""WITH {SCORED}, f AS (SELECT *, (event_id % 5)::INT AS fold FROM scored),
      g AS (SELECT fold, score AS threshold, count(*) FILTER (is_fraud) AS pos, count(*) FILTER (NOT is_fraud) AS neg FROM f GROUP BY 1, 2),
      r AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER (PARTITION BY fold) AS p, sum(neg) OVER (PARTITION BY fold) AS n FROM g
        WINDOW w AS (PARTITION BY fold ORDER BY threshold DESC ROWS UNBOUNDED PRECEDING)),
      a AS (SELECT fold, sum(neg * (tp - pos + pos / 2)) / (max(p) * max(n)) AS auc, sum(pos * tp / (tp + fp)) / max(p) AS ap FROM r GROUP BY 1)
      SELECT round(avg(auc), 10) AS auc_roc_mean, round(stddev_pop(auc), 10) AS auc_roc_std, round(avg(ap), 10) AS auc_pr_mean, round(stddev_pop(ap), 10) AS auc_pr_std FROM a""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    s = scored(spark, sf).withColumn("fold", (F.col("event_id") % 5).cast("int"))
    return rounded(evaluate.cross_validation(s, "fold", "is_fraud", "score"), 10)


@query("prediction_summary", f"WITH {SCORED} SELECT count(*) AS n_samples, count(*) FILTER (score >= 0.5) AS n_fraud, round(count(*) FILTER (score >= 0.5) / count(*), 10) AS fraud_rate FROM scored")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(evaluate.prediction_summary(scored(spark, sf), "score"), 10)


@query(
    "local_validation",
    f"""WITH {SCORED}, b AS (SELECT user_id, is_fraud, score, greatest(1e-15::DOUBLE, least(1 - 1e-15::DOUBLE, score)) AS q FROM scored),
      m AS (SELECT user_id, avg(-CASE WHEN is_fraud THEN ln(q) ELSE ln(1 - q) END) AS loss, count(*) FILTER (score > 0.5 AND is_fraud) AS tp, count(*) FILTER (score > 0.5 AND NOT is_fraud) AS fp, count(*) FILTER (score <= 0.5 AND is_fraud) AS fn FROM b GROUP BY 1),
      g AS (SELECT user_id, score, count(*) FILTER (is_fraud) AS pos, count(*) FILTER (NOT is_fraud) AS neg FROM b GROUP BY 1, 2),
      r AS (SELECT *, sum(pos) OVER w AS tp, sum(pos) OVER (PARTITION BY user_id) AS p, sum(neg) OVER (PARTITION BY user_id) AS n FROM g WINDOW w AS (PARTITION BY user_id ORDER BY score DESC ROWS UNBOUNDED PRECEDING)),
      a AS (SELECT user_id, coalesce(sum(neg * (tp - pos + pos / 2)) / nullif(max(p) * max(n), 0), 0) AS auc FROM r GROUP BY 1)
      SELECT m.user_id, round(loss, 6) AS loss, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1, round(auc, 6) AS auc FROM m JOIN a ON m.user_id = a.user_id""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(evaluate.local_validation(scored(spark, sf), "user_id", "is_fraud", "score"))


_EDGES = [10, 20, 30, 40, 50, 75, 100, 200]


@query(
    "score_drift",
    f"""WITH {SCORED}, b AS (SELECT ts < TIMESTAMP '2024-01-16' AS base, len(list_filter({_EDGES}, lambda e: value > e)) AS bin FROM scored),
      s AS (SELECT bin, count(*) FILTER (base) / (SELECT count(*) FROM b WHERE base) AS p, count(*) FILTER (NOT base) / (SELECT count(*) FROM b WHERE NOT base) AS q FROM b GROUP BY 1),
      c AS (SELECT *, sum(p - q) OVER (ORDER BY bin) AS gap FROM s)
      SELECT round(sum((greatest(p, 0.000001::DOUBLE) - greatest(q, 0.000001::DOUBLE)) * ln(greatest(p, 0.000001::DOUBLE) / greatest(q, 0.000001::DOUBLE))), 10) AS psi, round(max(abs(gap)), 10) AS ks FROM c""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    s = scored(spark, sf)
    cut = F.lit("2024-01-16 00:00:00").cast("timestamp_ntz")
    return rounded(evaluate.drift(s.where(F.col("ts") < cut), s.where(F.col("ts") >= cut), "value", _EDGES), 10)


@query(
    "suspicious_transactions",
    f"""WITH {TX}, t AS (SELECT bank_id, 3000 + 100 * (max(bank_id::INT)) AS threshold FROM tx GROUP BY 1)
      SELECT tx.bank_id, strftime(l_shipdate, '%Y-%m') AS month, count(*) AS n_reported, round(sum(l_extendedprice), 2) AS amount FROM tx JOIN t ON tx.bank_id = t.bank_id
      WHERE l_extendedprice * (l_discount + 0.01::DOUBLE) >= threshold GROUP BY 1, 2""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    t = transactions(spark, sf).select("bank_id", "l_shipdate", "l_extendedprice", (F.col("l_extendedprice") * (F.col("l_discount") + 0.01)).alias("score"))
    limits = t.groupBy("bank_id").agg((F.lit(3000) + 100 * F.max(F.col("bank_id").cast("int"))).alias("threshold"))
    return reports.suspicious_transactions(t, limits, "bank_id", "score", "l_extendedprice", "l_shipdate")
