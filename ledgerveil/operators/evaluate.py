"""Exact evaluation of scored tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerveil.plans.ranking import ordered_prefix, with_totals


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def confusion(df: DataFrame, label: str, score: str, threshold: float = 0.5, by: Sequence[str] = ()) -> DataFrame:
    """Counts and rates at a threshold, one aggregate; undefined ratios are 0."""
    y, p = F.col(label), F.col(score) >= F.lit(float(threshold))
    aggs = [
        F.count_if(p & y).alias("tp"),
        F.count_if(p & ~y).alias("fp"),
        F.count_if(~p & ~y).alias("tn"),
        F.count_if(~p & y).alias("fn"),
    ]
    c = df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)
    return c.select("*", *rates())


def rates() -> list[Column]:
    tp, fp, tn, fn = (F.col(x) for x in ("tp", "fp", "tn", "fn"))
    precision, recall = _ratio(tp, tp + fp), _ratio(tp, tp + fn)
    return [
        _ratio(tp + tn, tp + fp + tn + fn).alias("accuracy"),
        precision.alias("precision"),
        recall.alias("recall"),
        _ratio(tn, tn + fp).alias("specificity"),
        _ratio(2 * precision * recall, precision + recall).alias("f1"),
        _ratio(5 * precision * recall, 4 * precision + recall).alias("f2"),
        _ratio(fp, fp + tn).alias("fpr"),
        _ratio(fn, fn + tp).alias("fnr"),
    ]


def score_table(df: DataFrame, label: str, score: str, by: Sequence[str] = (), digits: int | None = None) -> DataFrame:
    """Distinct scores with positives and negatives; ties are folded before anything is ordered.

    ``digits`` rounds scores first, which bounds the table for very large inputs.
    """
    s = F.col(score) if digits is None else F.round(F.col(score), digits)
    y = F.col(label).cast("int")
    return (
        df.select(*by, s.alias("threshold"), y.alias("_y"))
        .groupBy(*by, "threshold")
        .agg(F.sum("_y").alias("pos"), (F.count(F.lit(1)) - F.sum("_y")).alias("neg"))
    )


def curve(df: DataFrame, label: str, score: str, by: Sequence[str] = (), digits: int | None = None) -> DataFrame:
    """One point per distinct threshold: tp, fp, tpr, fpr, precision, recall, f1 (all points kept)."""
    by = list(by)
    table = score_table(df, label, score, by, digits)
    run = ordered_prefix(table.withColumn("_d", -F.col("threshold")), by, "_d", ["pos", "neg"])
    sums = [F.sum("pos").alias("_p"), F.sum("neg").alias("_n")]
    totals = run.groupBy(*by).agg(*sums) if by else run.agg(*sums)
    joined = with_totals(run, totals, by)
    tp, fp = F.col("cum_pos"), F.col("cum_neg")
    precision, recall = _ratio(tp, tp + fp), _ratio(tp, F.col("_p"))
    return joined.select(
        *by,
        "threshold",
        "pos",
        "neg",
        tp.alias("tp"),
        fp.alias("fp"),
        recall.alias("tpr"),
        _ratio(fp, F.col("_n")).alias("fpr"),
        precision.alias("precision"),
        recall.alias("recall"),
        _ratio(2 * precision * recall, precision + recall).alias("f1"),
    )


def ranking_metrics(df: DataFrame, label: str, score: str, by: Sequence[str] = (), digits: int | None = None) -> DataFrame:
    """Exact ROC-AUC (ties averaged), step-wise average precision, best-F1 threshold, recall at 90% precision."""
    points = curve(df, label, score, by, digits)
    tp_before = F.col("tp") - F.col("pos")
    p, n = F.max("tp"), F.max("fp")
    auc = F.sum(F.col("neg") * (tp_before + F.col("pos") / 2)) / (p * n)
    ap = F.sum(F.col("pos") * F.col("precision")) / p
    aggs = [
        p.alias("positives"),
        n.alias("negatives"),
        F.coalesce(F.when((p > 0) & (n > 0), auc), F.lit(0.0)).alias("roc_auc"),
        F.coalesce(F.when(p > 0, ap), F.lit(0.0)).alias("average_precision"),
        F.coalesce(
            F.max_by("threshold", F.struct("f1", (-F.col("threshold")).alias("low_first"))), F.lit(0.5)
        ).alias("best_threshold"),
        F.coalesce(F.max("f1"), F.lit(0.0)).alias("best_f1"),
        F.coalesce(F.max(F.when(F.col("precision") >= 0.9, F.col("recall"))), F.lit(0.0)).alias("recall_at_p90"),
    ]
    return points.groupBy(*by).agg(*aggs) if by else points.agg(*aggs)


def cost_metrics(
    df: DataFrame, label: str, score: str, threshold: float = 0.5, cost_fp: float = 1.0, cost_fn: float = 10.0
) -> DataFrame:
    c = confusion(df, label, score, threshold)
    n = F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn")
    fp_cost, fn_cost = F.col("fp") * F.lit(float(cost_fp)), F.col("fn") * F.lit(float(cost_fn))
    total = fp_cost + fn_cost
    worst = n * F.lit(float(max(cost_fp, cost_fn)))
    return c.select(
        total.alias("total_cost"),
        fp_cost.alias("fp_cost"),
        fn_cost.alias("fn_cost"),
        _ratio(total, n).alias("cost_per_sample"),
        _ratio(total, worst).alias("normalized_cost"),
    )


COMPARED = ["accuracy", "precision", "recall", "f1", "roc_auc", "average_precision"]


def model_metrics(df: DataFrame, model: str, label: str, score: str, threshold: float = 0.5) -> DataFrame:
    """One row per model with the six compared metrics; ``df`` is long (model, label, score)."""
    at = confusion(df, label, score, threshold, by=[model])
    ranked = ranking_metrics(df, label, score, by=[model])
    return with_totals(at, ranked.select(model, "roc_auc", "average_precision"), [model]).select(model, *COMPARED)


def best_per_metric(metrics: DataFrame, model: str) -> DataFrame:
    """(metric, best_model, best_value); the alphabetically first model wins a tie."""
    long = metrics.unpivot([model], COMPARED, "metric", "value")
    top = long.groupBy("metric").agg(F.max("value").alias("best_value"))
    hit = long.join(top, "metric").where(F.col("value") == F.col("best_value"))
    return hit.groupBy("metric", "best_value").agg(F.min(model).alias("best_model"))


def rank_models(metrics: DataFrame, model: str, metric: str = "average_precision") -> DataFrame:
    return metrics.orderBy(F.col(metric).desc(), model)


def cross_validation(df: DataFrame, fold: str, label: str, score: str) -> DataFrame:
    """Mean and population deviation over folds."""
    per_fold = ranking_metrics(df, label, score, by=[fold])
    return per_fold.agg(
        F.avg("roc_auc").alias("auc_roc_mean"),
        F.stddev_pop("roc_auc").alias("auc_roc_std"),
        F.avg("average_precision").alias("auc_pr_mean"),
        F.stddev_pop("average_precision").alias("auc_pr_std"),
    )


def prediction_summary(df: DataFrame, score: str, threshold: float = 0.5) -> DataFrame:
    hit = F.col(score) >= F.lit(float(threshold))
    return df.agg(
        F.count(F.lit(1)).alias("n_samples"),
        F.count_if(hit).alias("n_fraud"),
        _ratio(F.count_if(hit), F.count(F.lit(1))).alias("fraud_rate"),
    )


def local_validation(df: DataFrame, client: str, label: str, score: str) -> DataFrame:
    """Per client: log loss (clipped), F1 at > 0.5, AUC when both classes occur."""
    p = F.greatest(F.lit(1e-15), F.least(F.lit(1 - 1e-15), F.col(score)))
    y = F.col(label).cast("double")
    hit = F.col(score) > 0.5
    base = df.groupBy(client).agg(
        F.avg(-(y * F.log(p) + (1 - y) * F.log(1 - p))).alias("loss"),
        F.count_if(hit & F.col(label)).alias("_tp"),
        F.count_if(hit & ~F.col(label)).alias("_fp"),
        F.count_if(~hit & F.col(label)).alias("_fn"),
    )
    f1 = _ratio(2 * F.col("_tp"), 2 * F.col("_tp") + F.col("_fp") + F.col("_fn"))
    auc = ranking_metrics(df, label, score, by=[client]).select(client, F.col("roc_auc").alias("auc"))
    return with_totals(base.select(client, "loss", f1.alias("f1")), auc, [client])


def drift(
    base: DataFrame, other: DataFrame, value: str, edges: Sequence[float], floor: float = 1e-6
) -> DataFrame:
    """One row: population stability index over fixed bins, and the largest CDF gap over them."""
    k = len(edges)

    def shares(df: DataFrame, name: str) -> DataFrame:
        b = F.lit(0)
        for e in edges:
            b = b + (F.col(value) > F.lit(float(e))).cast("int")
        counts = df.where(F.col(value).isNotNull()).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("m"))
        return with_totals(counts, counts.agg(F.sum("m").alias("t")), []).select(
            "bin", (F.col("m") / F.col("t")).alias(name)
        )

    joined = shares(base, "p").join(shares(other, "q"), "bin", "full")
    p, q = F.coalesce("p", F.lit(0.0)), F.coalesce("q", F.lit(0.0))
    sums = joined.agg(
        F.sum(
            (F.greatest(p, F.lit(floor)) - F.greatest(q, F.lit(floor)))
            * F.log(F.greatest(p, F.lit(floor)) / F.greatest(q, F.lit(floor)))
        ).alias("psi"),
        *[F.sum(F.when(F.col("bin") <= i, p - q)).alias(f"_g{i}") for i in range(k)],
    )
    gap = F.greatest(F.lit(0.0), *[F.coalesce(F.abs(F.col(f"_g{i}")), F.lit(0.0)) for i in range(k)])
    return sums.select("psi", gap.alias("ks"))
