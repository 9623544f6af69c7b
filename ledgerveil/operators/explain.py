"""Batch explanation of predictions: one projection per row, no joins or groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerveil.functions import scoring
from ledgerveil.plans.sizing import spread


def explain(
    df: DataFrame, transaction_id: str, prediction: str, values: str, scores: str | None = None,
    top_k: int = 5, threshold: float = 0.5,
) -> DataFrame:
    """Risk, ranked features, tags, texts, actions and confidence for every prediction.

    ``values`` and ``scores`` are map<string,double> columns. Supplied contributions are
    used as they are; an empty or missing map falls back to estimated importance.
    """
    p, v = F.col(prediction), F.col(values)
    guess = scoring.estimated_importance(v)
    s = guess if scores is None else F.when(F.size(F.coalesce(F.col(scores), F.create_map().cast("map<string,double>"))) > 0, F.col(scores)).otherwise(guess)
    tags, tag_conf = scoring.tag_predictions(v)
    needed = [transaction_id, prediction, values] + ([scores] if scores else [])
    base = spread(df.select(*needed)).select(
        F.col(transaction_id).alias("transaction_id"), p.alias("prediction"), scoring.risk_level(p).alias("risk_level"),
        scoring.ranked_features(v, s, top_k).alias("top_features"), tags.alias("patterns"), tag_conf.alias("_tc"),
    )
    level, feats, pats = F.col("risk_level"), F.col("top_features"), F.col("patterns")
    return base.select(
        "transaction_id", "prediction", (F.col("prediction") >= threshold).alias("is_fraud"), "risk_level", "top_features", "patterns",
        scoring.brief_text(F.col("prediction"), level, pats).alias("brief"),
        scoring.feature_summary(feats).alias("summary"),
        scoring.detailed_text(F.col("transaction_id"), F.col("prediction"), level, feats, pats).alias("detail"),
        scoring.recommended_actions(level, pats).alias("actions"),
        scoring.explanation_confidence(F.col("prediction"), F.size(feats), F.col("_tc")).alias("confidence"),
    )


def feature_rows(explained: DataFrame) -> DataFrame:
    """Ranked features as rows."""
    return explained.select("transaction_id", F.explode("top_features").alias("f")).select("transaction_id", "f.*")


def linear_contributions(features: list[str], coefficients: list[float]) -> Column:
    """map of coefficient * value: the native contribution source of a linear model."""
    pairs: list[Column] = []
    for f, c in zip(features, coefficients):
        pairs += [F.lit(f), F.coalesce(F.col(f).cast("double"), F.lit(0.0)) * F.lit(float(c))]
    return F.create_map(*pairs)
