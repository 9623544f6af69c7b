"""Training, scoring, ensembles and calibration on pyspark.ml."""

from __future__ import annotations

import itertools
import json
import os
from collections.abc import Callable, Sequence

from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerveil.operators import evaluate
from ledgerveil.operators.split import weight_column
from ledgerveil.plans.ranking import with_totals
from ledgerveil.plans.sizing import spread
from ledgerveil.session import materialize


def feature_columns(df: DataFrame, target: str, exclude: Sequence[str] = ()) -> list[str]:
    """Numeric and boolean columns other than the target and the excluded ones."""
    keep = (T.NumericType, T.BooleanType)
    return [f.name for f in df.schema.fields if f.name not in {target, *exclude} and isinstance(f.dataType, keep)]


def clean_value(c: str) -> Column:
    """Double with null and NaN replaced by 0."""
    return F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)).alias(c)


def prepare(df: DataFrame, target: str, features: Sequence[str] | None = None, exclude: Sequence[str] = (), keep: Sequence[str] = ()) -> DataFrame:
    """Cleaned features, the label as double, and the columns to keep alongside."""
    feats = list(features) if features is not None else feature_columns(df, target, exclude)
    return df.select(*keep, *[clean_value(f) for f in feats], F.col(target).cast("int").cast("double").alias("label"))


def boosted(
    features: Sequence[str], rounds: int = 40, depth: int = 5, validation: str | None = None, weight: str | None = "weight", seed: int = 42
) -> Pipeline:
    """Gradient-boosted trees over an assembled vector, with weights and early stopping."""
    gbt = GBTClassifier(
        featuresCol="features", labelCol="label", maxIter=rounds, maxDepth=depth, seed=seed, subsamplingRate=0.8, stepSize=0.1,
        maxBins=64, checkpointInterval=10,
    )
    if weight:
        gbt = gbt.setWeightCol(weight)
    if validation:
        gbt = gbt.setValidationIndicatorCol(validation)
    return Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="features"), gbt])


def logistic(features: Sequence[str], weight: str | None = "weight", reg: float = 0.01) -> Pipeline:
    lr = LogisticRegression(featuresCol="features", labelCol="label", regParam=reg, maxIter=50)
    if weight:
        lr = lr.setWeightCol(weight)
    return Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="features"), lr])


def train(df: DataFrame, estimator: Estimator | Callable[[], Estimator], label: str = "label") -> PipelineModel:
    """Fit an estimator (or one from a factory) on rows weighted by class balance."""
    est = estimator() if callable(estimator) and not isinstance(estimator, Estimator) else estimator
    weighted = spread(weight_column(df, label)).persist()  # labels are counted before rows are dealt out anew
    try:
        return est.fit(weighted)
    finally:
        weighted.unpersist()


def importance(model: PipelineModel, features: Sequence[str]) -> list[tuple[str, float]]:
    """Feature weights of the last stage, largest first."""
    last = model.stages[-1]
    values = last.featureImportances if hasattr(last, "featureImportances") else last.coefficients
    pairs = [(f, float(values[i])) for i, f in enumerate(features)]
    return sorted(pairs, key=lambda x: (-abs(x[1]), x[0]))


def score(df: DataFrame, model: PipelineModel, out: str = "score", threshold: float = 0.5) -> DataFrame:
    """Probability and thresholded prediction; partitions take the place of chunks."""
    drop = ["features", "rawPrediction", "probability", "prediction", "weight"]
    scored = model.transform(df.withColumn("weight", F.lit(1.0)) if "weight" not in df.columns else df)
    p = vector_to_array("probability")[1]
    return scored.withColumns({out: p, f"{out}_label": p >= threshold}).drop(*drop)


# --- ensembles -------------------------------------------------------------------------------


def weighted_average(scores: Sequence[str], weights: Sequence[float] | None = None) -> Column:
    """Mean of base scores; weights are normalised so that the result stays a probability."""
    w = list(weights) if weights is not None else [1.0] * len(scores)
    total = float(sum(w))
    out = F.lit(0.0)
    for s, x in zip(scores, w):
        out = out + F.col(s) * F.lit(float(x) / total)
    return out


def weighted_vote(scores: Sequence[str], weights: Sequence[float] | None = None) -> Column:
    """Share of weight whose base score exceeds one half."""
    w = list(weights) if weights is not None else [1.0] * len(scores)
    total = float(sum(w))
    out = F.lit(0.0)
    for s, x in zip(scores, w):
        out = out + (F.col(s) > 0.5).cast("double") * F.lit(float(x) / total)
    return out


def stack(df: DataFrame, scores: Sequence[str], label: str = "label") -> PipelineModel:
    """Logistic model over base scores."""
    return logistic(scores, weight=None, reg=0.0).fit(df.withColumn("label", F.col(label).cast("double")))


def calibrate(df: DataFrame, score_col: str, label: str = "label", method: str = "platt") -> Callable[[DataFrame], DataFrame]:
    """Fit a calibrator on held-out scores; the result adds ``calibrated``."""
    y = df.select(F.col(score_col).cast("double").alias(score_col), F.col(label).cast("double").alias("label"))
    if method == "platt":
        model = logistic([score_col], weight=None, reg=0.0).fit(y)
        return lambda d: score(d, model, "calibrated").drop("calibrated_label")
    if method == "isotonic":
        iso = IsotonicRegression(featuresCol=score_col, labelCol="label").fit(y)
        return lambda d: iso.transform(d).withColumnRenamed("prediction", "calibrated")
    raise ValueError(f"unknown calibration {method}")


def weight_grid(k: int, step: float = 0.1, low: float = 0.01) -> list[list[float]]:
    """Points of the simplex with the given step, each weight at least ``low``, summing to 1."""
    n = round(1 / step)
    free = 1.0 - k * low
    return [
        [low + free * c / n for c in combo]
        for combo in itertools.product(range(n + 1), repeat=k)
        if sum(combo) == n
    ]


def best_weights(df: DataFrame, label: str, scores: Sequence[str], step: float = 0.1, digits: int = 3) -> DataFrame:
    """(candidate, weights, average_precision) for every grid point, best first.

    Each row yields one rounded score per candidate, folded on the map side into a
    histogram of at most 10**digits cells per candidate.
    """
    grid = weight_grid(len(scores), step)
    cand = F.explode(
        F.array(
            *[
                F.struct(F.lit(i).alias("candidate"), F.round(weighted_average(scores, w), digits).alias("s"))
                for i, w in enumerate(grid)
            ]
        )
    )
    long = df.select(F.col(label).alias("y"), cand.alias("c")).select("y", "c.candidate", "c.s")
    ap = evaluate.ranking_metrics(long, "y", "s", by=["candidate"]).select("candidate", "average_precision")
    weights = F.array(*[F.array(*[F.lit(x) for x in w]) for w in grid])[F.col("candidate")]
    return ap.withColumn("weights", weights).orderBy(F.col("average_precision").desc(), "candidate")


def combined_importance(long: DataFrame, weights: DataFrame) -> DataFrame:
    """Importance over models: long (model, feature, score) x weights (model, weight), normalised."""
    s = long.join(weights, "model").groupBy("feature").agg(F.sum(F.col("score") * F.col("weight")).alias("s"))
    total = s.agg(F.sum("s").alias("t"))
    share = F.coalesce(F.try_divide(F.col("s"), F.col("t")), F.lit(0.0))
    return with_totals(s, total, []).select("feature", share.alias("importance"))


# --- train, validate, evaluate ------------------------------------------------------------------


def train_and_evaluate(
    df: DataFrame, label: str, split: str, estimator: Callable[[], Estimator], features: Sequence[str], threshold: float = 0.5,
    fold: str | None = None, folds: int = 0,
) -> tuple[PipelineModel, DataFrame, DataFrame | None]:
    """Optional cross-validation on train, fit on train + val, metrics on test.

    Returns (model, one-row test metrics, cross-validation row or None). The prepared
    table is written once; every fit and score reads it.
    """
    keep = [split] + ([fold] if fold else [])
    ready = materialize(prepare(df, label, features, keep=keep), "prepared")
    cv = None
    if fold and folds:
        parts: DataFrame | None = None
        tr = ready.where(F.col(split) == "train")
        for i in range(folds):
            m = train(tr.where(F.col(fold) != i), estimator)
            held = score(tr.where(F.col(fold) == i), m).select(fold, (F.col("label") == 1).alias("y"), "score")
            parts = held if parts is None else parts.unionByName(held)
        cv = evaluate.cross_validation(parts, fold, "y", "score")
    model = train(ready.where(F.col(split) != "test"), estimator)
    tested = score(ready.where(F.col(split) == "test"), model, threshold=threshold).select(
        F.lit("model").alias("model"), (F.col("label") == 1).alias("y"), "score"
    )
    return model, evaluate.model_metrics(tested, "model", "y", "score", threshold), cv


# --- registry --------------------------------------------------------------------------------------

METADATA = "name string, model_type string, created_at string, metrics map<string,double>, features array<string>"


def save_model(model: PipelineModel, root: str, name: str, model_type: str, created_at: str, metrics: dict[str, float], features: Sequence[str], spark: SparkSession) -> None:
    model.write().overwrite().save(os.path.join(root, name, "model"))
    row = [(name, model_type, created_at, metrics, list(features))]
    spark.createDataFrame(row, METADATA).coalesce(1).write.mode("overwrite").json(os.path.join(root, name, "metadata"))


def list_models(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(METADATA).json(os.path.join(root, "*", "metadata"))


def load_model(root: str, name: str) -> PipelineModel:
    return PipelineModel.load(os.path.join(root, name, "model"))


def export_metadata(df: DataFrame) -> DataFrame:
    """(name, document): every registry row as a JSON document, one per model."""
    return df.select("name", F.to_json(F.struct(*df.columns)).alias("document"))
