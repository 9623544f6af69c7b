"""A fitted ensemble: out-of-fold base scores, a meta-learner and a calibrator on them, one model to save and load."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark import keyword_only
from pyspark.ml import Estimator, Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.regression import IsotonicRegression
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerveil.operators.leafwise import Leafwise, Settings
from ledgerveil.session import materialize


class Probability(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Takes the probability of label 1 out of a classifier's vector and drops the classifier's other columns."""

    inputCol = Param(Params._dummy(), "inputCol", "probability vector", TypeConverters.toString)
    outputCol = Param(Params._dummy(), "outputCol", "column of the probability", TypeConverters.toString)
    dropCols = Param(Params._dummy(), "dropCols", "columns to drop", TypeConverters.toListString)

    @keyword_only
    def __init__(self, *, inputCol: str = "probability", outputCol: str = "score", dropCols: list[str] | None = None) -> None:  # noqa: N803
        super().__init__()
        self._setDefault(inputCol="probability", outputCol="score", dropCols=[])
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        p = vector_to_array(self.getOrDefault(self.inputCol))[1]
        return df.withColumn(self.getOrDefault(self.outputCol), p).drop(*self.getOrDefault(self.dropCols))


def _columns(name: str) -> dict[str, str]:
    return {c: f"_{name}_{c}" for c in ("features", "raw", "probability", "prediction")}


def _classifier(make: Callable[..., Estimator], features: Sequence[str], name: str, label: str) -> Pipeline:
    c = _columns(name)
    model = make(featuresCol=c["features"], labelCol=label, rawPredictionCol=c["raw"], probabilityCol=c["probability"], predictionCol=c["prediction"])
    return Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol=c["features"]), model, Probability(inputCol=c["probability"], outputCol=name, dropCols=list(c.values()))])


def logistic_base(features: Sequence[str], name: str, label: str = "label", reg: float = 0.01) -> Pipeline:
    return _classifier(lambda **c: LogisticRegression(regParam=reg, maxIter=50, **c), features, name, label)


def boosted_base(features: Sequence[str], name: str, label: str = "label", rounds: int = 20, depth: int = 4) -> Pipeline:
    return _classifier(lambda **c: GBTClassifier(maxIter=rounds, maxDepth=depth, seed=42, **c), features, name, label)


def leafwise_base(features: Sequence[str], name: str, label: str = "label", settings: Settings | None = None) -> Pipeline:
    return Pipeline(stages=[Leafwise(features, name, label, settings=settings)])


def out_of_fold(df: DataFrame, bases: dict[str, Pipeline], fold: str, folds: int) -> DataFrame:
    """``df`` with one score a base, each row scored by models that were fitted without its fold; written to the shared folder."""
    parts: DataFrame | None = None
    for i in range(folds):
        held, rest = df.where(F.col(fold) == i), df.where(F.col(fold) != i)
        for base in bases.values():
            held = base.fit(rest).transform(held)
        held = materialize(held.select(*df.columns, *bases), f"fold-{i}")
        parts = held if parts is None else parts.unionByName(held)
    return parts


def fit(
    df: DataFrame, bases: dict[str, Pipeline], key: Sequence[str], label: str = "label", folds: int = 4, calibration: str = "platt", output: str = "score"
) -> tuple[PipelineModel, DataFrame]:
    """(the whole ensemble as one pipeline model, the out-of-fold scores with ``stacked``).

    Rows get their fold by a hash of ``key``, so that folds do not follow partitions. The meta-learner is fitted on
    out-of-fold base scores; the calibrator on meta scores of learners that did not see the row's fold either. The bases
    and the meta-learner that are kept are fitted on all rows.
    """
    if calibration not in ("platt", "isotonic"):
        raise ValueError(f"unknown calibration {calibration}")
    names = list(bases)
    ready = materialize(df.withColumn("_fold", F.pmod(F.xxhash64(*key), F.lit(folds)).cast("int")), "ensemble-rows")
    scores = out_of_fold(ready, bases, "_fold", folds)
    meta = logistic_base(names, "stacked", label, 0.0)
    stacked = materialize(out_of_fold(scores, {"stacked": meta}, "_fold", folds), "stacked")
    if calibration == "platt":
        calibrator = logistic_base(["stacked"], output, label, 0.0)
    else:
        calibrator = Pipeline(stages=[IsotonicRegression(featuresCol="stacked", labelCol=label, predictionCol=output)])
    model = PipelineModel([*[base.fit(ready) for base in bases.values()], meta.fit(scores), calibrator.fit(stacked)])
    return model, stacked.drop("_fold")
