"""Models on feature tables: boosted trees, isolation forest, ensembles, calibration."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerveil.catalog.base import SCORED, query, rounded, scored
from ledgerveil.operators import ensemble, evaluate, forest, leafwise, models, split
from ledgerveil.plans.ranking import with_totals
from ledgerveil.session import durable_dir, materialize
from ledgerveil.sources.tables import table

_FEATURES = ["value", "hour", "kind", "k"]


def _matrix(spark: SparkSession, sf: str) -> DataFrame:
    """events as a labelled matrix; the label depends on value and hour with hashed noise."""
    e = table(spark, sf, "events")
    hour = F.hour(F.col("ts").cast("timestamp")).cast("double")
    noise = F.pmod(F.xxhash64("event_id"), F.lit(100)) < 8
    base = e.select(
        "event_id", "value", hour.alias("hour"), F.pmod(F.xxhash64("event_type"), F.lit(5)).cast("double").alias("kind"),
        F.get_json_object("props", "$.k").cast("double").alias("k"),
    )
    hot = (F.col("value") > 60) & (F.col("hour") < 8)
    return base.withColumn("is_fraud", (hot & ~noise) | (~hot & noise & (F.col("kind") == 1)))


def _split(spark: SparkSession, sf: str) -> DataFrame:
    """The matrix with its split, written once: ranks, fits and metrics read it many times."""
    return materialize(split.stratified_split(_matrix(spark, sf), "is_fraud", ["event_id"]), "split")


def saved_model(spark: SparkSession, sf: str) -> tuple[DataFrame, PipelineModel, list[str]]:
    """(labelled matrix, a model of it that was saved in a registry and loaded again, its features)."""
    matrix, root = _matrix(spark, sf), durable_dir(spark, "registry")
    trained = models.train(models.prepare(matrix, "is_fraud", _FEATURES), models.logistic(_FEATURES))
    models.save_model(trained, root, "monitor", "logistic", "2026-01-01", dict(models.importance(trained, _FEATURES)), _FEATURES, spark)
    return matrix, models.load_model(root, "monitor"), _FEATURES


@query("train_boosted")
def _(spark: SparkSession, sf: str) -> DataFrame:
    """Test metrics of boosted trees with class weights and a validation split."""
    df = _split(spark, sf)
    ready = models.prepare(df, "is_fraud", _FEATURES, keep=["split"]).withColumn("is_val", F.col("split") == "val")
    m = models.train(ready.where("split <> 'test'"), models.boosted(_FEATURES, rounds=12, depth=4, validation="is_val"))
    test = models.score(ready.where("split = 'test'"), m).select(F.lit("boosted").alias("model"), (F.col("label") == 1).alias("y"), "score")
    return evaluate.model_metrics(test, "model", "y", "score")


@query("train_leafwise")
def _(spark: SparkSession, sf: str) -> DataFrame:
    """Test metrics of leaf-wise boosted trees with class weights and early stopping."""
    ready = models.prepare(_split(spark, sf), "is_fraud", _FEATURES, keep=["split"]).withColumn("is_val", F.col("split") == "val")
    weighted = split.weight_column(ready.where("split <> 'test'"), "label")
    m = leafwise.fit(weighted, _FEATURES, validation="is_val", settings=leafwise.Settings(trees=8, leaves=8, rate=0.4))
    test = leafwise.LeafwiseModel(document=m.document()).transform(ready.where("split = 'test'"))
    told = materialize(test.select(F.lit("leafwise").alias("model"), (F.col("label") == 1).alias("y"), "score"), "scored")
    return evaluate.model_metrics(told, "model", "y", "score")


def _ensemble(spark: SparkSession, sf: str) -> tuple[DataFrame, PipelineModel, PipelineModel, list[str]]:
    """(prepared rows with split, the fitted ensemble, its saved and loaded copy, names of the bases)."""
    ready = models.prepare(_split(spark, sf), "is_fraud", _FEATURES, keep=["event_id", "split"])
    small = leafwise.Settings(trees=3, leaves=5, rate=0.5, bins=32)
    bases = {"linear": ensemble.logistic_base(_FEATURES, "linear"), "trees": ensemble.leafwise_base(["value", "hour"], "trees", settings=small), "kinds": ensemble.logistic_base(["kind", "k"], "kinds")}
    model, _ = ensemble.fit(ready.where("split <> 'test'"), bases, ["event_id"], folds=3)
    root = durable_dir(spark, "registry")
    models.save_model(model, root, "ensemble", "ensemble", "2026-01-01", {}, _FEATURES, spark)
    return ready, model, models.load_model(root, "ensemble"), [*bases, "score"]


@query("fitted_ensemble")
def _(spark: SparkSession, sf: str) -> DataFrame:
    """Held-out metrics of each base and of the ensemble fitted on out-of-fold scores."""
    ready, _, loaded, names = _ensemble(spark, sf)
    test = materialize(loaded.transform(ready.where("split = 'test'")).select((F.col("label") == 1).alias("y"), *names), "scored")
    return evaluate.model_metrics(test.unpivot(["y"], names, "model", "score"), "model", "y", "score")


@query("ensemble_copy", "SELECT event_id, 1 AS n_scored, true AS equals_fitted FROM events")
def _(spark: SparkSession, sf: str) -> DataFrame:
    """Every row scored by the ensemble and by its saved and loaded copy."""
    ready, model, loaded, _ = _ensemble(spark, sf)
    a, b = (m.transform(ready).select("event_id", F.col("score").alias(n)) for m, n in ((model, "fitted"), (loaded, "copy")))
    return a.join(b, "event_id").groupBy("event_id").agg(F.count(F.lit(1)).cast("int").alias("n_scored"), F.bool_and(F.col("fitted") == F.col("copy")).alias("equals_fitted"))


@query("train_and_validate")
def _(spark: SparkSession, sf: str) -> DataFrame:
    """Cross-validation on the training part, then metrics on the test part (logistic model)."""
    df = split.kfold(_split(spark, sf), "is_fraud", ["event_id"], 3)
    _, test, cv = models.train_and_evaluate(df, "is_fraud", "split", lambda: models.logistic(_FEATURES), _FEATURES, fold="fold", folds=3)
    return with_totals(test, cv, [])


@query("batch_scoring")
def _(spark: SparkSession, sf: str) -> DataFrame:
    ready = models.prepare(_matrix(spark, sf), "is_fraud", _FEATURES, keep=["event_id"])
    m = models.train(ready, models.logistic(_FEATURES))
    return models.score(ready, m).select("event_id", "score", "score_label")


@query("isolation_forest")
def _(spark: SparkSession, sf: str) -> DataFrame:
    df = _matrix(spark, sf)
    trees = forest.fit(df, _FEATURES, trees=50, key=["event_id"])
    return forest.scaled(forest.anomaly_scores(df, trees, _FEATURES)).select("event_id", "is_fraud", "score")


@query("forest_thresholds", f"""WITH {SCORED}, c AS (SELECT unnest({forest.THRESHOLDS}::DOUBLE[]) AS threshold),
  g AS (SELECT threshold, count(*) FILTER (score >= threshold AND is_fraud) AS tp, count(*) FILTER (score >= threshold AND NOT is_fraud) AS fp, count(*) FILTER (score < threshold AND is_fraud) AS fn FROM scored, c GROUP BY 1)
  SELECT threshold, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1 FROM g""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(forest.threshold_table(scored(spark, sf), "is_fraud", "score"))


def _base_scores(spark: SparkSession, sf: str) -> DataFrame:
    v = F.least(F.col("value"), F.lit(100.0)) / 100
    return scored(spark, sf).select("event_id", "is_fraud", F.col("score").alias("a"), v.alias("b"), (F.lit(1.0) - v).alias("c"))


@query(
    "ensemble_scores",
    f"""WITH {SCORED}, b AS (SELECT event_id, score AS a, least(value, 100.0::DOUBLE) / 100 AS b, 1 - least(value, 100.0::DOUBLE) / 100 AS c FROM scored)
      SELECT event_id, round(a * 0.5::DOUBLE + b * 0.3::DOUBLE + c * 0.2::DOUBLE, 6) AS average, round((a > 0.5)::INT * 0.5::DOUBLE + (b > 0.5)::INT * 0.3::DOUBLE + (c > 0.5)::INT * 0.2::DOUBLE, 6) AS vote FROM b""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    """Weights 5 : 3 : 2 are normalised."""
    names, w = ["a", "b", "c"], [5, 3, 2]
    return rounded(_base_scores(spark, sf).select("event_id", models.weighted_average(names, w).alias("average"), models.weighted_vote(names, w).alias("vote")))


@query("ensemble_weight_search")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return models.best_weights(_base_scores(spark, sf), "is_fraud", ["a", "b", "c"], step=0.25).withColumn("weights", F.array_join(F.transform("weights", lambda x: F.round(x, 3).cast("string")), ","))


@query("stacked_scores")
def _(spark: SparkSession, sf: str) -> DataFrame:
    b = _base_scores(spark, sf).withColumn("is_fraud", F.col("is_fraud").cast("double"))
    m = models.stack(b, ["a", "b", "c"], "is_fraud")
    return models.score(b, m, "stacked").select("event_id", "stacked")


@query("calibrated_scores")
def _(spark: SparkSession, sf: str) -> DataFrame:
    s = scored(spark, sf).select("event_id", "is_fraud", "score")
    platt, iso = models.calibrate(s, "score", "is_fraud", "platt"), models.calibrate(s, "score", "is_fraud", "isotonic")
    return iso(platt(s).withColumnRenamed("calibrated", "platt")).select("event_id", "score", "platt", F.col("calibrated").alias("isotonic"))


@query(
    "combined_importance",
    """WITH l AS (SELECT p_type AS feature, p_brand AS model, avg(p_retailprice) AS score FROM part GROUP BY 1, 2), w AS (SELECT p_brand AS model, count(*) / 100 AS weight FROM part GROUP BY 1),
      s AS (SELECT feature, sum(score * weight) AS s FROM l JOIN w ON l.model = w.model GROUP BY 1) SELECT feature, round(s / (SELECT sum(s) FROM s), 8) AS importance FROM s""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    long = p.groupBy(F.col("p_type").alias("feature"), F.col("p_brand").alias("model")).agg(F.avg("p_retailprice").alias("score"))
    weights = p.groupBy(F.col("p_brand").alias("model")).agg((F.count(F.lit(1)) / 100).alias("weight"))
    return rounded(models.combined_importance(long, weights), 8)


@query("model_registry")
def _(spark: SparkSession, sf: str) -> DataFrame:
    """A model trained on the table is saved with its metadata and listed again."""
    ready = models.prepare(_matrix(spark, sf), "is_fraud", _FEATURES)
    root = durable_dir(spark, "registry")
    m = models.train(ready, models.logistic(_FEATURES))
    weights = dict(models.importance(m, _FEATURES))
    models.save_model(m, root, "logistic-1", "logistic", "2026-01-01", weights, _FEATURES, spark)
    return models.list_models(spark, root).select("name", "model_type", F.size("features").alias("n_features"))
