"""The fitted ensemble against its bases, its copy, and on a stream."""

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from ledgerveil.operators import ensemble, evaluate, leafwise
from ledgerveil.streaming import jobs, monitoring

FEATURES = list("abcd")


def rows(spark, n=4000, parts=5):
    """A linear part that suits the logistic base, and a chequered part that suits trees."""
    r = np.random.default_rng(11)
    x = r.normal(size=(n, 4))
    y = r.random(n) < 1 / (1 + np.exp(-(1.2 * x[:, 0] - 1.2 * x[:, 1] + 2.0 * np.sign(x[:, 2] * x[:, 3]))))
    data = [(i, *map(float, a), float(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))]
    return spark.createDataFrame(data, "id long, a double, b double, c double, d double, label double").repartition(parts)


def bases():
    small = leafwise.Settings(trees=4, leaves=6, rate=0.5, bins=16)
    return {"linear": ensemble.logistic_base(FEATURES, "linear"), "trees": ensemble.leafwise_base(["c", "d"], "trees", settings=small)}


@pytest.fixture(scope="module")
def fitted(spark):
    df = rows(spark)
    return df, *ensemble.fit(df.where("id % 4 < 3"), bases(), ["id"], folds=3)


def area(df, column):
    return evaluate.ranking_metrics(df.withColumn("y", F.col("label") == 1), "y", column).first()["roc_auc"]


def test_better_than_each_base_on_held_out_rows(fitted):
    df, model, _ = fitted
    held = model.transform(df.where("id % 4 = 3")).cache()
    assert area(held, "score") > max(area(held, "linear"), area(held, "trees")) + 0.03
    mean = held.agg(F.avg("score"), F.avg("label")).first()
    assert abs(mean[0] - mean[1]) < 0.04  # calibrated


def test_each_row_is_scored_by_models_that_did_not_see_it(spark):
    """Labels are noise and one feature is the row's number: a model that saw a row could repeat its label."""
    df = spark.range(120).select("id", F.col("id").cast("double").alias("a"), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(2)).cast("double").alias("label"))
    deep = leafwise.Settings(trees=3, leaves=12, rate=1.0, bins=64, least_rows=1, penalty=0.1)
    _, scores = ensemble.fit(df, {"trees": ensemble.leafwise_base(["a"], "trees", settings=deep)}, ["id"], folds=2)
    assert scores.count() == 120
    assert abs(area(scores, "trees") - 0.5) < 0.2
    assert area(ensemble.leafwise_base(["a"], "trees", settings=deep).fit(df).transform(df), "trees") > 0.75


def test_saved_and_loaded_whole(fitted, tmp_path):
    df, model, _ = fitted
    model.write().overwrite().save(str(tmp_path / "m"))
    loaded = PipelineModel.load(str(tmp_path / "m"))
    some = df.where("id < 300")
    want = {r.id: r.score for r in model.transform(some).collect()}
    assert {r.id: r.score for r in loaded.transform(some).collect()} == want


def test_isotonic_calibration(spark):
    df = rows(spark, 600)
    model, _ = ensemble.fit(df, bases(), ["id"], folds=2, calibration="isotonic")
    low, high = model.transform(df).agg(F.min("score"), F.max("score")).first()
    assert 0 <= low < high <= 1
    with pytest.raises(ValueError):
        ensemble.fit(df, bases(), ["id"], calibration="none")


def test_scores_a_stream(spark, fitted, tmp_path):
    df, model, _ = fitted
    some = df.where("id < 200").select("id", "a", "b", "c", "d", F.lit("x").alias("bank"), F.lit(1).alias("round"))
    src, cp = str(tmp_path / "in"), str(tmp_path / "cp")
    for i in range(2):
        some.where(F.col("id") % 2 == i).coalesce(1).write.mode("append").parquet(src)
    work, scored, _ = monitoring.monitor(spark, str(tmp_path / "out"), model, FEATURES, "id", "bank", "round")
    jobs.each_batch(jobs.read_parquet_stream(spark, src, some.schema, files_per_trigger=1), work, cp).awaitTermination()
    assert {r.id: r.score for r in scored.read().collect()} == {r.id: r.score for r in model.transform(df.where("id < 200")).collect()}
