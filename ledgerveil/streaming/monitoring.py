"""Scoring and ingest of a transaction stream with a saved model."""

from __future__ import annotations

import os
from collections.abc import Callable, Sequence

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerveil.operators import models


class BatchTable:
    """A table of which each micro-batch owns one part: a batch that is replayed replaces its own rows and nothing else."""

    def __init__(self, spark: SparkSession, root: str, name: str) -> None:
        self.spark, self.path = spark, os.path.join(root, name)

    def merge(self, rows: DataFrame, batch_id: int) -> None:
        rows.write.mode("overwrite").parquet(os.path.join(self.path, f"batch={batch_id}"))

    def read(self) -> DataFrame:
        return self.spark.read.option("basePath", self.path).parquet(os.path.join(self.path, "batch=*")).drop("batch")


def scored_rows(batch: DataFrame, model: PipelineModel, features: Sequence[str], keep: Sequence[str], threshold: float = 0.5) -> DataFrame:
    """``keep`` columns with score and flagged: the batch scorer over cleaned features."""
    kept = {c: f"_kept_{i}" for i, c in enumerate(keep)}  # a column may be kept as it is and be a feature
    clean = batch.select(*[F.col(c).alias(k) for c, k in kept.items()], *[models.clean_value(f) for f in features])
    # a classifier leaves a probability vector, a fitted ensemble its score
    scored = model.transform(clean.withColumn("weight", F.lit(1.0)))
    p = vector_to_array("probability")[1] if "probability" in scored.columns else F.col("score")
    return scored.withColumn("score", p).select(*[F.col(k).alias(c) for c, k in kept.items()], "score", (F.col("score") >= threshold).alias("flagged"))


def round_sums(scored: DataFrame, bank: str, round_: str) -> DataFrame:
    """(round, bank_id, n_rows, n_flagged, score_sum): what a batch adds to an institution's round."""
    return scored.groupBy(F.col(round_).cast("long").alias("round"), F.col(bank).alias("bank_id")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if("flagged").alias("n_flagged"), F.sum(F.floor(F.col("score") * 1_000_000)).cast("long").alias("score_millionths")
    )


def monitor(
    spark: SparkSession, root: str, model: PipelineModel, features: Sequence[str], key: str, bank: str, round_: str, threshold: float = 0.5
) -> tuple[Callable[[DataFrame, int], None], BatchTable, BatchTable]:
    """(work for each micro-batch, scored rows, partial sums of rounds).

    The model is loaded by the caller, once. Both tables are merged by batch id, so that a replayed batch changes nothing;
    the scored rows are written first and the sums taken from the written rows, so that both always agree.
    """
    rows, rounds = BatchTable(spark, root, "scored"), BatchTable(spark, root, "rounds")

    def work(batch: DataFrame, batch_id: int) -> None:
        rows.merge(scored_rows(batch, model, features, [key, bank, round_], threshold), batch_id)
        written = batch.sparkSession.read.parquet(os.path.join(rows.path, f"batch={batch_id}"))
        rounds.merge(round_sums(written, bank, round_), batch_id)

    return work, rows, rounds


def merged_rounds(rounds: BatchTable) -> DataFrame:
    """(round, bank_id, n_rows, n_flagged, mean_score) over all batches."""
    sums = rounds.read().groupBy("round", "bank_id").agg(*[F.sum(c).alias(c) for c in ("n_rows", "n_flagged", "score_millionths")])
    return sums.select("round", "bank_id", "n_rows", "n_flagged", (F.col("score_millionths") / F.col("n_rows") / 1_000_000).alias("mean_score"))


def interrupted(work: Callable[[DataFrame, int], None], at: int) -> Callable[[DataFrame, int], None]:
    """``work`` that fails once after batch ``at`` was done and before Spark has noted it: the batch is replayed after a restart."""
    failed = []

    def run(batch: DataFrame, batch_id: int) -> None:
        work(batch, batch_id)
        if batch_id == at and not failed:
            failed.append(batch_id)
            raise RuntimeError("interrupted on purpose")

    return run
