"""Differentially private releases over tables, and private gradient steps."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerveil.functions import noise

SENSITIVE_QUERIES = ("count", "sum", "mean", "histogram", "median")


def sensitivity(query: str, lower: float | None = None, upper: float | None = None, n: Column | None = None) -> Column:
    """How much one row can move the answer: count and histogram 1, sum and median the range, mean range / n."""
    if query in ("count", "histogram"):
        return F.lit(1.0)
    if lower is None or upper is None:
        raise ValueError(f"{query} needs bounds")
    width = F.lit(float(upper - lower))
    if query in ("sum", "median"):
        return width
    if query == "mean":
        return width / F.greatest(F.lit(1), n) if n is not None else width
    raise ValueError(f"unknown query {query}")


def clipped(column: str, lower: float, upper: float) -> Column:
    return F.greatest(F.lit(float(lower)), F.least(F.lit(float(upper)), F.col(column)))


def true_answer(
    df: DataFrame, query: str, column: str | None = None, by: Sequence[str] = (),
    lower: float | None = None, upper: float | None = None,
) -> DataFrame:
    """(by..., value, sensitivity): the clipped aggregate before noise."""
    n = F.count(F.lit(1)) if column is None or query in ("count", "histogram") else F.count(F.col(column))
    if query in ("count", "histogram"):
        value = n.cast("double")
    elif query == "sum":
        value = F.sum(clipped(column, lower, upper))
    elif query == "mean":
        value = F.avg(clipped(column, lower, upper))
    else:
        raise ValueError(f"unsupported query {query}")
    agg = df.groupBy(*by).agg(value.alias("value"), n.alias("_n")) if by else df.agg(value.alias("value"), n.alias("_n"))
    return agg.select(*by, "value", sensitivity(query, lower, upper, F.col("_n")).alias("sensitivity"))


def release(
    df: DataFrame, query: str, epsilon: float, column: str | None = None, by: Sequence[str] = (),
    lower: float | None = None, upper: float | None = None,
    mechanism: str = "laplace", delta: float = 1e-5, seed: int | None = None,
) -> DataFrame:
    """Noisy aggregate per group: partial aggregation first, one noise draw per released number."""
    exact = true_answer(df, query, column, by, lower, upper)
    s = F.col("sensitivity")
    if mechanism == "laplace":
        draw = noise.laplace(s / F.lit(float(epsilon)), seed)
    elif mechanism == "gaussian":
        draw = noise.gaussian(s * F.lit(noise.gaussian_sigma(1.0, epsilon, delta)), seed)
    else:
        raise ValueError(f"unknown mechanism {mechanism}")
    return exact.select(*by, (F.col("value") + draw).alias("value"))


def choose(
    df: DataFrame, option: str, utility: str, epsilon: float, by: Sequence[str] = (),
    utility_sensitivity: float = 1.0, seed: int | None = None,
) -> DataFrame:
    """Exponential mechanism per group through Gumbel-max: no normalisation pass is needed."""
    score = F.lit(float(epsilon)) * F.col(utility) / F.lit(2.0 * utility_sensitivity) + noise.gumbel(seed)
    scored = df.withColumn("_s", score)
    pick = F.max_by(option, "_s").alias(option)
    return scored.groupBy(*by).agg(pick) if by else scored.agg(pick)


def noisy_leaves(
    df: DataFrame, tree: str, value: str, epsilon: float, delta: float, n_trees: int,
    leaf_sensitivity: float = 1.0, seed: int | None = None,
) -> DataFrame:
    """Gaussian noise on leaf values or histogram cells, the budget shared by all trees."""
    sigma = noise.gaussian_sigma(leaf_sensitivity, epsilon / float(np.sqrt(n_trees)), delta / n_trees)
    return df.withColumn(value, F.col(value) + noise.gaussian(sigma, seed))


# --- private gradient steps ---------------------------------------------------------


def clipped_gradient_sum(
    df: DataFrame, features: Sequence[str], label: str, weights: Sequence[float], clip: float
) -> DataFrame:
    """One row: summed clipped logistic gradients g0..gd and the batch size, in one native aggregate."""
    z = F.lit(0.0)
    for f, w in zip(features, weights):
        z = z + F.coalesce(F.col(f), F.lit(0.0)) * F.lit(float(w))
    err = F.lit(1.0) / (F.lit(1.0) + F.exp(-z)) - F.col(label).cast("double")
    grads = [err * F.coalesce(F.col(f), F.lit(0.0)) for f in features]
    g = df.select(*[x.alias(f"g{i}") for i, x in enumerate(grads)])
    sq = F.lit(0.0)
    for i in range(len(features)):
        sq = sq + F.col(f"g{i}") * F.col(f"g{i}")
    g = g.withColumn("_f", F.least(F.lit(1.0), F.lit(float(clip)) / (F.sqrt(sq) + F.lit(1e-8))))
    return g.agg(
        *[F.sum(F.col(f"g{i}") * F.col("_f")).alias(f"g{i}") for i in range(len(features))],
        F.count(F.lit(1)).alias("n"),
    )


def private_step(
    df: DataFrame, features: Sequence[str], label: str, weights: Sequence[float],
    clip: float, noise_multiplier: float, learning_rate: float, rng: np.random.Generator, batch_size: float,
) -> list[float]:
    """One noisy gradient step; only the d summed coordinates reach the driver.

    ``batch_size`` is the expected one. How many rows the sample really had is not released: an empty sample takes a step
    of noise like any other.
    """
    row = clipped_gradient_sum(df, features, label, weights, clip).first()
    total = np.array([row[f"g{i}"] or 0.0 for i in range(len(features))])
    noisy = (total + rng.normal(0.0, noise_multiplier * clip, len(features))) / max(batch_size, 1.0)
    return [float(w) for w in np.asarray(weights) - learning_rate * noisy]


def train_private(
    df: DataFrame, features: Sequence[str], label: str, steps: int = 10, sampling_rate: float = 0.1,
    clip: float = 1.0, noise_multiplier: float = 1.0, learning_rate: float = 0.5, seed: int = 42,
) -> tuple[list[float], dict[str, float]]:
    """Logistic model by noisy steps over Poisson samples; returns weights and the ledger entry.

    The needed columns are kept in memory and on disk while the steps run.
    """
    rng = np.random.default_rng(seed)
    weights = [0.0] * len(features)
    slim = df.select(*features, label).persist()
    try:
        expected = min(sampling_rate, 1.0) * slim.count()  # the table's size is public, a sample's is not
        for i in range(steps):
            batch = slim if sampling_rate >= 1 else slim.sample(sampling_rate, seed + i)
            weights = private_step(batch, features, label, weights, clip, noise_multiplier, learning_rate, rng, expected)
    finally:
        slim.unpersist()
    return weights, {"sigma": noise_multiplier, "sampling_rate": sampling_rate, "n_steps": steps, "sensitivity": 1.0}


def user_gradient_sum(
    df: DataFrame, features: Sequence[str], label: str, weights: Sequence[float],
    gradient: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray], clip: float,
) -> DataFrame:
    """Summed clipped gradients for a user function (weights, X, y) -> per-row gradients.

    Runs on Arrow batches; every batch emits one partial sum per coordinate.
    """
    feats, w = list(features), np.asarray(weights, dtype=float)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            g = gradient(w, pdf[feats].fillna(0.0).to_numpy(float), pdf[label].to_numpy(float))
            factor = np.minimum(1.0, clip / (np.linalg.norm(g, axis=1) + 1e-8))
            s = (g * factor[:, None]).sum(axis=0)
            yield pd.DataFrame({"coord": np.arange(len(s)), "value": s, "n": len(pdf)})

    parts = df.select(*feats, F.col(label).cast("double").alias(label)).mapInPandas(
        partial, "coord int, value double, n bigint"
    )
    return parts.groupBy("coord").agg(F.sum("value").alias("value"), F.sum("n").alias("n"))
