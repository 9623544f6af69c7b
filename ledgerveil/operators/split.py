"""Splitting, folding, partitioning and balancing labelled tables."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerveil.plans.ranking import exact_quantiles, hash_rank, seeded_order, with_totals
from ledgerveil.plans.sizing import BROADCAST_ROWS, bounded_rows
from ledgerveil.session import materialize


def _check(train: float, val: float, test: float) -> None:
    if abs(train + val + test - 1.0) > 0.01:
        raise ValueError("split ratios must sum to 1")


def stratified_split(
    df: DataFrame,
    label: str | None,
    ids: Sequence[str],
    train: float = 0.70,
    val: float = 0.15,
    test: float = 0.15,
    seed: int = 42,
) -> DataFrame:
    """Add ``split`` in (train, val, test) with exact proportions per label (or overall)."""
    _check(train, val, test)
    ranked = hash_rank(df, [label] if label else [], ids, seed)
    split = (
        F.when(F.col("rn") <= F.floor(F.col("n_group") * F.lit(float(train))), "train")
        .when(F.col("rn") <= F.floor(F.col("n_group") * F.lit(float(round(train + val, 10)))), "val")
        .otherwise("test")
    )
    return ranked.withColumn("split", split).drop("rn", "n_group")


def kfold(df: DataFrame, label: str | None, ids: Sequence[str], k: int = 5, seed: int = 42) -> DataFrame:
    """Add ``fold`` in 0..k-1, stratified; one column instead of k copies of the table."""
    ranked = hash_rank(df, [label] if label else [], ids, seed)
    return ranked.withColumn("fold", F.pmod(F.col("rn") - 1, F.lit(k)).cast("int")).drop("rn", "n_group")


def iid_partition(df: DataFrame, ids: Sequence[str], clients: int, seed: int = 42) -> DataFrame:
    """Add ``client_id``: equal shares, the last client takes the remainder."""
    ranked = hash_rank(df, [], ids, seed)
    share = F.greatest(F.lit(1), F.floor(F.col("n_group") / clients))
    cid = F.least(F.lit(clients - 1), F.floor((F.col("rn") - 1) / share)).cast("int")
    return ranked.withColumn("client_id", cid).drop("rn", "n_group")


def dirichlet_cuts(labels: Sequence[object], clients: int, alpha: float, seed: int) -> dict[object, list[float]]:
    """Cumulative client shares per label (a few numbers, drawn once on the driver)."""
    rng = np.random.default_rng(seed)
    return {lab: [float(x) for x in np.cumsum(rng.dirichlet([alpha] * clients))] for lab in labels}


def dirichlet_partition(
    df: DataFrame, label: str, ids: Sequence[str], clients: int, alpha: float = 0.5, seed: int = 42, max_labels: int = 10_000,
) -> DataFrame:
    """Add ``client_id`` with label shares drawn from a Dirichlet distribution.

    Labels are read from the data, a null label included; more than ``max_labels`` of them are refused. A row finds its
    client by the number of its label's cut points at or below its place.
    """
    found = bounded_rows(df.select(label).distinct(), max_labels, "labels")
    cuts = dirichlet_cuts(sorted((r[0] for r in found if r[0] is not None)) + [None] * any(r[0] is None for r in found), clients, alpha, seed)
    kind = df.schema[label].dataType.simpleString()
    side = df.sparkSession.createDataFrame([(lab, cum[:-1]) for lab, cum in cuts.items()], f"_label {kind}, _cuts array<double>")
    placed = hash_rank(df, [label], ids, seed).join(F.broadcast(side), F.col(label).eqNullSafe(F.col("_label")), "left")
    below = F.size(F.filter("_cuts", lambda c: F.col("rn") > F.floor(F.col("n_group") * c)))
    return placed.withColumn("client_id", below.cast("int")).drop("rn", "n_group", "_label", "_cuts")


def undersample(df: DataFrame, label: str, ids: Sequence[str], ratio: float = 1.0, seed: int = 42) -> DataFrame:
    """Keep the minority (label true) and floor(minority * ratio) majority rows."""
    minority = df.agg(F.count_if(F.col(label)).alias("_minority"))
    ranked = with_totals(hash_rank(df, [label], ids, seed), minority, [])
    keep = F.col(label) | (F.col("rn") <= F.floor(F.col("_minority") * F.lit(float(ratio))))
    return ranked.where(keep).drop("rn", "n_group", "_minority")


def shuffled(df: DataFrame, ids: Sequence[str], seed: int = 42) -> DataFrame:
    """Rows in reproducible random order; a full sort, so only where the order is wanted."""
    return df.orderBy(seeded_order(seed, *ids))


def stratified_sample(df: DataFrame, label: str, ids: Sequence[str], size: int, seed: int = 42) -> DataFrame:
    """Development sample of about ``size`` rows with exact per-label shares (rounded down, at least one)."""
    total = df.agg(F.count(F.lit(1)).alias("_n"))
    ranked = with_totals(hash_rank(df, [label], ids, seed), total, [])
    quota = F.greatest(F.lit(1), F.floor(F.lit(size) * F.col("n_group") / F.col("_n")))
    return ranked.where(F.col("rn") <= quota).drop("rn", "n_group", "_n")


def sample_fraction(df: DataFrame, ids: Sequence[str], fraction: float | None, seed: int = 42) -> DataFrame:
    """Reproducible Bernoulli sample by key; any fraction outside (0, 1) returns the table as it is."""
    if fraction is None or not 0 < fraction < 1:
        return df
    h = F.xxhash64(F.lit(seed), *[F.col(c) for c in ids])
    return df.where(F.pmod(h, F.lit(1_000_000)) < int(fraction * 1_000_000))


def temporal_split(df: DataFrame, time: str, train: float = 0.70, val: float = 0.15) -> DataFrame:
    """Add ``split`` by time: earliest, middle, latest. Rows sharing an instant stay together."""
    seconds = df.withColumn("_t", F.col(time).cast("timestamp").cast("double"))
    cuts = exact_quantiles(seconds, [], "_t", {"_c1": train, "_c2": round(train + val, 10)})
    return (
        with_totals(seconds, cuts, [])
        .withColumn(
            "split",
            F.when(F.col("_t") <= F.col("_c1"), "train").when(F.col("_t") <= F.col("_c2"), "val").otherwise("test"),
        )
        .drop("_t", "_c1", "_c2")
    )


def leakage(df: DataFrame, time: str, split: str = "split") -> DataFrame:
    """One row: does each part end before the next one starts?"""

    def part(name: str, fn) -> Column:  # noqa: ANN001
        return fn(F.when(F.col(split) == name, F.col(time)))

    return df.agg(
        part("train", F.max).alias("train_end"),
        part("val", F.min).alias("val_start"),
        part("val", F.max).alias("val_end"),
        part("test", F.min).alias("test_start"),
    ).withColumn("clean", (F.col("train_end") < F.col("val_start")) & (F.col("val_end") < F.col("test_start")))


def split_summary(df: DataFrame, label: str, split: str = "split") -> DataFrame:
    return df.groupBy(split).agg(
        F.count(F.lit(1)).alias("n_rows"), F.avg(F.col(label).cast("int")).alias("fraud_ratio")
    )


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Balanced weights n / (k * count) per label."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n_label"))
    totals = counts.agg(F.sum("n_label").alias("_n"), F.count(F.lit(1)).alias("_k"))
    return with_totals(counts, totals, []).select(
        label, "n_label", (F.col("_n") / (F.col("_k") * F.col("n_label"))).alias("weight")
    )


def imbalance_weights(df: DataFrame, label: str) -> DataFrame:
    """One row: neg/pos for one kind of booster, half-share weights per class for the other."""
    counts = df.agg(F.count_if(F.col(label)).alias("pos"), F.count_if(~F.col(label)).alias("neg"))
    n = F.col("pos") + F.col("neg")
    return counts.select(
        "pos",
        "neg",
        F.when(F.col("pos") > 0, F.col("neg") / F.col("pos")).otherwise(F.lit(1.0)).alias("scale_pos_weight"),
        F.try_divide(n, F.lit(2) * F.col("neg")).alias("weight_neg"),
        F.try_divide(n, F.lit(2) * F.col("pos")).alias("weight_pos"),
    )


def weight_column(df: DataFrame, label: str, name: str = "weight") -> DataFrame:
    """Attach the balanced weight of each row's label.

    A label may hold most rows, so its weight is sent to them; a shuffle by label would put them into one task.
    """
    weights = materialize(class_weights(df, label).select(label, F.col("weight").alias(name)), "class-weights")
    few = weights.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return with_totals(df, F.broadcast(weights) if few else weights, [label])
