"""Robust combination of per-client weight vectors.

Input rows: round, client_id, num_samples, weights array<float>. Results are long,
(round, coord, value); ``pack`` turns them into one array per round.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerveil.functions import noise, vectors
from ledgerveil.plans.ranking import exact_quantiles, ordered_prefix, value_counts, with_totals
from ledgerveil.plans.selection import smallest
from ledgerveil.session import materialize

# clients per block, and the bytes a block's vectors may take in a task
BLOCK_ROWS = 512
BLOCK_BYTES = 256 << 20


def coordinates(df: DataFrame) -> DataFrame:
    """One row per client and coordinate, in double precision."""
    n = F.coalesce(F.col("num_samples"), F.lit(1)).cast("double").alias("n")
    return df.select("round", "client_id", n, F.posexplode("weights").alias("coord", "w")).withColumn(
        "w", F.col("w").cast("double")
    )


def round_sizes(df: DataFrame) -> DataFrame:
    return df.groupBy("round").agg(F.count(F.lit(1)).alias("n_clients"))


def pack(long: DataFrame) -> DataFrame:
    """(round, weights): coordinates in order; the array is as long as one model."""
    arr = F.transform(F.array_sort(F.collect_list(F.struct("coord", "value"))), lambda s: s["value"])
    return long.groupBy("round").agg(arr.alias("weights"))


def fedavg(df: DataFrame) -> DataFrame:
    """Mean weighted by sample counts; partial sums are combined on the map side."""
    c = coordinates(df)
    return c.groupBy("round", "coord").agg((F.sum(F.col("w") * F.col("n")) / F.sum("n")).alias("value"))


# --- distance-based selection ---------------------------------------------------------


def _apart(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of two blocks by one matrix product, around the first block's mean."""
    centre = left.mean(axis=0)
    a, b = left - centre, right - centre
    return np.maximum((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None] - 2 * (a @ b.T), 0.0)


def _block_scores(drop: int) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
    """Distances of two blocks of clients, each pair once: for the clients of both, the summed squared
    distances without the ``drop`` farthest peers in the other block, and those farthest ones."""

    columns = ["round", "client_id", "n_clients", "kept", "nearest", "far"]

    def told(rnd: object, part: pd.DataFrame, d2: np.ndarray) -> pd.DataFrame:
        d2 = np.sort(d2, axis=1)
        cut = max(0, d2.shape[1] - drop)
        near = d2[:, 0] if d2.shape[1] else np.full(len(part), np.inf)
        return pd.DataFrame({"round": rnd, "client_id": part["client_id"].to_numpy(), "n_clients": part["n_clients"].to_numpy(), "kept": d2[:, :cut].sum(axis=1), "nearest": near, "far": list(d2[:, cut:])})

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        rnd, i, j = key
        left, right = pdf[pdf["b"] == i], pdf[pdf["b"] == j]
        if left.empty or right.empty:
            return pd.DataFrame(columns=columns)
        if i == j and left["client_id"].duplicated().any():
            raise ValueError(f"round {rnd}: a client id occurs twice")
        vectors_of = lambda part: np.vstack([np.asarray(v, dtype=np.float64) for v in part["weights"]])
        if i == j:
            d2, n = _apart(vectors_of(left), vectors_of(left)), len(left)
            return told(rnd, left, d2[~np.eye(n, dtype=bool)].reshape(n, n - 1))
        d2 = _apart(vectors_of(left), vectors_of(right))
        return pd.concat([told(rnd, left, d2), told(rnd, right, d2.T)])

    return run


def krum_scores(df: DataFrame, byzantine: int, block_rows: int | None = None) -> DataFrame:
    """(round, client_id, n_clients, score, nearest_distance).

    score = sum of squared distances to the n - f - 2 nearest peers, i.e. to all peers
    but the f + 1 farthest. A round is cut into blocks of clients and each pair of
    blocks (i <= j) is one task's work, done once for both; a task hands on one sum and
    the f + 1 farthest peers per client, never the distances themselves. Merging drops
    the overall f + 1 farthest. A client id that occurs twice in a round raises.
    """
    drop = byzantine + 1
    if block_rows is None:
        one = df.select(F.size("weights")).first()  # all vectors are equally long
        block_rows = max(2, min(BLOCK_ROWS, BLOCK_BYTES // (8 * max(one[0] if one else 1, 1))))
    sized = with_totals(df.select("round", "client_id", "weights"), round_sizes(df), ["round"])
    nb = F.greatest(F.lit(1), F.ceil(F.col("n_clients") / F.lit(block_rows))).cast("int")
    placed = sized.withColumn("nb", nb).withColumn("b", F.pmod(F.xxhash64("client_id"), F.col("nb")).cast("int"))
    blocks = F.sequence(F.lit(0), F.col("nb") - 1)

    b = F.col("b")
    cells = F.transform(blocks, lambda k: F.struct(F.least(b, k).alias("i"), F.greatest(b, k).alias("j")))
    parts = (
        placed.select("round", "client_id", "weights", "n_clients", "b", F.explode(cells).alias("c"))
        .select("round", "client_id", "weights", "n_clients", "b", "c.i", "c.j")
        .groupBy("round", "i", "j")
        .applyInPandas(
            _block_scores(drop),
            f"round {df.schema['round'].dataType.simpleString()}, client_id {df.schema['client_id'].dataType.simpleString()}, "
            "n_clients bigint, kept double, nearest double, far array<double>",
        )
    )
    merged = parts.groupBy("round", "client_id").agg(
        F.first("n_clients").alias("n_clients"),
        F.sum("kept").alias("kept"),
        F.min("nearest").alias("nearest"),
        F.array_sort(F.flatten(F.collect_list("far"))).alias("far"),
    )
    keep = F.greatest(F.lit(0), F.size("far") - drop)
    rest = F.aggregate(F.slice("far", F.lit(1), keep), F.lit(0.0), lambda s, v: s + v)
    return merged.select(
        "round", "client_id", "n_clients", (F.col("kept") + rest).alias("score"), F.sqrt("nearest").alias("nearest_distance")
    )


def krum_select(df: DataFrame, byzantine: int, select: Column | int | None = None, min_clients: int | None = None) -> DataFrame:
    """(round, client_id) of the clients with the smallest scores; small rounds keep everyone."""
    f = byzantine
    need = 2 * f + 3 if min_clients is None else min_clients
    m = F.col("n_clients") - f - 1 if select is None else (F.lit(select) if isinstance(select, int) else select)
    m = F.least(m, F.col("n_clients"))
    # small rounds want all their clients; the scores are read several times
    wanted = F.when(F.col("n_clients") < need, F.col("n_clients")).otherwise(m)
    scores = materialize(krum_scores(df, f).withColumn("wanted", wanted.cast("long")), "krum-scores")
    return smallest(scores, ["round"], "score", "client_id", "wanted").select("round", "client_id")


def multi_krum(df: DataFrame, byzantine: int = 0, select: int | None = None) -> DataFrame:
    """Weighted mean of the selected clients; too few clients fall back to the plain mean."""
    return fedavg(df.join(krum_select(df, byzantine, select), ["round", "client_id"], "left_semi"))


# --- coordinate-wise statistics ---------------------------------------------------------


#: Coordinates a block holds at most, and the bytes its matrix may take in a task.
BLOCK_COORDS, MATRIX_BYTES = 1024, 64 << 20


def by_blocks(df: DataFrame, statistic: Callable[[np.ndarray], np.ndarray]) -> tuple[DataFrame, DataFrame]:
    """((round, coord, value) of all rounds that can be taken by blocks of coordinates, the rows of the others).

    A client's vector is cut into blocks; one task has all clients of a round for a block, as a matrix, and ``statistic``
    makes one value a column. The more clients, the fewer coordinates a block has, MATRIX_BYTES in all; a round with
    more clients than MATRIX_BYTES hold of one coordinate is left to the caller.
    """
    most = MATRIX_BYTES // 8
    sized = with_totals(df, round_sizes(df), ["round"])
    width = F.least(F.lit(BLOCK_COORDS), F.floor(F.lit(most) / F.col("n_clients"))).cast("int")
    small = sized.where(F.col("n_clients") <= most).withColumn("_width", width).where(F.size("weights") > 0)
    starts = F.sequence(F.lit(0), F.floor((F.size("weights") - 1) / F.col("_width")).cast("int"))
    cut = F.transform(starts, lambda b: F.struct((b * F.col("_width")).alias("start"), F.slice("weights", b * F.col("_width") + 1, F.col("_width")).alias("w")))
    blocks = small.select("round", F.explode(cut).alias("c")).select("round", "c.start", F.col("c.w").alias("w"))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        value = statistic(np.vstack([np.asarray(v, dtype=np.float64) for v in pdf["w"]]))
        return pd.DataFrame({"round": key[0], "coord": np.arange(key[1], key[1] + len(value), dtype=np.int32), "value": value})

    done = blocks.groupBy("round", "start").applyInPandas(run, f"round {df.schema['round'].dataType.simpleString()}, coord int, value double")
    return done, sized.where(F.col("n_clients") > most).drop("n_clients")


def trimmed_mean(df: DataFrame, ratio: float = 0.1) -> DataFrame:
    """Unweighted mean without the t lowest and highest values of each coordinate; rounds of at most 2t clients take the weighted mean.

    Rounds go by blocks of coordinates. For a round too large for that, a value's share of the kept positions is
    arithmetic on its running count, and nothing has to fit into one task.
    """
    sizes = round_sizes(df)
    t = F.greatest(F.lit(1), F.floor(F.col("n_clients") * F.lit(float(ratio))))
    sized = materialize(sizes.withColumn("t", t), "round-sizes")
    tiny = sized.where(F.col("n_clients") <= 2 * F.col("t")).select("round")
    normal = sized.where(F.col("n_clients") > 2 * F.col("t"))

    def mean(matrix: np.ndarray) -> np.ndarray:
        cut = max(1, int(len(matrix) * ratio))
        return np.partition(matrix, (cut, len(matrix) - cut - 1), axis=0)[cut : len(matrix) - cut].mean(axis=0)

    trimmed, large = by_blocks(df.join(normal.select("round"), "round", "left_semi"), mean)
    out = trimmed.unionByName(fedavg(df.join(tiny, "round", "left_semi")))
    if normal.where(F.col("n_clients") > MATRIX_BYTES // 8).isEmpty():
        return out
    counts = value_counts(coordinates(large), ["round", "coord"], "w")
    run = with_totals(ordered_prefix(counts, ["round", "coord"], "w", ["m"]), normal, ["round"])
    kept = F.greatest(
        F.lit(0), F.least(F.col("cum_m"), F.col("n_clients") - F.col("t")) - F.greatest(F.col("cum_m") - F.col("m"), F.col("t"))
    )
    return out.unionByName(run.groupBy("round", "coord").agg((F.sum(F.col("w") * kept) / F.sum(kept)).alias("value")))


def coordinate_median(df: DataFrame) -> DataFrame:
    """Median of each coordinate, by blocks; rounds too large for a block by exact quantiles over ranges."""
    done, large = by_blocks(df, lambda matrix: np.median(matrix, axis=0))
    if round_sizes(df).where(F.col("n_clients") > MATRIX_BYTES // 8).isEmpty():
        return done
    return done.unionByName(exact_quantiles(coordinates(large), ["round", "coord"], "w", {"value": 0.5}))


def bulyan(df: DataFrame, byzantine: int = 0, ratio: float = 0.25) -> DataFrame:
    """Distance-based selection of 2(n - 2f - 2) clients, then the trimmed mean; small rounds use Multi-Krum.

    One selection pass serves both kinds of round; its (round, client_id) rows are
    written once because three aggregations read them.
    """
    f, n = byzantine, F.col("n_clients")
    m = F.when(n >= 4 * f + 3, 2 * (n - 2 * f - 2)).when(n >= 2 * f + 3, n - f - 1).otherwise(n)
    chosen = materialize(krum_select(df, f, m, 0), "selection")
    kept = df.join(chosen, ["round", "client_id"], "left_semi")
    big = round_sizes(df).where(n >= 4 * f + 3).select("round")
    return trimmed_mean(kept.join(big, "round", "left_semi"), ratio).unionByName(fedavg(kept.join(big, "round", "left_anti")))


# --- private aggregation, dispatch, fault injection ----------------------------------------


def dp_fedavg(df: DataFrame, clip: float, noise_multiplier: float, seed: int | None = None) -> DataFrame:
    """Clip each client's whole vector, weighted mean, Gaussian noise per coordinate."""
    mean = fedavg(clip_clients(df, clip))
    return mean.withColumn("value", F.col("value") + noise.gaussian(noise_multiplier * clip, seed))


def clip_clients(df: DataFrame, clip: float) -> DataFrame:
    return df.withColumn("weights", vectors.clip_l2(F.col("weights"), clip))


def clip_layers(df: DataFrame, layer_sizes: list[int], clip: float) -> DataFrame:
    """Local variant: each layer of the flattened vector is clipped on its own."""
    parts, at = [], 1
    for size in layer_sizes:
        parts.append(vectors.clip_l2(F.slice("weights", at, size), clip))
        at += size
    return df.withColumn("weights", F.concat(*parts))


METHODS: dict[str, Callable[..., DataFrame]] = {
    "fedavg": fedavg,
    "krum": multi_krum,
    "multi_krum": multi_krum,
    "trimmed_mean": trimmed_mean,
    "median": coordinate_median,
    "coordinate_median": coordinate_median,
    "bulyan": bulyan,
    "dp_fedavg": dp_fedavg,
}


def robust_aggregate(df: DataFrame, method: str, **options: object) -> DataFrame:
    """Aggregate by name; an unknown name raises instead of silently averaging."""
    key = method.lower().replace("-", "_")
    if key not in METHODS:
        raise ValueError(f"unknown method {method}; choose one of {sorted(METHODS)}")
    return METHODS[key](df, **options)


# default strength of each attack
ATTACKS = {"random": 10.0, "sign_flip": 1.0, "scale": 100.0, "label_flip": 1.0}


def inject_outliers(
    df: DataFrame, attack: str, attackers: Column, strength: float | None = None, seed: int = 42
) -> DataFrame:
    """Replace the vectors of attacking clients, for tests of the robust methods."""
    if attack not in ATTACKS:
        raise ValueError(f"unknown attack {attack}")
    k = F.lit(float(ATTACKS[attack] if strength is None else strength))
    w = vectors.as_double("weights")
    if attack == "random":
        draw = lambda v, i: F.pmod(F.xxhash64(F.lit(seed), F.col("client_id"), i), F.lit(2_000_001)) / 1e6 - 1
        bad = F.transform(w, lambda v, i: draw(v, i) * k)
    elif attack == "scale":
        bad = vectors.scale(w, k)
    else:
        bad = vectors.scale(w, -k)
    return df.withColumn("weights", F.when(attackers, bad).otherwise(w))


def round_averages(df: DataFrame, metrics: list[str]) -> DataFrame:
    """Mean of each reported metric over the clients that report it."""
    return df.groupBy("round").agg(*[F.avg(m).alias(m) for m in metrics], F.count(F.lit(1)).alias("n_clients"))
