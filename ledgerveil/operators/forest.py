"""Isolation forest: trees grown per sample in tasks, scored on Arrow batches."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerveil.operators import evaluate
from ledgerveil.operators.models import clean_value
from ledgerveil.plans.ranking import with_totals
from ledgerveil.plans.sizing import bounded_rows, spread

SAMPLE = 256
TREES = 200
# --- fixed values: thresholds tried on validation scores -------------------------------------
THRESHOLDS = [round(0.1 + 0.05 * i, 2) for i in range(17)]
# -----------------------------------------------------------------------------------------------

_NODES = "tree int, feature array<int>, cut array<double>, left array<int>, right array<int>, size array<int>"


def average_path(n: float) -> float:
    """Mean depth of an unsuccessful search among n points."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1.0) + 0.5772156649015329) - 2.0 * (n - 1.0) / n


def _grow(x: np.ndarray, limit: int, rng: np.random.Generator) -> tuple[list, list, list, list, list]:
    feature, cut, left, right, size = [], [], [], [], []

    def add() -> int:
        for lst, v in ((feature, -1), (cut, 0.0), (left, -1), (right, -1), (size, 0)):
            lst.append(v)
        return len(feature) - 1

    todo = [(add(), x, 0)]
    while todo:
        at, rows, depth = todo.pop()
        size[at] = len(rows)
        if depth >= limit or len(rows) <= 1:
            continue
        lo, hi = rows.min(axis=0), rows.max(axis=0)
        usable = np.flatnonzero(hi > lo)
        if not len(usable):
            continue
        f = int(rng.choice(usable))
        c = float(rng.uniform(lo[f], hi[f]))
        go = rows[:, f] < c
        feature[at], cut[at], left[at], right[at] = f, c, add(), add()
        todo += [(left[at], rows[go], depth + 1), (right[at], rows[~go], depth + 1)]
    return feature, cut, left, right, size


def _coprime(n: int) -> int:
    """A stride through 0..n-1 that meets every number."""
    return next(k for k in range(max(1, int(n * 0.618)), n + 2) if math.gcd(k, n) == 1)


def fit(df: DataFrame, features: Sequence[str], trees: int = TREES, sample: int = SAMPLE, seed: int = 42, key: Sequence[str] | None = None) -> DataFrame:
    """One row per tree, grown on at most ``sample`` rows drawn at random for it.

    Each row draws how many trees it goes to, at a mean of 1.3 * sample * trees / rows, and where a stride through the
    trees starts, so no tree gets it twice. The rate alone follows the table's size: small and large tables take one
    path, and about 1.3 * sample rows reach a tree. With ``key``, columns that tell rows apart, the draw is a hash of them and the
    forest does not depend on partitions; without, it is the same for the same seed and the same partitions.
    """
    feats = list(features)
    bits = 1 << 31
    if key:
        uniform = lambda s: F.pmod(F.xxhash64(F.lit(s), *key), F.lit(bits)) / bits
        place = F.xxhash64(F.lit(seed + 2), *key)
    else:
        uniform, place = F.rand, F.monotonically_increasing_id()
    base = df.select(*[clean_value(f) for f in feats], uniform(seed).alias("_u"), uniform(seed + 1).alias("_v"), place.alias("_h"))
    mean = min(1.0, 1.3 * sample / max(base.count(), 1)) * trees
    offers = F.floor(F.lit(mean)) + (F.col("_u") < F.lit(mean - math.floor(mean))).cast("long")
    drawn = base.select("*", offers.alias("_n"), F.floor(F.col("_v") * trees).alias("_t")).where("_n > 0")
    drawn = drawn.withColumn("_k", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n"))))
    tree = F.pmod(F.col("_t") + F.col("_k") * F.lit(_coprime(trees)), F.lit(trees)).cast("int")
    offered = drawn.withColumn("tree", tree).drop("_n", "_t", "_k", "_u", "_v")
    limit = math.ceil(math.log2(max(sample, 2)))

    def grow(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        rng = np.random.default_rng(seed * 100_003 + int(key[0]))
        x = pdf.sort_values("_h", kind="stable")[feats].to_numpy(float)
        if len(x) > sample:
            x = x[rng.permutation(len(x))[:sample]]
        f, c, le, r, s = _grow(x, limit, rng)
        return pd.DataFrame({"tree": [key[0]], "feature": [f], "cut": [c], "left": [le], "right": [r], "size": [s]})

    return offered.groupBy("tree").applyInPandas(grow, _NODES)


def anomaly_scores(df: DataFrame, forest: DataFrame, features: Sequence[str], sample: int = SAMPLE, out: str = "raw_score") -> DataFrame:
    """Add the usual 2^(-depth / c) score; the forest (trees x at most 2 * sample nodes) is broadcast."""
    feats = list(features)
    trees = [
        tuple(np.asarray(r[k]) for k in ("feature", "cut", "left", "right", "size"))
        for r in bounded_rows(forest, 10_000, "forest")
    ]
    shared = df.sparkSession.sparkContext.broadcast(trees)
    norm = average_path(sample)
    extra = np.array([average_path(i) for i in range(sample + 1)])

    @F.pandas_udf("double")
    def depth_score(x: pd.DataFrame) -> pd.Series:
        m = x.to_numpy(float)
        total = np.zeros(len(m))
        for feature, cut, left, right, size in shared.value:
            at = np.zeros(len(m), dtype=int)
            depth = np.zeros(len(m))
            live = np.flatnonzero(feature[at] >= 0)
            while len(live):
                node = at[live]
                go = m[live, feature[node]] < cut[node]
                at[live] = np.where(go, left[node], right[node])
                depth[live] += 1
                live = live[feature[at[live]] >= 0]
            total += depth + extra[np.minimum(size[at], sample)]
        return pd.Series(np.power(2.0, -(total / max(len(shared.value), 1)) / norm))

    return spread(df).withColumn(out, depth_score(F.struct(*[clean_value(f) for f in feats])))


def scaled(df: DataFrame, raw: str = "raw_score", out: str = "score") -> DataFrame:
    """Min-max scale to [0, 1]; higher is more anomalous."""
    b = df.agg(F.min(raw).alias("_lo"), F.max(raw).alias("_hi"))
    s = F.when(F.col("_hi") > F.col("_lo"), (F.col(raw) - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).otherwise(0.0)
    return with_totals(df, b, []).withColumn(out, s).drop("_lo", "_hi")


def threshold_table(df: DataFrame, label: str, score: str) -> DataFrame:
    """F1 at each of the fixed thresholds, from one aggregate over the score table."""
    t = evaluate.score_table(df, label, score)
    cells = F.explode(F.array(*[F.lit(x) for x in THRESHOLDS])).alias("cutoff")
    hit = F.col("threshold") >= F.col("cutoff")
    g = t.select("threshold", "pos", "neg", cells).groupBy("cutoff").agg(
        F.sum(F.when(hit, F.col("pos")).otherwise(0)).alias("tp"),
        F.sum(F.when(hit, F.col("neg")).otherwise(0)).alias("fp"),
        F.sum(F.when(~hit, F.col("pos")).otherwise(0)).alias("fn"),
    )
    return g.select(
        F.col("cutoff").alias("threshold"),
        F.coalesce(F.try_divide(2.0 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), F.lit(0.0)).alias("f1"),
    )
