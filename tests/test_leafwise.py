"""Leaf-wise boosting against a plain numpy version, and its stages saved and loaded."""

import math

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import functions as F

from ledgerveil.operators import evaluate, leafwise

SETTINGS = leafwise.Settings(trees=4, leaves=7, bins=16, rate=0.3, least_rows=5)


def data(n=1200, seed=0):
    r = np.random.default_rng(seed)
    x = np.column_stack([r.normal(size=n), r.integers(0, 5, n), np.round(r.exponential(size=n), 2), np.zeros(n)])
    y = ((x[:, 0] > 0.3) & (x[:, 2] < 1) | (x[:, 1] == 3) & (r.random(n) < 0.7)).astype(float)
    return x, y, np.where(y > 0, 2.0, 1.0)


def frame(spark, x, y, w, parts):
    rows = [(*map(float, a), float(b), float(c)) for a, b, c in zip(x, y, w, strict=True)]
    return spark.createDataFrame(rows, "a double, b double, c double, d double, label double, weight double").repartition(parts)


def plain(x, y, w, s):
    """Splits (feature, bin) of each tree in order of parents, grown one leaf at a time by whole-number sums."""
    cuts = []
    for f in range(x.shape[1]):
        q = np.percentile(x[:, f], [100 * i / s.bins for i in range(1, s.bins)])
        cuts.append(sorted({v for v in q if v > x[:, f].min()}))
    bins = np.column_stack([np.searchsorted(c, x[:, f], side="right") if c else np.zeros(len(x), int) for f, c in enumerate(cuts)])
    unit = leafwise.FRACTION
    half_up = lambda v: (np.sign(v) * np.floor(np.abs(v) + 0.5)).astype(np.int64)
    share = half_up(w * y * unit).sum() / half_up(w * unit).sum()
    margin = np.full(len(y), math.log(share / (1 - share)))
    out, gains = [], np.zeros(x.shape[1])
    for _ in range(s.trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = half_up(w * (p - y) * unit), half_up(w * p * (1 - p) * unit)
        worth = lambda r: (g[r].sum() / unit) ** 2 / (h[r].sum() / unit + s.penalty)

        def best(rows):
            found = None
            for f in range(x.shape[1]):
                for b in sorted(set(bins[rows, f]))[:-1]:
                    left, right = rows[bins[rows, f] <= b], rows[bins[rows, f] > b]
                    if min(len(left), len(right)) < s.least_rows or min(h[left].sum(), h[right].sum()) / unit < s.least_hessian:
                        continue
                    gain = worth(left) + worth(right) - worth(rows)
                    if gain > 1e-9 and (found is None or gain > found[0]):
                        found = gain, f, int(b), left, right
            return found

        leaves = [{"rows": np.arange(len(y)), "tree": {}}]
        root = leaves[0]["tree"]
        leaves[0]["best"] = best(leaves[0]["rows"])
        while len(leaves) < s.leaves and any(x["best"] for x in leaves):
            at = max((x for x in leaves if x["best"]), key=lambda x: x["best"][0])
            leaves = [v for v in leaves if v is not at]
            gain, f, b, left, right = at["best"]
            gains[f] += gain
            at["tree"] |= {"split": (f, b), "left": {}, "right": {}}
            for rows, tree in ((left, at["tree"]["left"]), (right, at["tree"]["right"])):
                leaves.append({"rows": rows, "tree": tree, "best": best(rows)})
        for x_ in leaves:
            r = x_["rows"]
            margin[r] -= s.rate * (g[r].sum() / unit) / (h[r].sum() / unit + s.penalty)

        def splits(t):
            return [t["split"], *splits(t["left"]), *splits(t["right"])] if "split" in t else []

        out.append(splits(root))
    return out, gains, 1 / (1 + np.exp(-margin))


@pytest.mark.parametrize("parts", [1, 64])
def test_same_splits_as_plain_version(spark, parts):
    x, y, w = data()
    model = leafwise.fit(frame(spark, x, y, w, parts), list("abcd"), settings=SETTINGS)
    want, gains, p = plain(x, y, w, SETTINGS)
    assert [t.splits() for t in model.trees] == want
    assert np.allclose(model.gains, gains) and sum(len(t) for t in want) == 4 * 6
    scored = leafwise.LeafwiseModel(document=model.document()).transform(frame(spark, x, y, w, 3))
    got = sorted((r.a, r.b, r.c, round(r.score, 9)) for r in scored.collect())
    assert got == sorted((*map(float, a[:3]), round(float(b), 9)) for a, b in zip(x, p, strict=True))
    assert leafwise.importance(model)[-1] == ("d", 0.0)


def test_early_stopping_and_held_out_area(spark):
    x, y, w = data(3000, 1)
    df = frame(spark, x, y, w, 4).withColumn("split", F.pmod(F.xxhash64("a", "c"), F.lit(4)))
    settings = leafwise.Settings(trees=30, leaves=8, bins=32, rate=0.5, patience=3)
    model = leafwise.fit(df.where("split < 3").withColumn("val", F.col("split") == 2), list("abcd"), validation="val", settings=settings)
    assert len(model.trees) < 30 and model.losses[len(model.trees) - 1] == min(model.losses)
    held = leafwise.LeafwiseModel(document=model.document()).transform(df.where("split = 3"))
    assert evaluate.ranking_metrics(held.withColumn("y", F.col("label") == 1), "y", "score").first()["roc_auc"] > 0.85


def test_stage_is_saved_and_loaded(spark, tmp_path):
    x, y, w = data(600, 2)
    df = frame(spark, x, y, w, 2)
    fitted = Pipeline(stages=[leafwise.Leafwise(list("abcd"), settings=leafwise.Settings(trees=2, leaves=4))]).fit(df)
    fitted.write().overwrite().save(str(tmp_path / "m"))
    loaded = PipelineModel.load(str(tmp_path / "m"))
    nulls = df.select(F.lit(None).cast("double").alias("a"), F.lit(float("nan")).alias("b"), "c", "d")
    for rows in (df, nulls):
        assert [r.score for r in loaded.transform(rows).collect()] == [r.score for r in fitted.transform(rows).collect()]


def test_degenerate_tables(spark):
    x, y, w = data(40)
    one = leafwise.fit(frame(spark, x, np.ones(40), w, 2), list("abcd"), settings=SETTINGS)
    assert one.trees and one.trees[0].left is None or one.base > 10
    none = leafwise.fit(frame(spark, x, y, w, 2).where("label > 9"), list("abcd"), settings=SETTINGS)
    assert none.trees[0].left is None


def test_passes_read_cells_and_not_rows(spark, monkeypatch):
    """Forty copies of a table make the same cells; the trees are those of the copies, and of weights by hand."""
    x, y, w = data(150, 3)
    x[:, 0] = np.round(x[:, 0])
    settings = leafwise.Settings(trees=2, leaves=4, bins=16, rate=0.3, least_rows=5)
    seen, plain_histograms = [], leafwise._histograms

    def counted(rows, *args):
        seen.append(rows.count())
        return plain_histograms(rows, *args)

    monkeypatch.setattr(leafwise, "_histograms", counted)
    many = [np.concatenate([a] * 40) for a in (x, y, w)]
    model = leafwise.fit(frame(spark, *many, 8), list("abcd"), settings=settings)
    assert 0 < max(seen) <= 150
    want, gains, _ = plain(*many, settings)
    assert [t.splits() for t in model.trees] == want and np.allclose(model.gains, gains)


@pytest.mark.parametrize("same", [0.0, 0.9])
def test_cuts_of_a_sample_are_those_of_the_smallest_hashes(spark, same):
    """Also when one value makes up most rows, so that the hashes below the threshold are too few."""
    r = np.random.default_rng(5)
    v = np.where(r.random(2000) < same, 1.0, r.normal(size=2000))
    df = spark.createDataFrame([(float(a),) for a in v], "a double").repartition(4)
    some = df.orderBy(F.xxhash64("a"), "a").limit(100)
    q = some.agg(F.percentile("a", F.array(*[F.lit(i / 16) for i in range(1, 16)])).alias("q"), F.min("a").alias("low")).first()
    assert leafwise.quantile_cuts(df, ["a"], 16, sample=100) == [sorted({c for c in q["q"] if c > q["low"]})]
