"""Leaf-wise gradient boosting on histograms, the same trees for any partitioning.

Features are cut into quantile bins of a bounded sample. A tree grows from the leaf of the largest gain; what a leaf needs
is one row of sums for each (leaf, feature, bin), made by one aggregate over all rows, so that the driver only sees leaves
x features x bins sums. Gradients and hessians are summed as whole numbers (FRACTION of one), which makes sums, gains and
splits independent of the order of rows. An aggregate covers the children of all leaves that may be split next, the
smaller child of each; the larger one is the difference to its parent. Rows with equal bins, label and weight have equal
gradients for ever, so they are folded into one cell with their number before the first tree: every later pass reads cells.
"""

from __future__ import annotations

import heapq
import json
import math
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.feature import Bucketizer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerveil.plans.sizing import lowest_hashed
from ledgerveil.session import materialize

#: Bins are cut at quantiles of so many rows at most, those of the smallest hashed values.
SAMPLE = 100_000
#: Gradients are summed in these parts of one.
FRACTION = 1 << 20


@dataclass
class Node:
    """A leaf, or a split: rows whose bin of ``feature`` is at most ``bin`` go left."""

    number: int
    feature: int = -1
    bin: int = -1
    value: float = 0.0
    left: Node | None = None
    right: Node | None = None

    def route(self, bins: Sequence[Column], leaf: str = "value") -> Column:
        """Leaf value (or leaf number) as an expression of the bin columns."""
        if self.left is None:
            return F.lit(self.value if leaf == "value" else self.number)
        return F.when(bins[self.feature] <= self.bin, self.left.route(bins, leaf)).otherwise(self.right.route(bins, leaf))

    def splits(self) -> list[tuple[int, int]]:
        """(feature, bin) of all splits, parents before children."""
        return [] if self.left is None else [(self.feature, self.bin), *self.left.splits(), *self.right.splits()]

    def plain(self, cuts: list[list[float]]) -> dict:
        if self.left is None:
            return {"value": self.value}
        return {"feature": self.feature, "below": cuts[self.feature][self.bin], "left": self.left.plain(cuts), "right": self.right.plain(cuts)}


@dataclass
class Settings:
    trees: int = 40
    leaves: int = 15
    bins: int = 64
    rate: float = 0.1
    penalty: float = 1.0
    least_hessian: float = 1e-3
    least_rows: int = 20
    patience: int = 5


@dataclass
class Booster:
    """Trees with their cuts, what they gained, and the loss on the validation rows after each."""

    features: list[str]
    cuts: list[list[float]]
    base: float
    trees: list[Node] = field(default_factory=list)
    gains: list[float] = field(default_factory=list)
    losses: list[float] = field(default_factory=list)

    def document(self) -> str:
        return json.dumps({"features": self.features, "base": self.base, "gains": self.gains, "trees": [t.plain(self.cuts) for t in self.trees]})


def quantile_cuts(df: DataFrame, features: Sequence[str], bins: int, sample: int = SAMPLE) -> list[list[float]]:
    """Distinct cut points of each feature, at most ``bins`` - 1, between values of the sample; equal for any partitioning."""
    rows = df.select(*features)
    some = lowest_hashed(rows, features, sample, rows.count())
    shares = F.array(*[F.lit(i / bins) for i in range(1, bins)])
    row = some.agg(*[F.struct(F.percentile(f, shares).alias("at"), F.min(f).alias("low")).alias(f) for f in features]).first()
    return [sorted({v for v in row[f]["at"] or [] if v > row[f]["low"]}) for f in features]


def _binned(df: DataFrame, features: Sequence[str], cuts: list[list[float]]) -> DataFrame:
    """b0, b1, ...: how many cuts are at or below each value."""
    some = [i for i, c in enumerate(cuts) if c]
    out = df
    if some:
        out = Bucketizer(inputCols=[features[i] for i in some], outputCols=[f"b{i}" for i in some], splitsArray=[[-math.inf, *cuts[i], math.inf] for i in some], handleInvalid="keep").transform(df)
    return out.withColumns({f"b{i}": F.col(f"b{i}").cast("int") if c else F.lit(0) for i, c in enumerate(cuts)})


def _histograms(rows: DataFrame, tree: Node, wanted: set[int], n_features: int, g: Column, h: Column) -> dict[int, np.ndarray]:
    """{leaf number: sums (features, bins, 3) of gradient, hessian and rows} by one aggregate."""
    leaf = tree.route([F.col(f"b{i}") for i in range(n_features)], "number")
    each = rows.select(leaf.alias("leaf"), (g * F.col("n")).alias("g"), (h * F.col("n")).alias("h"), "n", *[f"b{i}" for i in range(n_features)]).where(F.col("leaf").isin(sorted(wanted)))
    cells = F.explode(F.array(*[F.struct(F.lit(i).alias("feature"), F.col(f"b{i}").alias("bin")) for i in range(n_features)])).alias("c")
    sums = each.select("leaf", "g", "h", "n", cells).groupBy("leaf", "c.feature", "c.bin").agg(*[F.sum(c).alias(c) for c in ("g", "h", "n")]).collect()
    out: dict[int, dict] = {}
    for r in sums:
        out.setdefault(r["leaf"], {})[r["feature"], r["bin"]] = (r["g"], r["h"], r["n"])
    return out


def _sub(whole: dict, part: dict) -> dict:
    left = {k: tuple(a - b for a, b in zip(v, part.get(k, (0, 0, 0)), strict=True)) for k, v in whole.items()}
    return {k: v for k, v in left.items() if v[2]}


def _total(hist: dict) -> tuple[int, int, int]:
    """Sums of a leaf: those of its first feature's bins."""
    return tuple(sum(v[i] for (f, _), v in hist.items() if f == 0) for i in range(3))


def best_split(hist: dict, n_features: int, s: Settings) -> tuple[float, int, int, tuple, tuple] | None:
    """(gain, feature, bin, sums left, sums right) of the best split; ties go to the first feature and bin."""
    whole = _total(hist)
    worth = lambda t: (t[0] / FRACTION) ** 2 / (t[1] / FRACTION + s.penalty)
    best = None
    for f in range(n_features):
        left = (0, 0, 0)
        for b in sorted(b for (i, b) in hist if i == f)[:-1]:
            left = tuple(a + x for a, x in zip(left, hist[f, b], strict=True))
            right = tuple(a - x for a, x in zip(whole, left, strict=True))
            if min(left[2], right[2]) < s.least_rows or min(left[1], right[1]) / FRACTION < s.least_hessian:
                continue
            gain = worth(left) + worth(right) - worth(whole)
            if gain > 1e-9 and (best is None or gain > best[0]):
                best = gain, f, b, left, right
    return best


def grow(rows: DataFrame, n_features: int, g: Column, h: Column, s: Settings, gains: list[float]) -> Node:
    """One tree, best leaf first; adds each feature's gain to ``gains``. ``rows`` are cells of n rows each."""
    root = Node(0)
    hists = {0: _histograms(rows, root, {0}, n_features, g, h).get(0, {})}
    value = lambda t: -s.rate * (t[0] / FRACTION) / (t[1] / FRACTION + s.penalty)
    if not hists[0]:
        return root
    root.value = value(_total(hists[0]))
    nodes, queue, ahead, counter = {0: root}, [], {}, 1

    def push(k: int) -> None:
        split = best_split(hists[k], n_features, s)
        if split:
            heapq.heappush(queue, (-split[0], k, split[1:]))

    push(0)
    leaves = 1
    while queue and leaves < s.leaves:
        if queue[0][1] not in ahead:
            # one aggregate over the smaller children of every leaf that may be split before the tree is full
            todo = [(k, split) for _, k, split in heapq.nsmallest(s.leaves - leaves, queue) if k not in ahead]
            smaller = {}
            for k, (f, b, left, right) in todo:
                node = nodes[k]
                node.feature, node.bin = f, b
                node.left, node.right = Node(counter), Node(counter + 1)
                ahead[k] = (node.left, node.right)
                smaller[k] = counter if left[2] <= right[2] else counter + 1
                counter += 2
            found = _histograms(rows, root, set(smaller.values()), n_features, g, h)
            for k, small in smaller.items():
                low, high = (n.number for n in ahead[k])
                hists[small] = found.get(small, {})
                hists[high if small == low else low] = _sub(hists[k], hists[small])
                nodes[k].left = nodes[k].right = None  # still a leaf until its turn comes
                del hists[k]
        gain, k, (f, b, left, right) = heapq.heappop(queue)
        node = nodes[k]
        node.left, node.right = ahead.pop(k)
        for child, sums in ((node.left, left), (node.right, right)):
            child.value, nodes[child.number] = value(sums), child
            push(child.number)
        gains[f] -= gain
        leaves += 1
    return root


def fit(df: DataFrame, features: Sequence[str], label: str = "label", weight: str | None = "weight", validation: str | None = None, settings: Settings | None = None) -> Booster:
    """Boost trees on the rows of ``df`` (numeric features without nulls, label 0 or 1).

    With ``validation`` (a boolean column), those rows are not trained on; boosting stops after ``patience`` trees without a
    smaller loss on them and keeps the trees up to the smallest loss.
    """
    s = settings or Settings()
    n = len(features)
    train = ~F.col(validation) if validation else F.lit(True)
    some = df.select(*[F.col(f).cast("double").alias(f"x{i}") for i, f in enumerate(features)], F.col(label).cast("double").alias("y"), (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("w"), train.alias("train"))
    names = [f"x{i}" for i in range(n)]
    cuts = quantile_cuts(some.where("train"), names, s.bins)
    state = materialize(_binned(some, names, cuts).groupBy(*[f"b{i}" for i in range(n)], "y", "w", "train").agg(F.count(F.lit(1)).alias("n")), "leafwise")
    whole = lambda c: F.round(c * FRACTION).cast("long")
    sums = state.where("train").agg(F.sum(whole(F.col("w") * F.col("y")) * F.col("n")).alias("p"), F.sum(whole(F.col("w")) * F.col("n")).alias("w")).first()
    share = min(max((sums["p"] or 0) / max(sums["w"] or 1, 1), 1e-6), 1 - 1e-6)
    out = Booster(list(features), cuts, math.log(share / (1 - share)), gains=[0.0] * n)
    state, margin = state.withColumn("margin", F.lit(out.base)), F.col("margin")
    bins = [F.col(f"b{i}") for i in range(n)]
    best = math.inf
    for _ in range(s.trees):
        p = 1 / (1 + F.exp(-margin))
        g, h = whole(F.col("w") * (p - F.col("y"))), whole(F.col("w") * p * (1 - p))
        tree = grow(state.where("train"), n, g, h, s, out.gains)
        out.trees.append(tree)
        state = materialize(state.withColumn("margin", margin + tree.route(bins)), "leafwise")
        if validation:
            q = F.least(F.greatest(1 / (1 + F.exp(-margin)), F.lit(1e-12)), F.lit(1 - 1e-12))
            loss = state.where("NOT train").agg(F.sum(whole(-F.when(F.col("y") > 0.5, F.log(q)).otherwise(F.log(1 - q))) * F.col("n")).alias("l"), F.sum("n").alias("n")).first()
            out.losses.append((loss["l"] or 0) / FRACTION / max(loss["n"] or 0, 1))
            best = min(best, out.losses[-1])
            if len(out.losses) - 1 - out.losses.index(best) >= s.patience:
                break
        if tree.left is None:
            break
    if validation and out.losses:
        del out.trees[out.losses.index(best) + 1 :]
    return out


def importance(model: Booster) -> list[tuple[str, float]]:
    """(feature, share of the total gain), largest first."""
    total = sum(model.gains) or 1.0
    return sorted(((f, g / total) for f, g in zip(model.features, model.gains, strict=True)), key=lambda x: (-x[1], x[0]))


def _values(node: dict, x: np.ndarray, rows: np.ndarray, out: np.ndarray) -> None:
    if "value" in node:
        out[rows] += node["value"]
        return
    left = x[rows, node["feature"]] < node["below"]
    _values(node["left"], x, rows[left], out)
    _values(node["right"], x, rows[~left], out)


class LeafwiseModel(Model, DefaultParamsReadable, DefaultParamsWritable):
    """A fitted booster as a pipeline stage: adds the probability of label 1; nulls and NaN count as 0. Saved and loaded like any stage."""

    document = Param(Params._dummy(), "document", "trees as JSON", TypeConverters.toString)
    outputCol = Param(Params._dummy(), "outputCol", "column of the probability", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, document: str = "{}", outputCol: str = "score") -> None:  # noqa: N803
        super().__init__()
        self._setDefault(document="{}", outputCol="score")
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        model = json.loads(self.getOrDefault(self.document))

        @F.pandas_udf("double")
        def score(*columns: pd.Series) -> pd.Series:
            x = np.column_stack([c.to_numpy(dtype=float) for c in columns])
            margin = np.full(len(x), model["base"])
            for tree in model["trees"]:
                _values(tree, x, np.arange(len(x)), margin)
            return pd.Series(1 / (1 + np.exp(-margin)))

        clean = [F.coalesce(F.nanvl(F.col(f).cast("double"), F.lit(0.0)), F.lit(0.0)) for f in model["features"]]
        return df.withColumn(self.getOrDefault(self.outputCol), score(*clean))


class Leafwise(Estimator):
    """The booster as an estimator over named columns, for pipelines and ensembles."""

    def __init__(self, features: Sequence[str], output: str = "score", label: str = "label", weight: str | None = None, validation: str | None = None, settings: Settings | None = None) -> None:
        super().__init__()
        self.features, self.output, self.label, self.weight, self.validation, self.settings = list(features), output, label, weight, validation, settings
        self.booster: Booster | None = None

    def _fit(self, df: DataFrame) -> LeafwiseModel:
        self.booster = fit(df, self.features, self.label, self.weight, self.validation, self.settings)
        return LeafwiseModel(document=self.booster.document(), outputCol=self.output)
