"""The m smallest rows of each group without sorting a group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerveil.plans.ranking import _join_keys
from ledgerveil.session import materialize

#: Cells of a histogram, refinements, and rows of a group below which refining further gains nothing.
CELLS, REFINEMENTS, FEW = 1024, 4, 10_000


def ordered_rank(df: DataFrame, keys: list[str], order: list[str], rank: str = "rank") -> DataFrame:
    """Exact 1-based rank of rows in their group: rows are dealt out by ranges of (keys, order), counted, and the counts carried forward."""
    ranged = df.repartitionByRange(*[F.col(c) for c in [*keys, *order]]).withColumn("_b", F.spark_partition_id())
    placed = materialize(ranged, "ranges")
    sizes = placed.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_m"))
    run = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    before = sizes.select(*keys, "_b", (F.sum("_m").over(run) - F.col("_m")).alias("_before"))
    local = placed.withColumn("_r", F.row_number().over(Window.partitionBy(*keys, "_b").orderBy(*order)))
    return _join_keys(local, before, [*keys, "_b"]).withColumn(rank, F.col("_before") + F.col("_r")).drop("_b", "_before", "_r")


def smallest(df: DataFrame, keys: list[str], value: str, tie: str, wanted: str) -> DataFrame:
    """Rows of each group with the ``wanted`` (a column, equal in a group) smallest values, ties by ``tie``.

    Histograms between the least and greatest undecided value find the cell of the wanted rank: rows below it are in,
    rows above it out, and the cell is refined. Only counts of cells are shuffled. Rows still undecided, few or all tied,
    are ranked by ranges. Values that are not finite come last: infinities, NaN, null.
    """
    far = F.col(value).isNull() | F.isnan(F.col(value).cast("double")) | (F.abs(F.col(value).cast("double")) == float("inf"))
    rows = df.withColumn("_v", F.col(value).cast("double"))
    # state of each group: undecided values are within [low, high], "need" of them are wanted
    plain = rows.where(~far)
    state = plain.groupBy(*keys).agg(F.min("_v").alias("low"), F.max("_v").alias("high"), F.count(F.lit(1)).alias("left"), F.max(wanted).cast("long").alias("need"))
    state = materialize(state.withColumn("need", F.least("need", "left")), "selection")
    inside = lambda: (F.col("_v") >= F.col("low")) & (F.col("_v") <= F.col("high"))
    for _ in range(REFINEMENTS):
        open_ = (F.col("left") > FEW) & (F.col("need") > 0) & (F.col("need") < F.col("left")) & (F.col("low") < F.col("high"))
        if state.where(open_).isEmpty():
            break
        cell = F.least(F.floor((F.col("_v") / 2 - F.col("low") / 2) / (F.col("high") / 2 - F.col("low") / 2) * CELLS), F.lit(CELLS - 1)).cast("int")
        met = _join_keys(plain, state.where(open_), keys).where(inside())
        cells = met.groupBy(*keys, cell.alias("cell")).agg(F.count(F.lit(1)).alias("n"), F.min("_v").alias("c_low"), F.max("_v").alias("c_high"), F.max("need").alias("need"))
        # CELLS rows a group at most
        run = F.sum("n").over(Window.partitionBy(*keys).orderBy("cell").rowsBetween(Window.unboundedPreceding, 0))
        hit = cells.withColumn("until", run).where((F.col("until") >= F.col("need")) & (F.col("until") - F.col("n") < F.col("need")))
        refined = hit.select(*keys, F.col("c_low").alias("low"), F.col("c_high").alias("high"), F.col("n").alias("left"), (F.col("need") - (F.col("until") - F.col("n"))).alias("need"))
        state = materialize(state.where(~open_).unionByName(refined), "selection")
    decided = _join_keys(plain, state, keys)
    below = decided.where((F.col("_v") < F.col("low")) | (inside() & (F.col("need") == F.col("left"))))
    among = decided.where(inside() & (F.col("need") < F.col("left")) & (F.col("need") > 0))
    chosen = ordered_rank(among, keys, ["_v", tie], "_rank").where(F.col("_rank") <= F.col("need"))
    columns = df.columns
    out = below.select(*columns).unionByName(chosen.select(*columns))
    # groups that want more rows than they have finite values take the others
    odd = rows.where(far)
    plain_counts = plain.groupBy(*keys).agg(F.count(F.lit(1)).alias("_plain"))
    last = ordered_rank(odd.withColumn("_o", F.when(F.col("_v").isNull(), 2).when(F.isnan("_v"), 1).otherwise(F.signum("_v") / 2)), keys, ["_o", tie], "_rank")
    joined = _left_keys(last, plain_counts, keys)
    return out.unionByName(joined.where(F.col("_rank") <= F.col(wanted) - F.coalesce("_plain", F.lit(0))).select(*columns))


def _left_keys(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    renamed = right.select(*[F.col(k).alias(f"_j_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    cond: Column | None = None
    for k in keys:
        part = left[k].eqNullSafe(renamed[f"_j_{k}"])
        cond = part if cond is None else cond & part
    return left.join(renamed, cond, "left").drop(*[f"_j_{k}" for k in keys])
