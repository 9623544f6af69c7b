"""Exact ranks and running sums that survive a hot group.

A plain ``Window.partitionBy(key).orderBy(v)`` puts a whole group into one task.
Here a group is cut into ordered buckets first: row numbers and running sums are
taken inside a bucket, and the (small) table of bucket totals supplies what came
before. The result equals the plain window's result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerveil.session import materialize

ALL = "_all"


def seeded_order(seed: int, *cols: str) -> Column:
    """Uniform, reproducible ordering key (hex text) for sampling and splitting."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in cols]))


def hash_rank(
    df: DataFrame,
    keys: Sequence[str],
    ids: Sequence[str],
    seed: int = 42,
    rank: str = "rn",
    total: str = "n_group",
    hex_digits: int = 4,
) -> DataFrame:
    """Exact 1-based rank of every row in its group, in seeded-hash order.

    The leading hex digits of the hash are an order-preserving, uniform bucket,
    so 16**hex_digits tasks share even a single group.
    """
    keys = list(keys)
    base = df.withColumn("_h", seeded_order(seed, *ids)).withColumn("_b", F.substring("_h", 1, hex_digits))
    if not keys:
        base, keys = base.withColumn(ALL, F.lit(0)), [ALL]
    sizes = base.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_m"))
    run = Window.partitionBy(*keys).orderBy("_b")
    offsets = sizes.select(
        *keys,
        "_b",
        (F.sum("_m").over(run.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_m")).alias("_before"),
        F.sum("_m").over(Window.partitionBy(*keys)).alias(total),
    )
    inner = Window.partitionBy(*keys, "_b").orderBy("_h", *ids)
    ranked = base.withColumn("_r", F.row_number().over(inner))
    joined = _join_keys(ranked, offsets, [*keys, "_b"])
    return joined.withColumn(rank, F.col("_before") + F.col("_r")).drop("_h", "_b", "_r", "_before", ALL)


def ordered_prefix(df: DataFrame, keys: Sequence[str], value: str, measures: Sequence[str]) -> DataFrame:
    """Running (inclusive) sums ``cum_<m>`` of each measure along ``value`` in each group.

    ``value`` must be numeric and occur once per group: aggregate to distinct values
    first, which also folds ties on the map side. Rows are dealt out by ranges of
    (keys, value), so a group of any size spreads over as many partitions as it needs;
    sums run inside a partition and the small table of partition totals is carried
    forward. Every size takes this path. The dealt rows are written once: which range a
    row fell into must not be decided twice.
    """
    keys = list(keys)
    added = not keys
    if added:
        df, keys = df.withColumn(ALL, F.lit(0)), [ALL]
    ranged = df.repartitionByRange(*[F.col(k) for k in keys], F.col(value)).withColumn("_b", F.spark_partition_id())
    placed = materialize(ranged, "prefix")
    sizes = placed.groupBy(*keys, "_b").agg(*[F.sum(m).alias(f"_t_{m}") for m in measures])
    run = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    offsets = sizes.select(
        *keys, "_b", *[(F.sum(f"_t_{m}").over(run) - F.col(f"_t_{m}")).alias(f"_o_{m}") for m in measures]
    )
    inner = Window.partitionBy(*keys, "_b").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    local = placed.select("*", *[F.sum(m).over(inner).alias(f"_l_{m}") for m in measures])
    joined = _join_keys(local, offsets, [*keys, "_b"])
    out = joined.select(
        *[c for c in df.columns],
        *[(F.col(f"_l_{m}") + F.col(f"_o_{m}")).alias(f"cum_{m}") for m in measures],
    )
    return out.drop(ALL) if added else out


def value_counts(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Distinct non-null values with their multiplicity ``m`` (map-side combined)."""
    return df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("m"))


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float]) -> DataFrame:
    """Exact linearly interpolated quantiles per group, one column per entry of ``probs``.

    Works on distinct values with counts, so neither heavy ties nor a huge group
    have to fit into one aggregation buffer.
    """
    keys = list(keys)
    if not keys:
        return exact_quantiles(df.withColumn(ALL, F.lit(0)), [ALL], value, probs).drop(ALL)
    run = ordered_prefix(value_counts(df, keys, value), keys, value, ["m"])
    totals = run.groupBy(*keys).agg(F.sum("m").alias("_n"))
    run = _join_keys(run, totals, keys)
    picks = []
    for name, p in probs.items():
        pos = F.lit(float(p)) * (F.col("_n") - 1)
        for side, at in (("lo", F.floor(pos)), ("hi", F.ceil(pos))):
            # the value whose occupied positions [cum-m, cum) contain the wanted position
            hit = (F.col("cum_m") > at) & (F.col("cum_m") - F.col("m") <= at)
            picks.append(F.max(F.when(hit, F.col(value))).alias(f"_{side}_{name}"))
    agg = run.groupBy(*keys).agg(F.first("_n").alias("_n"), *picks)
    outs = []
    for name, p in probs.items():
        pos = F.lit(float(p)) * (F.col("_n") - 1)
        lo, hi = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        outs.append((lo + (hi - lo) * (pos - F.floor(pos))).alias(name))
    return agg.select(*keys, *outs)


def with_totals(df: DataFrame, totals: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Attach per-group totals; with no keys ``totals`` is the single row of a global aggregate."""
    if keys:
        return _join_keys(df, totals, list(keys))
    return df.withColumn(ALL, F.lit(0)).join(totals.withColumn(ALL, F.lit(0)), ALL).drop(ALL)


#: A key is hot with over 1 / HOT_SHARE of all rows; fewer than HOT_SHARE keys are, whatever the data.
HOT_SHARE = 1000


def with_hot_totals(df: DataFrame, totals: DataFrame, keys: Sequence[str], count: str) -> DataFrame:
    """``with_totals`` for skewed keys: ``totals`` says in ``count`` how many rows of ``df`` each key has.

    Totals of hot keys, fewer than HOT_SHARE rows, are sent out; the rows of all others are joined by a shuffle in which
    no key has more than 1 / HOT_SHARE of the rows. ``totals`` is written once, ``df`` is read twice.
    """
    stored = materialize(totals, "totals")
    whole = stored.agg(F.sum(count)).first()[0] or 0
    hot = F.col(count) * HOT_SHARE > F.lit(whole)
    few = F.broadcast(stored.where(hot))
    sent = _join_keys(df, few, list(keys))
    cond = None
    names = stored.where(hot).select(*[F.col(k).alias(f"_h_{k}") for k in keys])
    for k in keys:
        part = df[k].eqNullSafe(names[f"_h_{k}"])
        cond = part if cond is None else cond & part
    rest = _join_keys(df.join(F.broadcast(names), cond, "left_anti"), stored.where(~hot), list(keys))
    return sent.unionByName(rest.select(*sent.columns))


def _join_keys(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner equi-join that also matches null keys (groups of null are groups too)."""
    renamed = right.select(*[F.col(k).alias(f"_j_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    cond = None
    for k in keys:
        part = left[k].eqNullSafe(renamed[f"_j_{k}"])
        cond = part if cond is None else cond & part
    return left.join(renamed, cond).drop(*[f"_j_{k}" for k in keys])
