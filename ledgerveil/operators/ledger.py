"""Rényi privacy ledger: running cost, budget summary, guard, noise planning.

Ledger rows: account, seq, sigma (noise standard deviation), sensitivity, sampling_rate,
n_steps. With z = sigma / sensitivity the cost of one Gaussian release at order a is
a / (2 z^2): more noise costs less.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerveil.functions.noise import gaussian_sigma
from ledgerveil.operators import privacy
from ledgerveil.session import materialize

# --- fixed values: orders tracked ----------------------------------------------------
ORDERS = [
    1.5, 1.75, 2, 2.25, 2.5, 3, 3.5, 4, 4.5, 5, 6, 7, 8, 9, 10, 12, 14, 16, 20, 24, 28, 32, 64, 256,
]
# ---------------------------------------------------------------------------------------


class BudgetExhausted(RuntimeError):
    """A release would exceed the privacy budget."""


def step_cost(order: Column, sigma: Column, sensitivity: Column, rate: Column) -> Column:
    """Rényi cost of one step, with amplification by sampling when the rate is below one half."""
    z = sigma / sensitivity
    base = order / (F.lit(2.0) * z * z)
    exponent = (order - 1) * base
    # beyond exp(700) the amplified bound exceeds the plain cost anyway
    amplified = F.when(
        exponent < 700, F.log1p(rate * rate * (F.exp(F.least(exponent, F.lit(700.0))) - 1)) / (order - 1)
    ).otherwise(base)
    return F.when(rate <= 0, F.lit(0.0)).when(rate >= 0.5, base).otherwise(F.least(amplified, base))


def to_epsilon(cost: Column, order: Column, delta: float) -> Column:
    return cost + F.lit(math.log(1.0 / delta)) / (order - 1)


def _costs(ledger: DataFrame, account: str, orders: Sequence[float]) -> DataFrame:
    order = F.explode(F.array(*[F.lit(float(a)) for a in orders])).alias("ord")
    long = ledger.select(account, "seq", "sigma", "sensitivity", "sampling_rate", "n_steps", order)
    one = step_cost(F.col("ord"), F.col("sigma"), F.col("sensitivity"), F.col("sampling_rate"))
    return long.select(account, "seq", "ord", (one * F.col("n_steps")).alias("cost"))


def running_epsilon(
    ledger: DataFrame, account: str = "account", delta: float = 1e-5, orders: Sequence[float] = tuple(ORDERS)
) -> DataFrame:
    """(account, seq, epsilon) after each operation.

    Operations are dealt out by ranges of (account, seq) and only they are shuffled; the costs of all orders are worked
    out behind the last shuffle. An account that a range's end cuts, at most one a partition, takes its earlier sums along.
    """
    rows = ledger.select(account, "seq", "sigma", "sensitivity", "sampling_rate", "n_steps")
    placed = materialize(rows.repartitionByRange(account, "seq").withColumn("_b", F.spark_partition_id()), "prefix")
    costs = [(step_cost(F.lit(float(a)), F.col("sigma"), F.col("sensitivity"), F.col("sampling_rate")) * F.col("n_steps")).alias(f"_c{i}") for i, a in enumerate(orders)]
    names = [f"_c{i}" for i in range(len(orders))]

    cut = placed.groupBy(account).agg(F.min("_b").alias("_x"), F.max("_b").alias("_y")).where("_x <> _y").select(F.col(account).alias("_account"))
    cut = placed.join(F.broadcast(cut), F.col(account).eqNullSafe(F.col("_account")), "left_semi")
    sums = cut.select(account, "_b", *costs).groupBy(account, "_b").agg(*[F.sum(c).alias(c) for c in names])
    before = Window.partitionBy(account).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    earlier = sums.select(F.col(account).alias("_account"), F.col("_b").alias("_at"), *[F.sum(c).over(before).alias(f"_o{c}") for c in names])

    dealt = placed.repartition(account, "_b").sortWithinPartitions(account, "_b", "seq")
    inner = Window.partitionBy(account, "_b").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    run = dealt.select(account, "_b", "seq", *costs).select(account, "_b", "seq", *[F.sum(c).over(inner).alias(c) for c in names])
    run = run.join(F.broadcast(earlier), F.col(account).eqNullSafe(F.col("_account")) & (F.col("_b") == F.col("_at")), "left")
    eps = [to_epsilon(F.col(c) + F.coalesce(F.col(f"_o{c}"), F.lit(0.0)), F.lit(float(a)), delta) for c, a in zip(names, orders, strict=True)]
    return run.select(account, "seq", (F.least(*eps) if len(eps) > 1 else eps[0]).alias("epsilon"))


def spent(
    ledger: DataFrame, account: str = "account", delta: float = 1e-5, orders: Sequence[float] = tuple(ORDERS)
) -> DataFrame:
    """(account, n_operations, spent_epsilon): additive costs, then the best order."""
    totals = _costs(ledger, account, orders).groupBy(account, "ord").agg(
        F.sum("cost").alias("cost"), F.count(F.lit(1)).alias("n")
    )
    return totals.groupBy(account).agg(
        F.max("n").alias("n_operations"),
        F.min(to_epsilon(F.col("cost"), F.col("ord"), delta)).alias("spent_epsilon"),
    )


def summary(ledger: DataFrame, budget: float, account: str = "account", delta: float = 1e-5) -> DataFrame:
    s = spent(ledger, account, delta)
    return s.select(
        account,
        "n_operations",
        F.lit(float(budget)).alias("budget_epsilon"),
        "spent_epsilon",
        F.greatest(F.lit(0.0), F.lit(float(budget)) - F.col("spent_epsilon")).alias("remaining_epsilon"),
        (F.col("spent_epsilon") >= F.lit(float(budget))).alias("budget_exhausted"),
    )


def can_spend(ledger: DataFrame, who: object, budget: float, epsilon: float, account: str = "account", delta: float = 1e-5) -> bool:
    """Whether one account may still spend ``epsilon``; an empty ledger has spent 0."""
    row = spent(ledger.where(F.col(account) == F.lit(who)), account, delta).first()
    return (row["spent_epsilon"] if row else 0.0) + epsilon <= budget


def require(ledger: DataFrame, who: object, budget: float, epsilon: float, account: str = "account", delta: float = 1e-5) -> None:
    if not can_spend(ledger, who, budget, epsilon, account, delta):
        raise BudgetExhausted(f"{who}: no budget left for {epsilon}")


def query_with_debit(
    df: DataFrame, ledger: DataFrame, who: object, budget: float, query: str, epsilon: float,
    column: str | None = None, by: Sequence[str] = (), lower: float | None = None, upper: float | None = None,
    delta: float = 1e-5, account: str = "account", seed: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Guarded Gaussian release and the ledger with the debit appended."""
    require(ledger, who, budget, epsilon, account, delta)
    answer = privacy.release(df, query, epsilon, column, by, lower, upper, "gaussian", delta, seed)
    nxt = ledger.agg((F.coalesce(F.max("seq"), F.lit(0)) + 1).alias("seq"))
    debit = nxt.select(
        F.lit(who).cast(ledger.schema[account].dataType).alias(account),
        F.col("seq").cast(ledger.schema["seq"].dataType).alias("seq"),
        F.lit(gaussian_sigma(1.0, epsilon, delta)).alias("sigma"),
        F.lit(1.0).alias("sensitivity"),
        F.lit(1.0).alias("sampling_rate"),
        F.lit(1).cast("bigint").alias("n_steps"),
    )
    return answer, ledger.unionByName(debit)


def plan_noise(
    jobs: DataFrame, job: str, target: float, delta: float = 1e-5,
    grid: Sequence[float] = tuple(round(0.3 + 0.05 * i, 2) for i in range(95)),
    orders: Sequence[float] = tuple(ORDERS),
) -> DataFrame:
    """Least noise multiplier on the grid that keeps each job within the target.

    ``jobs``: job, sampling_rate, n_steps. Grid and orders are literals exploded per
    job and folded right away by (job, sigma) and job.
    """
    sig = F.explode(F.array(*[F.lit(float(s)) for s in grid])).alias("sigma")
    a = F.explode(F.array(*[F.lit(float(x)) for x in orders])).alias("ord")
    cells = jobs.select(job, "sampling_rate", "n_steps", sig).select("*", a)
    cost = step_cost(F.col("ord"), F.col("sigma"), F.lit(1.0), F.col("sampling_rate")) * F.col("n_steps")
    eps = cells.groupBy(job, "sigma").agg(F.min(to_epsilon(cost, F.col("ord"), delta)).alias("epsilon"))
    fits = F.col("epsilon") <= F.lit(float(target))
    return eps.groupBy(job).agg(
        F.min(F.when(fits, F.col("sigma"))).alias("sigma"),
        F.max(F.when(fits, F.col("epsilon"))).alias("epsilon"),
    )


def epochs_within(jobs: DataFrame, job: str, target: float, delta: float = 1e-5, orders: Sequence[float] = tuple(ORDERS)) -> DataFrame:
    """Epochs each job can run within the target: the most generous order decides (closed form).

    ``jobs``: job, sigma, sampling_rate. At least one epoch is reported.
    """
    a = F.explode(F.array(*[F.lit(float(x)) for x in orders])).alias("ord")
    cells = jobs.select(job, "sigma", "sampling_rate", a)
    one = step_cost(F.col("ord"), F.col("sigma"), F.lit(1.0), F.col("sampling_rate"))
    room = F.lit(float(target)) - F.lit(math.log(1.0 / delta)) / (F.col("ord") - 1)
    steps = F.when(room > 0, F.floor(room / one)).otherwise(F.lit(0))
    most = cells.groupBy(job, "sampling_rate").agg(F.greatest(F.lit(1), F.max(steps)).alias("n_steps"))
    per_epoch = F.greatest(F.lit(1), F.floor(F.lit(1.0) / F.col("sampling_rate")))
    return most.select(job, "n_steps", F.greatest(F.lit(1), F.floor(F.col("n_steps") / per_epoch)).alias("epochs"))
