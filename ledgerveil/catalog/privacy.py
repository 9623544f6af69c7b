"""Private releases and the privacy ledger."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerveil.catalog.base import SCORED, query, rounded, scored
from ledgerveil.operators import ledger, privacy
from ledgerveil.plans.ranking import with_totals
from ledgerveil.sources.tables import table

_D = math.log(1e5)


@query(
    "dp_exact_answers",
    """SELECT c_mktsegment, 'sum' AS query, round(sum(greatest(0.0::DOUBLE, least(5000.0::DOUBLE, c_acctbal))), 4) AS value, 5000.0::DOUBLE AS sensitivity FROM customer GROUP BY 1
      UNION ALL SELECT c_mktsegment, 'mean', round(avg(greatest(0.0::DOUBLE, least(5000.0::DOUBLE, c_acctbal))), 4), round(5000.0::DOUBLE / count(*), 4) FROM customer GROUP BY 1
      UNION ALL SELECT c_mktsegment, 'histogram', count(*)::DOUBLE, 1.0::DOUBLE FROM customer GROUP BY 1""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    c, by = table(spark, sf, "customer"), ["c_mktsegment"]
    out: DataFrame | None = None
    for q, col in (("sum", "c_acctbal"), ("mean", "c_acctbal"), ("histogram", None)):
        a = privacy.true_answer(c, q, col, by, 0.0, 5000.0).select(*by, F.lit(q).alias("query"), "value", "sensitivity")
        out = a if out is None else out.unionByName(a)
    return rounded(out, 4)


@query("dp_laplace_release")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return privacy.release(table(spark, sf, "lineitem"), "sum", 1.0, "l_quantity", ["l_returnflag"], 0, 50, "laplace", seed=11)


@query("dp_gaussian_release")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return privacy.release(table(spark, sf, "lineitem"), "mean", 1.0, "l_discount", ["l_returnflag"], 0, 0.1, "gaussian", seed=11)


@query("dp_choice")
def _(spark: SparkSession, sf: str) -> DataFrame:
    """Most frequent event type per user, chosen privately."""
    n = table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).cast("double").alias("utility"))
    return privacy.choose(n, "event_type", "utility", 2.0, ["user_id"], seed=3)


@query("dp_noisy_leaves")
def _(spark: SparkSession, sf: str) -> DataFrame:
    leaves = table(spark, sf, "lineitem").groupBy(F.col("l_linenumber").alias("tree"), F.col("l_quantity").cast("int").alias("leaf")).agg(F.avg("l_discount").alias("value"))
    return privacy.noisy_leaves(leaves, "tree", "value", 1.0, 1e-5, 7, seed=3)


def _examples(spark: SparkSession, sf: str) -> DataFrame:
    return scored(spark, sf).select((F.col("value") / 100).alias("x1"), F.col("score").alias("x2"), F.lit(1.0).alias("x0"), "is_fraud")


@query(
    "clipped_gradient_sum",
    f"""WITH {SCORED}, e AS (SELECT 1 / (1 + exp(-(value / 100 * 0.1::DOUBLE + score * 0.2::DOUBLE - 0.3::DOUBLE))) - is_fraud::INT AS r, value / 100 AS x1, score AS x2 FROM scored),
      g AS (SELECT r * x1 AS a, r * x2 AS b, r AS c, least(1, 0.25::DOUBLE / (sqrt(r * r * (x1 * x1 + x2 * x2 + 1)) + 0.00000001::DOUBLE)) AS f FROM e)
      SELECT round(sum(a * f), 4) AS g0, round(sum(b * f), 4) AS g1, round(sum(c * f), 4) AS g2, count(*) AS n FROM g""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(privacy.clipped_gradient_sum(_examples(spark, sf), ["x1", "x2", "x0"], "is_fraud", [0.1, 0.2, -0.3], 0.25), 4)


@query(
    "user_gradient_sum",
    f"""WITH {SCORED}, e AS (SELECT value / 100 * 0.1::DOUBLE + score * 0.2::DOUBLE - is_fraud::INT AS r, value / 100 AS x1, score AS x2 FROM scored),
      g AS (SELECT r * x1 AS a, r * x2 AS b, least(1, 0.25::DOUBLE / (sqrt(r * r * (x1 * x1 + x2 * x2)) + 0.00000001::DOUBLE)) AS f FROM e)
      SELECT 0 AS coord, round(sum(a * f), 4) AS value, count(*) AS n FROM g UNION ALL SELECT 1, round(sum(b * f), 4), count(*) FROM g""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    """A squared-loss gradient supplied by the caller."""
    e = _examples(spark, sf)
    return rounded(privacy.user_gradient_sum(e, ["x1", "x2"], "is_fraud", [0.1, 0.2], lambda w, x, y: (x @ w - y)[:, None] * x, 0.25), 4)


@query("private_training")
def _(spark: SparkSession, sf: str) -> DataFrame:
    """Weights of a privately trained model, applied to every row."""
    e = _examples(spark, sf)
    w, entry = privacy.train_private(e, ["x1", "x2", "x0"], "is_fraud", steps=3, sampling_rate=0.5)
    z = F.col("x1") * w[0] + F.col("x2") * w[1] + w[2]
    return e.select("is_fraud", (1 / (1 + F.exp(-z))).alias("score")).groupBy("is_fraud").agg(F.avg("score").alias("mean_score"), F.count(F.lit(1)).alias("n")).withColumn(
        "sigma", F.lit(entry["sigma"])
    )


def release_ledger(spark: SparkSession, sf: str) -> DataFrame:
    """events as release operations of their users."""
    e = table(spark, sf, "events")
    return e.select(
        F.col("user_id").alias("account"), F.col("event_id").alias("seq"), (F.lit(5.0) + F.col("value") / 10).alias("sigma"), F.lit(1.0).alias("sensitivity"),
        F.when(F.col("event_type") == "view", F.lit(1.0)).otherwise(F.lit(0.05)).alias("sampling_rate"), (F.lit(1) + F.col("event_id") % 4).alias("n_steps"),
    )


_ORD = ", ".join(str(float(a)) for a in ledger.ORDERS)
_COST = """CASE WHEN q >= 0.5 THEN a / (2 * z * z) ELSE least(a / (2 * z * z), ln(1 + q * q * (exp((a - 1) * a / (2 * z * z)) - 1)) / (a - 1)) END"""
_LEDGER = f"""op AS (SELECT user_id AS account, event_id AS seq, 5.0::DOUBLE + value / 10 AS z, CASE WHEN event_type = 'view' THEN 1.0::DOUBLE ELSE 0.05::DOUBLE END AS q, 1 + event_id % 4 AS k FROM events),
  lc AS (SELECT account, seq, a, k * {_COST} AS cost FROM (SELECT *, unnest([{_ORD}]::DOUBLE[]) AS a FROM op))"""


@query(
    "ledger_running_epsilon",
    f"""WITH {_LEDGER}, r AS (SELECT account, seq, sum(cost) OVER (PARTITION BY account, a ORDER BY seq) + {_D!r}::DOUBLE / (a - 1) AS e FROM lc) SELECT account, seq, round(min(e), 6) AS epsilon FROM r GROUP BY 1, 2""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(ledger.running_epsilon(release_ledger(spark, sf)))


SPENT_SQL = f"""{_LEDGER}, sp AS (SELECT account, min(e) AS spent, max(n) AS n FROM (SELECT account, a, sum(cost) + {_D!r}::DOUBLE / (a - 1) AS e, count(*) AS n FROM lc GROUP BY 1, 2) GROUP BY 1)"""


@query(
    "ledger_summary",
    f"""WITH {SPENT_SQL} SELECT account, n AS n_operations, 4.0::DOUBLE AS budget_epsilon, round(spent, 6) AS spent_epsilon, round(greatest(0, 4.0::DOUBLE - spent), 6) AS remaining_epsilon, spent >= 4 AS budget_exhausted FROM sp""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(ledger.summary(release_ledger(spark, sf), 4.0))


_GRID = ", ".join(str(round(0.3 + 0.05 * i, 2)) for i in range(95))


@query(
    "noise_plan",
    f"""WITH j AS (SELECT c_nationkey AS job, least(1, 8.0::DOUBLE / count(*)) AS q, greatest(1, count(*) // 8) * 5 AS k FROM customer GROUP BY 1),
      c AS (SELECT *, unnest([{_ORD}]::DOUBLE[]) AS a FROM (SELECT *, unnest([{_GRID}]::DOUBLE[]) AS z FROM j)),
      d AS (SELECT job, z, q, k, a, a / (2 * z * z) AS b FROM c),
      e AS (SELECT job, z, min(k * CASE WHEN q >= 0.5 OR (a - 1) * b >= 700 THEN b ELSE least(b, ln(1 + q * q * (exp((a - 1) * b) - 1)) / (a - 1)) END + {_D!r}::DOUBLE / (a - 1)) AS eps FROM d GROUP BY 1, 2)
      SELECT job, min(z) FILTER (eps <= 2) AS sigma, round(max(eps) FILTER (eps <= 2), 6) AS epsilon FROM e GROUP BY 1""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    """Least noise for five epochs over each nation's customers at epsilon 2."""
    jobs = table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("job")).agg(F.count(F.lit(1)).alias("n")).select(
        "job", F.least(F.lit(1.0), F.lit(8.0) / F.col("n")).alias("sampling_rate"), (F.greatest(F.lit(1), F.floor(F.col("n") / 8)) * 5).alias("n_steps")
    )
    return rounded(ledger.plan_noise(jobs, "job", 2.0), 6, ["epsilon"])


@query(
    "epochs_within_budget",
    f"""WITH j AS (SELECT c_nationkey AS job, least(1, 8.0::DOUBLE / count(*)) AS q FROM customer GROUP BY 1), c AS (SELECT *, unnest([{_ORD}]::DOUBLE[]) AS a, 1.3::DOUBLE AS z FROM j),
      d AS (SELECT *, a / (2 * z * z) AS b FROM c),
      s AS (SELECT job, q, greatest(1, least(100000, max(CASE WHEN 3.0::DOUBLE - {_D!r}::DOUBLE / (a - 1) > 0 THEN floor((3.0::DOUBLE - {_D!r}::DOUBLE / (a - 1)) /
        CASE WHEN q >= 0.5 OR (a - 1) * b >= 700 THEN b ELSE least(b, ln(1 + q * q * (exp((a - 1) * b) - 1)) / (a - 1)) END) ELSE 0 END)))::BIGINT AS n_steps FROM d GROUP BY 1, 2)
      SELECT job, n_steps, greatest(1, n_steps // greatest(1, floor(1 / q)::BIGINT))::BIGINT AS epochs FROM s""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    jobs = table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("job")).agg(
        F.least(F.lit(1.0), F.lit(8.0) / F.count(F.lit(1))).alias("sampling_rate")
    ).withColumn("sigma", F.lit(1.3))
    return ledger.epochs_within(jobs, "job", 3.0)


@query("dp_query_with_debit")
def _(spark: SparkSession, sf: str) -> DataFrame:
    """A guarded release per segment; the appended ledger row is shown next to the answer."""
    led = release_ledger(spark, sf)
    answer, after = ledger.query_with_debit(table(spark, sf, "customer"), led, 0, 50.0, "count", 0.5, by=["c_mktsegment"], seed=5)
    last = after.agg(F.max("seq").alias("seq"), F.count(F.lit(1)).alias("ledger_rows"))
    return with_totals(answer, last, [])
