"""Query registry and the shared shapes of the driver tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerveil.session import materialize
from ledgerveil.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; with ``sql`` it is also compared to DuckDB."""

    def add(fn: Query) -> Query:
        def run(spark: SparkSession, sf: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return fn(spark, sf)

        run.__name__, run.__doc__ = name, fn.__doc__
        if name in QUERIES:
            raise ValueError(f"{name} registered twice")
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def rounded(df: DataFrame, digits: int = 6, only: list[str] | None = None) -> DataFrame:
    """Round all (or some) double columns; adding 0.0 turns -0.0 into 0.0."""
    cols: list[Column] = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)) and (only is None or f.name in only):
            cols.append((F.round(F.col(f.name), digits) + F.lit(0.0)).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def round_signed(v: Column, digits: int = 6) -> Column:
    """Rounded like SQL twins do it: a negative value that rounds to zero stays -0.0, which counts inside arrays."""
    return F.when(v < 0, -F.round(-v, digits)).otherwise(F.round(v, digits))


# --- transactions of institutions over rounds -------------------------------------------------
# institution = customer nation, round = month of the order, fraud = returned line


def transactions(spark: SparkSession, sf: str) -> DataFrame:
    """lineitem with order, customer and part facts; dimension sides are left to AQE."""
    line = table(spark, sf, "lineitem")
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    cust = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    part = table(spark, sf, "part").select("p_partkey", "p_type")
    return (
        line.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(cust, F.col("o_custkey") == F.col("c_custkey"))
        .join(part, F.col("l_partkey") == F.col("p_partkey"))
        .withColumns(
            {
                "bank_id": F.col("c_nationkey").cast("string"),
                "round": F.year("o_orderdate") * 12 + F.month("o_orderdate"),
                "is_fraud": F.col("l_returnflag") == "R",
            }
        )
    )


TX = """tx AS (
  SELECT l.*, o_custkey, o_orderdate, p_type, c_nationkey::VARCHAR AS bank_id,
         (year(o_orderdate) * 12 + month(o_orderdate))::INT AS round, l_returnflag = 'R' AS is_fraud
  FROM lineitem l JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN part ON l_partkey = p_partkey)"""


def round_base(spark: SparkSession, sf: str) -> DataFrame:
    """Sums per (round, institution, part type, fraud), written once.

    The join behind it runs a single time; importances and metrics are small
    aggregations of this table, as they would be of the institutions' own reports.
    """
    v = F.col("l_extendedprice") * (F.col("l_discount") + 0.01)
    hit = (F.col("l_discount") >= 0.05) == F.col("is_fraud")
    base = transactions(spark, sf).groupBy("round", "bank_id", "p_type", "is_fraud").agg(
        F.sum(v).alias("v"),
        F.sum("l_quantity").alias("quantity"),
        F.sum("l_discount").alias("discount"),
        F.sum("l_tax").alias("tax"),
        F.sum(hit.cast("int")).alias("hits"),
        F.count(F.lit(1)).alias("n"),
    )
    return materialize(base, "rounds")


def importances(spark: SparkSession, sf: str, base: DataFrame | None = None) -> DataFrame:
    """(round, bank_id, feature, importance): shares of fraud value by part type, and scaled means."""
    fraud = (round_base(spark, sf) if base is None else base).where("is_fraud")
    total = fraud.groupBy("round", "bank_id").agg(*[F.sum(c).alias(c) for c in ("v", "quantity", "discount", "tax", "n")])
    shares = fraud.select("round", "bank_id", "p_type", F.col("v").alias("x")).join(total, ["round", "bank_id"]).select(
        "round", "bank_id", F.col("p_type").alias("feature"), (F.lit(0.5) * F.col("x") / F.col("v")).alias("importance")
    )
    means = total.select(
        "round", "bank_id",
        (F.col("quantity") / F.col("n") / 50 * 0.19871313).alias("quantity"),
        (F.col("discount") / F.col("n") * 1.97834567).alias("discount"),
        (F.col("tax") / F.col("n") * 2.48712357).alias("tax"),
    )
    long = means.unpivot(["round", "bank_id"], ["quantity", "discount", "tax"], "feature", "importance")
    return materialize(shares.unionByName(long), "importances")


IMP = """ty AS (
  SELECT round, bank_id, p_type AS feature, sum(l_extendedprice * (l_discount + 0.01::DOUBLE)) AS v
  FROM tx WHERE is_fraud GROUP BY ALL),
mn AS (
  SELECT round, bank_id, avg(l_quantity) / 50 * 0.19871313::DOUBLE AS quantity, avg(l_discount) * 1.97834567::DOUBLE AS discount,
         avg(l_tax) * 2.48712357::DOUBLE AS tax FROM tx WHERE is_fraud GROUP BY ALL),
imp AS (
  SELECT round, bank_id, feature, 0.5::DOUBLE * v / sum(v) OVER (PARTITION BY round, bank_id) AS importance FROM ty
  UNION ALL SELECT round, bank_id, 'quantity', quantity FROM mn
  UNION ALL SELECT round, bank_id, 'discount', discount FROM mn
  UNION ALL SELECT round, bank_id, 'tax', tax FROM mn)"""


def metrics(spark: SparkSession, sf: str, base: DataFrame | None = None) -> DataFrame:
    """(round, bank_id, fraud_rate, accuracy, loss, num_samples, num_fraud)."""
    out = (round_base(spark, sf) if base is None else base).groupBy("round", "bank_id").agg(
        (F.sum(F.when(F.col("is_fraud"), F.col("n")).otherwise(0)) / F.sum("n")).alias("fraud_rate"),
        (F.sum("hits") / F.sum("n")).alias("accuracy"),
        (F.sum("tax") / F.sum("n") * 10).alias("loss"),
        F.sum("n").alias("num_samples"),
        F.sum(F.when(F.col("is_fraud"), F.col("n")).otherwise(0)).alias("num_fraud"),
    )
    return materialize(out, "metrics")


def both(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """(importances, metrics) from one pass over the transactions."""
    base = round_base(spark, sf)
    return importances(spark, sf, base), metrics(spark, sf, base)


MET = """met AS (
  SELECT round, bank_id, avg(is_fraud::INT) AS fraud_rate,
         avg(((l_discount >= 0.05::DOUBLE) = is_fraud)::INT) AS accuracy, avg(l_tax) * 10 AS loss,
         count(*) AS num_samples, sum(is_fraud::INT)::BIGINT AS num_fraud
  FROM tx GROUP BY ALL)"""

KN = f"WITH {TX}, {IMP}, {MET}"


# --- scored rows -----------------------------------------------------------------------------------


def scored(spark: SparkSession, sf: str) -> DataFrame:
    """events with a deterministic score (amount and type) against the error label."""
    e = table(spark, sf, "events")
    # whole thousandths, so that both engines see the same ties
    s = F.floor(F.least(F.col("value"), F.lit(100.0)) * 6) / 1000 + F.when(
        F.col("event_type").isin("error", "click"), F.lit(0.3)
    ).otherwise(F.lit(0.0))
    return e.select("event_id", "user_id", "ts", "value", "event_type", (F.col("event_type") == "error").alias("is_fraud"), s.alias("score"))


SCORED = """scored AS (
  SELECT event_id, user_id, ts, value, event_type, event_type = 'error' AS is_fraud,
         floor(least(value, 100.0::DOUBLE) * 6) / 1000
         + CASE WHEN event_type IN ('error', 'click') THEN 0.3::DOUBLE ELSE 0.0::DOUBLE END AS score
  FROM events)"""


# --- client weight vectors ---------------------------------------------------------------------------


def client_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """embeddings as client updates, fifty clients to a round."""
    e = table(spark, sf, "embeddings")
    return e.select(
        F.floor(F.col("vec_id") / 50).alias("round"),
        F.col("vec_id").alias("client_id"),
        (F.lit(1) + F.col("vec_id") % 7).alias("num_samples"),
        F.col("embedding").alias("weights"),
    )


VECTORS = """vec AS (
  SELECT (vec_id // 50)::BIGINT AS round, vec_id AS client_id, 1 + vec_id % 7 AS num_samples, embedding AS weights
  FROM embeddings),
co AS (
  SELECT round, client_id, num_samples::DOUBLE AS n, (i - 1)::INT AS coord, weights[i]::DOUBLE AS w
  FROM (SELECT *, unnest(range(1, len(weights) + 1)) AS i FROM vec)),
sz AS (SELECT round, count(*) AS n_clients FROM vec GROUP BY 1)"""
