"""Robust aggregation of client vectors, checked coordinate by coordinate."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerveil.catalog.base import VECTORS, metrics, query, round_signed, rounded, KN, client_vectors
from ledgerveil.functions import vectors
from ledgerveil.operators import robust

_F = 3  # clients assumed faulty per round


@query("fedavg", f"WITH {VECTORS} SELECT round, coord, round(sum(w * n) / sum(n), 6) AS value FROM co GROUP BY 1, 2")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(robust.fedavg(client_vectors(spark, sf)))


# each client's peers within its round, ranked by distance
_KRUM = """pr AS (SELECT a.round, a.client_id, b.client_id AS other, sum((a.w - b.w) * (a.w - b.w)) AS d2 FROM co a JOIN co b ON a.round = b.round AND a.coord = b.coord AND a.client_id <> b.client_id GROUP BY 1, 2, 3),
pk AS (SELECT *, row_number() OVER (PARTITION BY round, client_id ORDER BY d2, other) AS rk FROM pr),
ks AS (SELECT pk.round, client_id, sum(d2) FILTER (rk <= greatest(1, n_clients - {f} - 2)) AS score, sqrt(min(d2)) AS nearest FROM pk JOIN sz ON pk.round = sz.round GROUP BY 1, 2),
kr AS (SELECT ks.*, n_clients, row_number() OVER (PARTITION BY ks.round ORDER BY score, client_id) AS rk FROM ks JOIN sz ON ks.round = sz.round)"""


@query("krum_scores", f"WITH {VECTORS}, {_KRUM.format(f=_F)} SELECT round, client_id, n_clients, round(score, 6) AS score, round(nearest, 6) AS nearest_distance FROM kr")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(robust.krum_scores(client_vectors(spark, sf), _F))


@query("krum_selection", f"WITH {VECTORS}, {_KRUM.format(f=_F)} SELECT round, client_id FROM kr WHERE n_clients < {2 * _F + 3} OR rk <= n_clients - {_F} - 1")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return robust.krum_select(client_vectors(spark, sf), _F)


@query(
    "multi_krum",
    f"""WITH {VECTORS}, {_KRUM.format(f=_F)}, ch AS (SELECT round, client_id FROM kr WHERE n_clients < {2 * _F + 3} OR rk <= n_clients - {_F} - 1)
      SELECT co.round, coord, round(sum(w * n) / sum(n), 6) AS value FROM co JOIN ch ON co.round = ch.round AND co.client_id = ch.client_id GROUP BY 1, 2""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(robust.robust_aggregate(client_vectors(spark, sf), "multi_krum", byzantine=_F))


def _trim_sql(source: str, sizes: str, ratio: float) -> str:
    return f"""tk AS (SELECT s.*, z.n_clients, greatest(1, floor(z.n_clients * {ratio}::DOUBLE))::BIGINT AS t, row_number() OVER (PARTITION BY s.round, coord ORDER BY w) AS rk
        FROM {source} s JOIN {sizes} z ON s.round = z.round),
      tm AS (SELECT round, coord, CASE WHEN any_value(n_clients) <= 2 * any_value(t) THEN sum(w * n) / sum(n) ELSE avg(w) FILTER (rk > t AND rk <= n_clients - t) END AS value FROM tk GROUP BY 1, 2)"""


@query("trimmed_mean", f"WITH {VECTORS}, {_trim_sql('co', 'sz', 0.1)} SELECT round, coord, round(value, 6) AS value FROM tm")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(robust.robust_aggregate(client_vectors(spark, sf), "trimmed_mean", ratio=0.1))


@query("coordinate_median", f"WITH {VECTORS} SELECT round, coord, round(median(w), 6) AS value FROM co GROUP BY 1, 2")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(robust.robust_aggregate(client_vectors(spark, sf), "coordinate_median"))


@query(
    "bulyan",
    f"""WITH {VECTORS}, {_KRUM.format(f=_F)}, ch AS (SELECT round, client_id FROM kr WHERE n_clients >= {4 * _F + 3} AND rk <= least(2 * (n_clients - {2 * _F} - 2), n_clients)),
      cc AS (SELECT co.* FROM co JOIN ch ON co.round = ch.round AND co.client_id = ch.client_id), cz AS (SELECT round, count(*) AS n_clients FROM ch GROUP BY 1), {_trim_sql('cc', 'cz', 0.25)},
      sm AS (SELECT round, client_id FROM kr WHERE n_clients < {4 * _F + 3} AND (n_clients < {2 * _F + 3} OR rk <= n_clients - {_F} - 1))
      SELECT round, coord, round(value, 6) AS value FROM tm UNION ALL
      SELECT co.round, coord, round(sum(w * n) / sum(n), 6) FROM co JOIN sm ON co.round = sm.round AND co.client_id = sm.client_id GROUP BY 1, 2""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(robust.robust_aggregate(client_vectors(spark, sf), "bulyan", byzantine=_F))


@query(
    "clipped_clients",
    f"""WITH {VECTORS}, nm AS (SELECT client_id, sqrt(sum(w * w)) AS nn FROM co GROUP BY 1)
      SELECT co.client_id, coord, round(CASE WHEN nn > 0.8::DOUBLE THEN w * (0.8::DOUBLE / nn) ELSE w END, 6) AS value FROM co JOIN nm ON co.client_id = nm.client_id""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    c = robust.clip_clients(client_vectors(spark, sf), 0.8)
    return rounded(c.select("client_id", F.posexplode("weights").alias("coord", "value")))


@query(
    "clipped_rows",
    f"""WITH {VECTORS}, nm AS (SELECT client_id, sqrt(sum(w * w)) AS nn FROM co GROUP BY 1)
      SELECT co.client_id, coord, round(w * least(1, 0.5::DOUBLE / (nn + 0.00000001::DOUBLE)), 6) AS value FROM co JOIN nm ON co.client_id = nm.client_id""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    c = client_vectors(spark, sf).select("client_id", vectors.clip_l2_smooth(F.col("weights"), 0.5).alias("g"))
    return rounded(c.select("client_id", F.posexplode("g").alias("coord", "value")))


@query("dp_fedavg")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return robust.robust_aggregate(client_vectors(spark, sf), "dp_fedavg", clip=1.0, noise_multiplier=0.1, seed=7)


@query(
    "packed_median",
    f"WITH {VECTORS}, m AS (SELECT round, coord, round(median(w), 6) AS v FROM co GROUP BY 1, 2) SELECT round, list(v ORDER BY coord) AS weights FROM m GROUP BY 1",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    packed = robust.pack(robust.coordinate_median(client_vectors(spark, sf)))
    return packed.select("round", F.transform("weights", lambda v: round_signed(v)).alias("weights"))


@query("outlier_resistance")
def _(spark: SparkSession, sf: str) -> DataFrame:
    """Distance between the aggregate with and without injected outliers, per method."""
    honest = client_vectors(spark, sf)
    hit = robust.inject_outliers(honest, "scale", F.col("client_id") % 25 == 0)
    out: DataFrame | None = None
    for m in ("fedavg", "median", "trimmed_mean"):
        a = robust.robust_aggregate(honest, m)
        b = robust.robust_aggregate(hit, m).withColumnRenamed("value", "other")
        gap = a.join(b, ["round", "coord"]).agg(F.sqrt(F.sum(F.pow(F.col("value") - F.col("other"), F.lit(2.0)))).alias("distance"))
        row = gap.select(F.lit(m).alias("method"), "distance")
        out = row if out is None else out.unionByName(row)
    return out


@query("round_averages", f"{KN} SELECT round, round(avg(loss), 6) AS loss, round(avg(CASE WHEN num_samples > 20 THEN accuracy END), 6) AS accuracy, count(*) AS n_clients FROM met GROUP BY 1")
def _(spark: SparkSession, sf: str) -> DataFrame:
    m = metrics(spark, sf).withColumn("accuracy", F.when(F.col("num_samples") > 20, F.col("accuracy")))
    return rounded(robust.round_averages(m, ["loss", "accuracy"]))
