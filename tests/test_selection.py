"""Order statistics without a sort of a group, blocks of clients and coordinates, the velocity sweep."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerveil.operators import features, robust
from ledgerveil.plans import ranking, selection


def by_window(df, keys, value, tie, wanted):
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(value).asc_nulls_last(), tie))
    return df.withColumn("_r", rank).where(F.col("_r") <= F.col(wanted)).drop("_r")


@pytest.mark.parametrize("few", [10_000, 10])
def test_smallest_equals_window(spark, monkeypatch, few):
    monkeypatch.setattr(selection, "FEW", few)
    monkeypatch.setattr(selection, "CELLS", 16)
    r = np.random.default_rng(0)
    pdf = pd.DataFrame({"g": r.choice(["a", "a", "a", "b", "c", None], 4000), "id": np.arange(4000), "v": np.where(r.random(4000) < 0.4, 1.0, np.round(r.exponential(size=4000) * 100, 1))})
    pdf.loc[:20, "v"] = [1e300, -1e300, *[0.0] * 19]
    want = {"a": 900, "b": 0, "c": 10_000}
    df = spark.createDataFrame(pdf).withColumn("m", F.coalesce(F.create_map(*[F.lit(x) for kv in want.items() for x in kv])[F.col("g")], F.lit(17)))
    got = selection.smallest(df, ["g"], "v", "id", "m")
    assert sorted(r.id for r in got.collect()) == sorted(r.id for r in by_window(df, ["g"], "v", "id", "m").collect())


def test_values_that_are_not_finite_come_last(spark):
    rows = [("a", 1, 5.0), ("a", 2, float("nan")), ("a", 3, None), ("a", 4, float("inf")), ("a", 5, 1.0), ("b", 6, None)]
    df = spark.createDataFrame(rows, "g string, id long, v double")
    for m, ids in ((1, [5, 6]), (2, [1, 5, 6]), (3, [1, 4, 5, 6]), (4, [1, 2, 4, 5, 6]), (9, [1, 2, 3, 4, 5, 6])):
        got = selection.smallest(df.withColumn("m", F.lit(m)), ["g"], "v", "id", "m")
        assert sorted(r.id for r in got.collect()) == ids, m


def test_a_million_clients_in_one_round(spark):
    """Only counts of cells and the undecided rows are shuffled; no task sorts the round."""
    n = 1_000_000
    score = F.when(F.col("id") % 10 < 3, F.lit(0.25)).otherwise(F.pmod(F.xxhash64("id"), F.lit(10**9)) / 1e9)
    df = spark.range(n).select(F.lit(1).alias("round"), F.col("id").alias("client_id"), score.alias("score"), F.lit(400_000).alias("wanted"))
    chosen = selection.smallest(df, ["round"], "score", "client_id", "wanted").cache()
    assert chosen.count() == 400_000
    top = chosen.agg(F.max("score")).first()[0]
    below = df.where(F.col("score") < top).count()
    tied = chosen.where(F.col("score") == top)
    assert below + tied.count() == 400_000 and top == 0.25
    assert tied.agg(F.max("client_id")).first()[0] == df.where(F.col("score") == top).orderBy("client_id").limit(400_000 - below).agg(F.max("client_id")).first()[0]


def clients(spark, n=37, d=50, rounds=2, seed=1):
    r = np.random.default_rng(seed)
    rows = [(k, i, 1 + i % 3, r.normal(size=d).tolist()) for k in range(rounds) for i in range(n)]
    return spark.createDataFrame(rows, "round long, client_id long, num_samples long, weights array<double>"), rows


def matrix(rows, k):
    return np.array([w for r, _, _, w in rows if r == k])


@pytest.mark.parametrize(("coords", "size"), [(1024, 64 << 20), (7, 64 << 20), (1024, 37 * 8 * 3), (1024, 100)])
def test_coordinate_blocks(spark, monkeypatch, coords, size):
    """Whole blocks, narrow blocks, and rounds too large for a block give the same values."""
    monkeypatch.setattr(robust, "BLOCK_COORDS", coords)
    monkeypatch.setattr(robust, "MATRIX_BYTES", size)
    df, rows = clients(spark)
    median = {(r["round"], r.coord): r.value for r in robust.coordinate_median(df).collect()}
    trimmed = {(r["round"], r.coord): r.value for r in robust.trimmed_mean(df, 0.2).collect()}
    for k in range(2):
        m = np.sort(matrix(rows, k), axis=0)
        assert np.allclose([median[k, c] for c in range(50)], np.median(m, axis=0))
        assert np.allclose([trimmed[k, c] for c in range(50)], m[7:-7].mean(axis=0))
    assert len(median) == len(trimmed) == 100


@pytest.mark.parametrize("block", [None, 5])
def test_symmetric_distance_blocks(spark, block):
    df, rows = clients(spark, 23, 8)
    got = {(r["round"], r.client_id): (r.score, r.nearest_distance) for r in robust.krum_scores(df, 2, block).collect()}
    for k in range(2):
        m = matrix(rows, k)
        d = ((m[:, None] - m[None]) ** 2).sum(-1)
        for i in range(23):
            others = np.sort(np.delete(d[i], i))
            assert np.allclose(got[k, i], (others[: 23 - 2 - 2].sum(), np.sqrt(others[0])))


def test_repeated_client_ids_are_refused(spark):
    df, _ = clients(spark, 5, 4, 1)
    with pytest.raises(Exception, match="occurs twice"):
        robust.krum_scores(df.unionByName(df.limit(1)), 1).collect()


def plain_velocity(df):
    w = Window.partitionBy("acct").orderBy(F.unix_micros("ts"))
    count = lambda span: F.count(F.lit(1)).over(w.rangeBetween(-span, 0))
    return df.select("id", count(3_600_000_000).alias("velocity_1h"), count(86_400_000_000).alias("velocity_24h"))


def test_velocity_with_nine_tenths_under_one_account(spark, monkeypatch):
    n = 60_000
    acct = F.when(F.col("id") % 10 < 9, F.lit("hot")).when(F.col("id") % 20 == 9, F.lit(None).cast("string")).otherwise(F.concat(F.lit("a"), (F.col("id") % 300).cast("string")))
    at = F.timestamp_micros(F.lit(1_700_000_000_000_000) + F.pmod(F.xxhash64("id"), F.lit(40 * 86_400)) * 1_000_000)
    df = spark.range(n).select("id", acct.alias("acct"), at.alias("ts"), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(1000)).cast("double").alias("amt"), F.lit(0).alias("at"), F.lit(1).alias("_m"))
    written = []
    keep = ranking.materialize

    def spy(frame, purpose):
        out = keep(frame, purpose)
        if purpose == "prefix":
            written.append(out)
        return out

    monkeypatch.setattr(ranking, "materialize", spy)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # a table this small would be one range
    got = features.velocity_features(df, "acct", "ts", "amt").select("id", "velocity_1h", "velocity_24h")
    assert got.exceptAll(plain_velocity(df)).isEmpty() and got.count() == n
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    sizes = sorted(r["count"] for r in written[0].groupBy("_b").count().collect())
    assert len(sizes) >= 4 and sizes[-1] <= 4 * sizes[len(sizes) // 2]
