"""Queries on tables as they come at larger sizes: folders of files, many values, many rows."""

import glob
import shutil

import duckdb
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerveil.catalog import ORACLES, QUERIES, streams
from ledgerveil.operators import ledger, split
from ledgerveil.session import durable_dir
from tools.compare import compare, duck


def _folder(spark, sf, tmp_path, name, parts=3):
    """A data folder that holds ``name`` as a folder of files."""
    spark.read.parquet(f"{sf}/{name}.parquet").repartition(parts).write.parquet(str(tmp_path / f"{name}.parquet"))
    return str(tmp_path)


@pytest.mark.parametrize("name,table", [("client_vector_stream", "embeddings"), ("velocity_stream", "events")])
@pytest.mark.parametrize("as_folder", [True, False])
def test_stream_of_a_table(spark, sf, tmp_path, name, table, as_folder):
    if as_folder:
        got = QUERIES[name](spark, _folder(spark, sf, tmp_path, table))
    else:
        shutil.copy(f"{sf}/{table}.parquet", tmp_path)
        got = QUERIES[name](spark, str(tmp_path))
    want = duck(sf).execute(ORACLES[name]).fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want) and want


def test_packed_medians_keep_the_sign_of_zero(spark, tmp_path):
    """A median just below zero rounds to -0.0 in SQL; inside an array that is another value than 0.0."""
    rows = [(i, [-3e-7, 3e-7, 0.5, -0.25], 0) for i in range(3)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    (got,) = QUERIES["packed_median"](spark, str(tmp_path)).collect()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    ((_, want),) = con.execute(ORACLES["packed_median"]).fetchall()
    assert list(map(repr, got["weights"])) == list(map(repr, want)) == ["-0.0", "0.0", "0.5", "-0.25"]


def test_running_epsilon_shuffles_operations_only(spark):
    """No row for each order goes through a shuffle; an account cut by ranges carries its earlier sums along."""
    rows = [(None if i % 5 == 4 else min(i % 7, 1), i, 5.0 + i % 11, 1.0, 0.05 if i % 3 else 1.0, 1 + i % 4) for i in range(3000)]
    df = spark.createDataFrame(rows, "account long, seq long, sigma double, sensitivity double, sampling_rate double, n_steps long")
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # several ranges an account
    durable_dir(spark, "any")  # names the folder of written tables
    written = lambda: set(glob.glob(spark.conf.get("spark.checkpoint.dir") + "/prefix-*"))
    there = written()
    try:
        got = ledger.running_epsilon(df)
        assert [spark.read.parquet(f).count() for f in written() - there] == [3000]
        found = {(r["account"], r["seq"]): r["epsilon"] for r in got.collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
    w = Window.partitionBy("account", "ord").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    plain = ledger._costs(df, "account", ledger.ORDERS).withColumn("cum", F.sum("cost").over(w))
    plain = plain.groupBy("account", "seq").agg(F.min(ledger.to_epsilon(F.col("cum"), F.col("ord"), 1e-5)).alias("e")).collect()
    assert len(found) == len(plain) == 3000
    assert all(abs(found[r["account"], r["seq"]] - r["e"]) < 1e-9 for r in plain)


def test_class_weights_leave_rows_where_they_are(spark):
    """Weights are sent to the rows: a shuffle by label would put every row of a label into one task."""
    df = spark.range(4000).repartition(8).withColumn("label", (F.col("id") % 50 == 0).cast("double"))
    weighted = split.weight_column(df, "label")
    assert weighted.groupBy(F.spark_partition_id()).count().count() == 8
    assert {(r["label"], round(r["weight"], 6)) for r in weighted.select("label", "weight").distinct().collect()} == {(1.0, 25.0), (0.0, 0.510204)}


def test_streams_are_fed_by_several_files(spark, sf, tmp_path, monkeypatch):
    """A part of a stream's input has more files the more rows it has, and all of a part come in one trigger."""
    monkeypatch.setattr(streams, "FILE_ROWS", 300)
    folder, n = streams._in_turn(spark.range(6000), [F.col("id") < 3000, F.col("id") >= 3000], "in")
    assert n == 10 and len(spark.read.parquet(folder).inputFiles()) == 2 * n
    assert spark.read.parquet(folder).count() == 6000
    folder, n = streams._in_turn(spark.range(6000), [F.col("id") < 100, F.col("id") >= 100], "in")
    assert n == 1 and len(spark.read.parquet(folder).inputFiles()) == 2
    for name in ("upload_stream", "compliance_alerts_stream"):
        ok, note = compare(spark, duck(sf), name, sf)
        assert ok, note
