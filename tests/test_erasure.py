"""Copy-on-write erasure: files, versions, audit chain."""

import json

from pyspark.sql import functions as F

from ledgerveil.operators import audit, erasure


def stored(spark, tmp_path, n=400):
    rows = spark.range(n).select("id", (F.col("id") % 40).alias("who"), F.lit("x").alias("request")).withColumn("who", F.when(F.col("id") == 7, None).otherwise(F.col("who")))
    return rows, erasure.StoredTable.create(rows.repartitionByRange(8, "who"), str(tmp_path / "people"))


def names(table, version=None):
    return {r.file for r in table.files(version).collect()}


def ask(spark, rows):
    return spark.createDataFrame(rows, "ticket string, who long")


def test_only_files_with_a_subject_are_rewritten(spark, tmp_path):
    rows, table = stored(spark, tmp_path)
    before = names(table)
    events = erasure.erase(table, ask(spark, [("t1", 3), ("t2", 4), ("t3", 999), ("t4", None), ("t5", 3)]), "who", "ticket", "s", F.lit("2026-01-01"))
    assert sorted(map(tuple, table.read().collect())) == sorted(map(tuple, rows.where("who IS NULL OR who NOT IN (3, 4)").collect()))
    kept = before & names(table)
    assert len(before) == 8 and 6 <= len(kept) < 8
    assert sorted(map(tuple, table.read(0).collect())) == sorted(map(tuple, rows.collect()))  # the earlier version can still be named
    said = {json.loads(r.details)["request"]: json.loads(r.details) for r in events.collect()}
    assert {k: v["rows"] for k, v in said.items()} == {"t1": 10, "t2": 10, "t3": 0, "t4": 0, "t5": 10}
    assert all("3" != v.get("subject") for v in said.values())
    assert audit.verify(events).count() == 0


def test_nothing_to_erase_changes_nothing(spark, tmp_path):
    _, table = stored(spark, tmp_path)
    before = names(table)
    erasure.erase(table, ask(spark, [("t", 12345)]), "who", "ticket", "s", F.lit("2026-01-01"))
    assert table.version() == 0 and names(table) == before


def test_chain_goes_on_over_erasures(spark, tmp_path):
    rows, table = stored(spark, tmp_path)
    first = erasure.erase(table, ask(spark, [("a", 1), ("b", 2)]), "who", "ticket", "s", F.lit("2026-01-01"))
    second = erasure.erase(table, ask(spark, [("c", 39)]), "who", "ticket", "s", F.lit("2026-01-02"), heads=first)
    chain = first.unionByName(second)
    assert sorted(r.seq for r in chain.collect()) == [1, 2, 3] and audit.verify(chain).count() == 0
    assert table.version() == 2 and table.read().where("who IN (1, 2, 39)").count() == 0
    assert table.read().count() == rows.count() - 30


def test_every_row_of_a_file_may_go(spark, tmp_path):
    rows = spark.range(10).select("id", F.lit(1).cast("long").alias("who"))
    table = erasure.StoredTable.create(rows.coalesce(1), str(tmp_path / "one"))
    erasure.erase(table, ask(spark, [("a", 1)]), "who", "ticket", "s", F.lit("2026-01-01"))
    assert table.read().count() == 0 and table.read().columns == ["id", "who"]
