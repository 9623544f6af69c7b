"""Stored sketches within their stated errors, merged for any subset of partitions."""

import os

import pytest
from pyspark.sql import functions as F

from ledgerveil.operators import certify, profile, sketches


def part(spark, low, high):
    i = F.col("id")
    return spark.range(low, high).select(
        i.alias("key"), (i % 7).cast("int").alias("small"), F.when(i % 5 == 0, None).otherwise(F.sqrt(i)).alias("root"), F.concat(F.lit("t"), (i % 3000).cast("string")).alias("text"), F.lit(None).cast("double").alias("nothing")
    )


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    out = sketches.SketchStore(spark, str(tmp_path_factory.mktemp("sketches")))
    for name, low, high in (("a", 0, 20_000), ("b", 10_000, 50_000), ("c", 200_000, 200_010)):
        out.add(part(spark, low, high), name)
    return out


def exact(df):
    return {r.column_name: (r.unique_count, r.total_count) for r in profile.uniqueness(df).collect()}


@pytest.mark.parametrize("names", [["a"], ["b", "c"], None])
def test_distinct_within_error(spark, store, names):
    frames = {"a": part(spark, 0, 20_000), "b": part(spark, 10_000, 50_000), "c": part(spark, 200_000, 200_010)}
    df = None
    for n in names or frames:
        df = frames[n] if df is None else df.unionByName(frames[n])
    want = exact(df)
    got = {r.column_name: r for r in store.distinct(names).collect()}
    assert set(got) == set(want)
    for c, (distinct, rows) in want.items():
        assert got[c].n_rows == rows and abs(got[c].n_distinct - distinct) <= max(got[c].error * distinct, 0.5), c


def test_quantiles_within_rank_error(spark, store):
    df = part(spark, 0, 20_000).unionByName(part(spark, 10_000, 50_000))
    for r in store.quantiles([0.05, 0.5, 0.95], ["a", "b"]).collect():
        below, until = df.where(F.col(r.column_name).isNotNull()).agg(F.avg((F.col(r.column_name) < r.value).cast("int")), F.avg((F.col(r.column_name) <= r.value).cast("int"))).first()
        assert below - r.rank_error <= r.probability <= until + r.rank_error
    assert {r.column_name for r in store.quantiles([0.5]).collect()} == {"key", "small", "root"}  # text and empty columns have none


def test_adding_a_partition_touches_that_partition_only(spark, store):
    def stamps():
        return {f: os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(store.path) if "partition=z" not in d for f in fs}

    before = stamps()
    seen = part(spark, 0, 10)
    store.add(seen, "z")
    assert stamps() == before
    store.add(part(spark, 0, 40), "z")  # replaced, not added twice
    assert {r.partition: r.n_rows for r in store.partitions().collect()} == {"a": 20_000, "b": 40_000, "c": 10, "z": 40}
    assert store.distinct(["z"]).where("column_name = 'key'").first().n_distinct == 40


def test_certify_from_sketches(spark, tmp_path):
    df = part(spark, 0, 5000).select("small", "text")
    own = sketches.SketchStore(spark, str(tmp_path))
    own.add(df, "all")
    a, b = certify.certify(df).first(), certify.certify(df, uniqueness=own.uniqueness()).first()
    assert (a.gate3_passed, a.certification_level) == (b.gate3_passed, b.certification_level)
    assert [round(x, -2) for x in own.breaks("small", 2)] == [0.0]
