"""Session helper and the one place that decides where durable scratch tables go."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app_name: str = "ledgerveil", master: str | None = None, **conf: object) -> SparkSession:
    """A session with the settings the operators rely on (UTC, AQE, skew join).

    On a cluster the master and sizes come from spark-submit; nothing here
    overrides what the caller or the cluster has set.
    """
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), str(value))
    return builder.getOrCreate()


def durable_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder for a written table or a streaming checkpoint.

    The shared folder named in ``spark.checkpoint.dir`` is used when the session
    has one. A machine-local folder is acceptable for a local master only.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder before running on a cluster")
        base = tempfile.mkdtemp(prefix="ledgerveil-")
        spark.conf.set("spark.checkpoint.dir", base)
    return os.path.join(base, f"{purpose}-{uuid.uuid4().hex}")


def materialize(df: DataFrame, purpose: str) -> DataFrame:
    """Write ``df`` once to the durable folder and read it back (lineage is cut there)."""
    spark = df.sparkSession
    path = durable_dir(spark, purpose)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
