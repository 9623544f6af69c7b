"""Parquet tables of a data folder, previews, SQL, sinks."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(folder, f"{name}.parquet"))


def register(df: DataFrame, name: str) -> None:
    df.createOrReplaceTempView(name)


def query(spark: SparkSession, sql: str, **tables: DataFrame) -> DataFrame:
    """Any SQL over registered views; frames passed by name are bound to this query only."""
    return spark.sql(sql, **tables) if tables else spark.sql(sql)


def save(df: DataFrame, folder: str, name: str, fmt: str = "parquet", partition_by: list[str] | None = None) -> str:
    """zstd Parquet, CSV with header, or JSON lines in the processed folder."""
    path = os.path.join(folder, name)
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if fmt == "parquet":
        writer.option("compression", "zstd").parquet(path)
    elif fmt == "csv":
        writer.option("header", True).csv(path)
    elif fmt == "json":
        writer.json(path)
    else:
        raise ValueError(f"unknown format {fmt}")
    return path


def load_sanitised(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(folder, f"{name}_sanitized"))


def preview(df: DataFrame, n: int = 10) -> DataFrame:
    """First rows, at most 100."""
    return df.limit(min(max(n, 0), 100))


def describe(df: DataFrame) -> DataFrame:
    """(ord, column_name, data_type, n_rows): names and types with the row count."""
    cols = F.array(
        *[
            F.struct(F.lit(i).alias("ord"), F.lit(f.name).alias("column_name"), F.lit(f.dataType.simpleString()).alias("data_type"))
            for i, f in enumerate(df.schema.fields)
        ]
    )
    return df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.explode(cols).alias("c"), "n_rows").select("c.*", "n_rows")


def read_json(spark: SparkSession, path: str, schema: object) -> DataFrame:
    return spark.read.schema(schema).json(path)
