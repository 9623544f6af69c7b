"""Stored column sketches: distinct counts and quantiles per partition, merged for any subset of partitions.

A partition is read once, when it is added; later answers come from its sketches alone. A sketch row says what it was made
of, so that partitions can be added, replaced or left out at any time. Distinct counts come from HyperLogLog sketches,
quantiles from KLL sketches; both merge without loss, and their errors are stated.
"""

from __future__ import annotations

import math
import os
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Buckets of a distinct sketch as a power of two; a merged estimate is off by less than DISTINCT_ERROR with 95% confidence, whatever the size.
LG_K = 14
DISTINCT_ERROR = 2 * 1.04 / math.sqrt(1 << LG_K)
#: Size parameter of a quantile sketch; the rank of an answer is off by less than RANK_ERROR with 99% confidence.
KLL_K = 800
RANK_ERROR = 2.446 / KLL_K**0.9433

SCHEMA = "partition string, ord int, column_name string, data_type string, n_rows long, n_null long, distinct_sketch binary, quantile_sketch binary"


def _is_number(f: T.StructField) -> bool:
    return isinstance(f.dataType, T.NumericType)


class SketchStore:
    """Sketches of a table's columns by partition, as a Parquet table under ``path``."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def add(self, df: DataFrame, partition: str, columns: Sequence[str] | None = None) -> None:
        """Sketch a partition's columns in one aggregate over its rows; a partition of the same name is replaced.

        Text is what values are told apart by, as in the exact profile; quantiles are kept of numeric columns, of finite and infinite
        values but not of nulls and NaN. A column sketched without a value has no sketch.
        """
        fields = [f for f in df.schema.fields if columns is None or f.name in columns]
        wide = []
        for i, f in enumerate(fields):
            c = F.col(f"`{f.name}`")
            wide += [F.count_if(c.isNull()).alias(f"null_{i}"), F.hll_sketch_agg(c.cast("string"), LG_K).alias(f"hll_{i}")]
            if _is_number(f):
                wide.append(F.kll_sketch_agg_double(F.when(~F.isnan(c.cast("double")), c.cast("double")), KLL_K).alias(f"kll_{i}"))
        row = df.agg(F.count(F.lit(1)).alias("n"), *wide)
        cells = [
            F.struct(
                F.lit(partition).alias("partition"), F.lit(i).alias("ord"), F.lit(f.name).alias("column_name"), F.lit(f.dataType.simpleString()).alias("data_type"), F.col("n").alias("n_rows"),
                F.col(f"null_{i}").alias("n_null"), F.col(f"hll_{i}").alias("distinct_sketch"), (F.col(f"kll_{i}") if _is_number(f) else F.lit(None).cast("binary")).alias("quantile_sketch"),
            )
            for i, f in enumerate(fields)
        ]
        out = row.select(F.explode(F.array(*cells)).alias("c")).select("c.*")
        out.drop("partition").coalesce(1).write.mode("overwrite").parquet(os.path.join(self.path, f"partition={partition}"))

    def rows(self, partitions: Sequence[str] | None = None) -> DataFrame:
        stored = self.spark.read.schema(SCHEMA).option("basePath", self.path).parquet(os.path.join(self.path, "partition=*"))
        return stored if partitions is None else stored.where(F.col("partition").isin(list(partitions)))

    def partitions(self) -> DataFrame:
        return self.rows().groupBy("partition").agg(F.max("n_rows").alias("n_rows"), F.count(F.lit(1)).alias("n_columns"))

    def _merged(self, partitions: Sequence[str] | None, sketch: str, merge: Column) -> DataFrame:
        rows = self.rows(partitions)
        totals = rows.groupBy("ord", "column_name").agg(F.sum("n_rows").alias("n_rows"), F.sum("n_null").alias("n_null"), F.first("data_type").alias("data_type"))
        merged = rows.where(F.col(sketch).isNotNull() & (F.col("n_rows") > F.col("n_null"))).groupBy("column_name").agg(merge.alias("sketch"))
        return totals.join(merged, "column_name", "left")

    def distinct(self, partitions: Sequence[str] | None = None) -> DataFrame:
        """(ord, column_name, n_rows, n_null, n_distinct, error): distinct values, null counted as one; ``error`` is relative."""
        merged = self._merged(partitions, "distinct_sketch", F.hll_union_agg("distinct_sketch"))
        estimate = F.coalesce(F.hll_sketch_estimate("sketch"), F.lit(0)) + (F.col("n_null") > 0).cast("int")
        return merged.select("ord", "column_name", "n_rows", "n_null", estimate.cast("long").alias("n_distinct"), F.lit(DISTINCT_ERROR).alias("error"))

    def quantiles(self, probabilities: Sequence[float], partitions: Sequence[str] | None = None) -> DataFrame:
        """(column_name, probability, value, rank_error) of the numeric columns."""
        merged = self._merged(partitions, "quantile_sketch", F.kll_merge_agg_double("quantile_sketch")).where("sketch IS NOT NULL")
        shares = F.array(*[F.lit(float(p)) for p in probabilities])
        each = merged.select("column_name", F.explode(F.arrays_zip(shares.alias("probability"), F.kll_sketch_get_quantile_double("sketch", shares).alias("value"))).alias("q"))
        return each.select("column_name", "q.probability", "q.value", F.lit(RANK_ERROR).alias("rank_error"))

    def uniqueness(self, partitions: Sequence[str] | None = None, threshold: float = 0.95, k_min: int = 5) -> DataFrame:
        """Gate 3 from sketches, in the columns of the exact profile; k is rows / distinct values for texts too."""
        d = self.distinct(partitions)
        ratio = F.least(F.try_divide(F.col("n_distinct"), F.col("n_rows")), F.lit(1.0))
        k = F.greatest(F.lit(1), F.floor(F.try_divide(F.col("n_rows"), F.col("n_distinct")))).cast("bigint")
        return d.select(
            "column_name", F.least("n_distinct", "n_rows").alias("unique_count"), F.col("n_rows").alias("total_count"), ratio.alias("unique_ratio"), k.alias("k_anonymity_estimate"),
            ((ratio > threshold) | (k < k_min)).alias("is_quasi_identifier"),
        )

    def breaks(self, column: str, bins: int = 10, partitions: Sequence[str] | None = None) -> list[float]:
        """Inner cut points of quantile buckets."""
        found = self.quantiles([i / bins for i in range(1, bins)], partitions).where(F.col("column_name") == column).orderBy("probability").collect()
        return [r["value"] for r in found]
