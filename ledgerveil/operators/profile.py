"""Column profiling: personal-data detection, uniqueness, k-anonymity, entropy."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerveil.functions import pii
from ledgerveil.plans.sizing import spread

MATCH_SCHEMA = T.StructType(
    [
        T.StructField("column_name", T.StringType()),
        T.StructField("pii_type", T.StringType()),
        T.StructField("sensitivity", T.StringType()),
        T.StructField("detection_method", T.StringType()),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("pattern_matched", T.StringType()),
        T.StructField("recommendation", T.StringType()),
        T.StructField("ord", T.IntegerType()),
    ]
)


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def name_match(column: str, strict_words: bool = False) -> tuple[str, str] | None:
    """(type, pattern) of the first name pattern found in a column name.

    ``strict_words`` asks for whole words between separators, which avoids hits
    such as "sin" in "business"; the default searches anywhere.
    """
    for pii_type, patterns in pii.NAME_PATTERNS.items():
        for p in patterns:
            probe = rf"(?:^|[^A-Za-z])(?:{p})(?:$|[^A-Za-z])" if strict_words else p
            if re.search(probe, column, re.IGNORECASE):
                return pii_type, p
    return None


def name_matches(spark: SparkSession, columns: Sequence[str], strict_words: bool = False) -> DataFrame:
    """Gate 1: one row per column whose name suggests personal data (schema-sized)."""
    rows = []
    for c in columns:
        hit = name_match(c, strict_words)
        if hit:
            rows.append(
                (c, hit[0], pii.SENSITIVITY.get(hit[0], "low"), "column_name", pii.NAME_CONFIDENCE, hit[1],
                 pii.recommendation(hit[0]), -1)
            )
    return spark.createDataFrame(rows, MATCH_SCHEMA)


def value_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """How many values of each text column contain each value pattern, over the whole table.

    The columns are stacked as (column_name, value) rows, so every pattern is compiled
    once however many columns there are, the table is read once, and counts are
    combined on the map side to one row per column.
    """
    columns = list(columns if columns is not None else string_columns(df))
    if not columns:
        return df.sparkSession.createDataFrame(
            [], "column_name string, ord int, pii_type string, pattern string, n_values bigint, n_match bigint"
        )
    patterns = pii.value_pattern_list()
    # every pattern needs a digit, an @ or a separator: one cheap look decides which ones to try
    marks = {
        "_digit": F.col("value").rlike("[0-9]"),
        "_at": F.col("value").contains("@"),
        "_sep": F.col("value").rlike("[:-]"),
    }
    counts = (
        _stacked(spread(df.select(*columns)), columns)
        .withColumns(marks)
        .groupBy("column_name")
        .agg(
            F.count("value").alias("n_values"),
            *[F.count_if(F.col(_mark(t, p)) & F.col("value").rlike(p)).alias(f"m{i}") for i, t, p in patterns],
        )
    )
    cells = [
        F.struct(F.lit(i).alias("ord"), F.lit(t).alias("pii_type"), F.lit(p).alias("pattern"), F.col(f"m{i}").alias("n_match"))
        for i, t, p in patterns
    ]
    return counts.select("column_name", "n_values", F.explode(F.array(*cells)).alias("r")).select(
        "column_name", "r.ord", "r.pii_type", "r.pattern", "n_values", "r.n_match"
    )


def _mark(pii_type: str, pattern: str) -> str:
    """The character class without which a value pattern cannot match."""
    if pii_type == "email":
        return "_at"
    if pii_type == "mac_address" or "a-fA-F" in pattern:
        return "_sep"
    return "_digit"


def _lookup(key: Column, table: dict[str, str], default: str) -> Column:
    out = None
    for k, v in table.items():
        out = F.when(key == k, F.lit(v)) if out is None else out.when(key == k, F.lit(v))
    return out.otherwise(F.lit(default))


def sensitivity_of(pii_type: Column) -> Column:
    return _lookup(pii_type, pii.SENSITIVITY, "low")


def recommendation_of(pii_type: Column) -> Column:
    return F.when(sensitivity_of(pii_type) == "critical", F.lit("remove")).otherwise(F.lit("transform"))


def treatment_of(pii_type: Column) -> Column:
    return _lookup(pii_type, pii.DEFAULT_TREATMENT, pii.FALLBACK_TREATMENT)


def value_matches(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Gate 2: patterns found in more than a tenth of a column's non-null values."""
    ratio = F.col("n_match") / F.col("n_values")
    return (
        value_profile(df, columns)
        .where(F.col("n_values") > 0)
        .where(ratio > pii.VALUE_RATIO_MIN)
        .select(
            "column_name",
            "pii_type",
            sensitivity_of(F.col("pii_type")).alias("sensitivity"),
            F.lit("regex").alias("detection_method"),
            F.least(F.lit(0.9), F.lit(0.5) + ratio).alias("confidence"),
            F.col("pattern").alias("pattern_matched"),
            recommendation_of(F.col("pii_type")).alias("recommendation"),
            "ord",
        )
    )


def detect(df: DataFrame, strict_words: bool = False) -> DataFrame:
    """Best match per column: highest confidence, the earlier gate and pattern on ties."""
    found = name_matches(df.sparkSession, df.columns, strict_words).unionByName(value_matches(df))
    best = F.max_by(F.struct(*[c for c in MATCH_SCHEMA.names if c != "column_name"]),
                    F.struct("confidence", (-F.col("ord")).alias("first")))
    return found.groupBy("column_name").agg(best.alias("b")).select("column_name", "b.*")


def detection_summary(df: DataFrame, matches: DataFrame, strict: bool = True) -> DataFrame:
    """One row: columns scanned, columns flagged, and whether the table passes."""
    severe = F.col("sensitivity").isin("critical", "high")
    return matches.agg(
        F.lit(len(df.columns)).cast("bigint").alias("total_columns"),
        F.count(F.lit(1)).alias("columns_with_pii"),
        F.coalesce(F.bool_or(F.col("sensitivity") == "critical"), F.lit(False)).alias("critical_pii_found"),
        F.coalesce(F.bool_or(severe), F.lit(False)).alias("high_pii_found"),
    ).withColumn("passed", ~F.col("high_pii_found") if strict else F.lit(True))


def pii_columns(df: DataFrame, strict_words: bool = False) -> list[str]:
    hits = {r[0] for r in detect(df, strict_words).select("column_name").collect()}  # at most one row per column
    return [c for c in df.columns if c in hits]


def safe_columns(df: DataFrame, strict_words: bool = False) -> list[str]:
    flagged = set(pii_columns(df, strict_words))
    return [c for c in df.columns if c not in flagged]


def safe_projection(df: DataFrame, strict_words: bool = False) -> DataFrame:
    return df.select(*safe_columns(df, strict_words))


def detection_report(matches: DataFrame) -> DataFrame:
    """Report lines ordered by sensitivity text, one per flagged column."""
    line = F.format_string(
        "[%-8s] %-30s | %-15s | conf=%.2f | %s",
        F.upper("sensitivity"), "column_name", "pii_type", "confidence", "recommendation",
    )
    return matches.select("sensitivity", "column_name", line.alias("line")).orderBy("sensitivity", "column_name")


# --- uniqueness, k-anonymity, entropy ------------------------------------------


def _stacked(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column_name, value) rows for several columns, without a join."""
    if not columns:
        return df.select(F.lit("").alias("column_name"), F.lit("").alias("value")).where(F.lit(False))
    pairs = F.array(
        *[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in columns]
    )
    return df.select(F.explode(pairs).alias("p")).select("p.*")


def _identity(value: Column) -> Column:
    """What tells values apart: long texts travel as a 128-bit digest, not as themselves."""
    return F.when(F.length(value) > 48, F.concat(F.lit("md5:"), F.md5(value))).otherwise(value)


def uniqueness(
    df: DataFrame, columns: Sequence[str] | None = None, threshold: float = 0.95, k_min: int = 5, approximate: bool = False
) -> DataFrame:
    """Gate 3: distinct values (null counts as one), their ratio and the k estimate per column.

    Distinct values are counted with multiplicity first (map-side combined), then
    folded to one row per column. ``approximate`` estimates distinct counts with
    HyperLogLog++ instead, which shuffles one sketch per column and task; the k
    estimate is then rows / distinct values for text columns too.
    """
    columns = list(columns if columns is not None else df.columns)
    texts = [] if approximate else [c for c in string_columns(df) if c in columns]
    if approximate:
        has_null = F.max(F.col("value").isNull().cast("int"))
        stats = _stacked(df, columns).groupBy("column_name").agg(
            (F.approx_count_distinct("value", 0.01) + has_null).cast("bigint").alias("unique_count"),
            F.count(F.lit(1)).alias("total_count"),
            F.lit(None).cast("bigint").alias("min_group"),
        )
    else:
        stacked = _stacked(df, columns).select("column_name", _identity(F.col("value")).alias("value"))
        sizes = stacked.groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("m"))
        stats = sizes.groupBy("column_name").agg(
            F.count(F.lit(1)).alias("unique_count"),
            F.sum("m").alias("total_count"),
            F.min("m").alias("min_group"),
        )
    k = F.when(F.col("column_name").isin(texts), F.col("min_group")) if texts else F.when(F.lit(False), F.col("min_group"))
    k = k.otherwise(F.greatest(F.lit(1), F.floor(F.col("total_count") / F.col("unique_count")))).cast("bigint")
    ratio = F.col("unique_count") / F.col("total_count")
    return stats.select(
        "column_name",
        "unique_count",
        "total_count",
        ratio.alias("unique_ratio"),
        k.alias("k_anonymity_estimate"),
        ((ratio > threshold) | (k < k_min)).alias("is_quasi_identifier"),
    )


def equivalence_classes(df: DataFrame, quasi_identifiers: Sequence[str]) -> DataFrame:
    return df.groupBy(*quasi_identifiers).agg(F.count(F.lit(1)).alias("group_size"))


def k_anonymity(df: DataFrame, quasi_identifiers: Sequence[str], k: int = 5) -> DataFrame:
    """One row: smallest class over the quasi-identifiers that exist, and whether it reaches k."""
    valid = [c for c in quasi_identifiers if c in df.columns]
    if not valid:
        return df.agg(F.count(F.lit(1)).alias("actual_k")).select(F.lit(True).alias("passed"), "actual_k")
    smallest = equivalence_classes(df, valid).agg(F.min("group_size").alias("actual_k"))
    return smallest.select((F.col("actual_k") >= k).alias("passed"), "actual_k")


def violating_classes(df: DataFrame, quasi_identifiers: Sequence[str], k: int = 5) -> DataFrame:
    return equivalence_classes(df, quasi_identifiers).where(F.col("group_size") < k)


def reidentification_risk(
    df: DataFrame, quasi_identifiers: Sequence[str], sensitive: str, block_at: float = 0.05
) -> DataFrame:
    """One row: 1/k risk, l-diversity of the sensitive value, and the release decision.

    Distinct sensitive values are reached by a count per (class, value), so a class
    holding most of the table is combined on the map side.
    """
    qi = list(quasi_identifiers)
    per_value = df.groupBy(*qi, sensitive).agg(F.count(F.lit(1)).alias("m"))
    per_class = per_value.groupBy(*qi).agg(F.sum("m").alias("size"), F.count(F.col(sensitive)).alias("l"))
    return per_class.agg(
        F.count(F.lit(1)).alias("n_classes"),
        F.min("size").alias("k_min"),
        F.min("l").alias("l_diversity"),
    ).select(
        "n_classes",
        "k_min",
        "l_diversity",
        (F.lit(1.0) / F.col("k_min")).alias("risk"),
        (F.lit(1.0) / F.col("k_min") >= block_at).alias("blocked"),
    )


def _count_characters(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(column, code point, count) of each batch; whole values, a few hundred at a time."""
    for pdf in batches:
        for column, values in pdf.groupby("column_name")["value"]:
            total = np.zeros(0, dtype=np.int64)
            for at in range(0, len(values), 256):
                text = "".join(values.iloc[at : at + 256])
                points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
                counts = np.bincount(points, minlength=len(total))
                counts[: len(total)] += total
                total = counts
            present = np.flatnonzero(total)
            yield pd.DataFrame({"column_name": column, "ch": present.astype(np.int32), "m": total[present]})


def character_entropy(
    df: DataFrame, columns: Sequence[str] | None = None, threshold: float = 4.0, unique_min: float = 0.5
) -> DataFrame:
    """Gate 4: Shannon entropy of the characters of every text column, over the whole table.

    Characters are counted on Arrow batches; a batch hands on one row per column and
    distinct character, never one row per character.
    """
    columns = list(columns if columns is not None else string_columns(df))
    values = _stacked(spread(df.select(*columns)), columns).where(F.col("value").isNotNull())
    distinct = values.groupBy("column_name", _identity(F.col("value")).alias("value")).agg(F.count(F.lit(1)).alias("m"))
    ratio = distinct.groupBy("column_name").agg(
        (F.count(F.lit(1)) / F.sum("m")).alias("unique_ratio"), F.sum("m").alias("n_values")
    )
    chars = (
        values.mapInPandas(_count_characters, "column_name string, ch int, m bigint")
        .groupBy("column_name", "ch")
        .agg(F.sum("m").alias("m"))
    )
    # H = log2(N) - sum(m log2 m) / N needs one pass over the character counts
    h = chars.groupBy("column_name").agg(
        (F.log2(F.sum("m")) - F.sum(F.col("m") * F.log2("m")) / F.sum("m")).alias("entropy"),
        F.count(F.lit(1)).alias("n_chars"),
    )
    out = ratio.join(h, "column_name", "left")
    entropy = F.coalesce("entropy", F.lit(0.0))
    top = F.when(F.col("n_chars") > 1, F.log2("n_chars")).otherwise(F.lit(1.0))
    return out.select(
        "column_name",
        entropy.alias("entropy"),
        F.least(entropy / top, F.lit(1.0)).alias("normalized_entropy"),
        "unique_ratio",
        ((entropy > threshold) & (F.col("unique_ratio") > unique_min)).alias("is_high_entropy"),
        F.lit(float(threshold)).alias("threshold_used"),
    )
