"""The shared pattern library as a table: upsert, listing, search, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerveil.functions.scoring import is_fact_based, novelty

# --- fixed values ------------------------------------------------------------------------
PATTERN_TYPES = ["fact", "emergent", "variant", "zero_day", "historical"]
SEVERITIES = ["critical", "high", "medium", "low", "info"]
STATUSES = ["active", "under_review", "confirmed", "deprecated", "false_positive"]
# -------------------------------------------------------------------------------------------

_MAP, _LIST = T.MapType(T.StringType(), T.DoubleType()), T.ArrayType(T.StringType())
SCHEMA = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("pattern_id", "name", "description", "pattern_type", "severity", "status")]
    + [
        T.StructField("observation_count", T.LongType()),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("false_positive_rate", T.DoubleType()),
        T.StructField("affected_amount_total", T.DoubleType()),
        T.StructField("source_bank_count", T.LongType()),
        T.StructField("first_seen", T.TimestampType()),
        T.StructField("last_seen", T.TimestampType()),
        T.StructField("frequency_per_day", T.DoubleType()),
        T.StructField("feature_signature", _MAP),
        T.StructField("attack_vector", T.StringType()),
        T.StructField("mitre_id", T.StringType()),
        T.StructField("tags", _LIST),
        T.StructField("related_patterns", _LIST),
        T.StructField("version", T.IntegerType()),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("updated_at", T.TimestampType()),
    ]
)


def as_entries(df: DataFrame, as_of: Column) -> DataFrame:
    """Fill a partial pattern table up to the full schema (defaults, timestamps = as_of)."""
    defaults = {
        "status": F.lit("active"),
        "observation_count": F.lit(0),
        "confidence": F.lit(0.0),
        "false_positive_rate": F.lit(0.0),
        "affected_amount_total": F.lit(0.0),
        "source_bank_count": F.lit(0),
        "frequency_per_day": F.lit(0.0),
        "feature_signature": F.create_map().cast("map<string,double>"),
        "tags": F.array().cast("array<string>"),
        "related_patterns": F.array().cast("array<string>"),
        "version": F.lit(1),
        **{c: as_of for c in ("first_seen", "last_seen", "created_at", "updated_at")},
    }
    cols = []
    for f in SCHEMA.fields:
        c = F.col(f.name) if f.name in df.columns else defaults.get(f.name, F.lit("") if isinstance(f.dataType, T.StringType) else F.lit(None))
        cols.append(c.cast(f.dataType).alias(f.name))
    return df.select(*cols)


def upsert(existing: DataFrame, incoming: DataFrame, as_of: Column) -> DataFrame:
    """New snapshot: a known id gets version + 1, the larger counts and its first sighting;
    everything else comes from the new entry, stamped as updated at ``as_of``."""
    names = SCHEMA.names
    old = existing.select(F.col("pattern_id").alias("_id"), F.struct(*names).alias("o"))
    new = incoming.select("pattern_id", F.struct(*names).alias("n"))
    j = old.join(new, F.col("_id") == F.col("pattern_id"), "full")
    both = F.col("o").isNotNull() & F.col("n").isNotNull()
    out = []
    for f in SCHEMA.fields:
        o, n = F.col(f"o.{f.name}"), F.col(f"n.{f.name}")
        merged = n
        if f.name == "version":
            merged = o + 1
        elif f.name in ("observation_count", "source_bank_count"):
            merged = F.greatest(o, n)
        elif f.name == "first_seen":
            merged = o
        elif f.name == "updated_at":
            merged = n = as_of.cast("timestamp")
        out.append(F.when(both, merged).when(F.col("n").isNotNull(), n).otherwise(o).alias(f.name))
    return j.select(*out)


def remove(library: DataFrame, ids: DataFrame) -> DataFrame:
    return library.join(ids.select("pattern_id").distinct(), "pattern_id", "left_anti").select(*SCHEMA.names)


def listing(
    library: DataFrame, pattern_type: str | None = None, severity: str | None = None, status: str | None = None,
    min_confidence: float = 0.0, offset: int = 0, limit: int | None = 50,
) -> DataFrame:
    """Filtered page, newest update first."""
    out = library.where(F.col("confidence") >= F.lit(float(min_confidence)))
    for name, wanted in (("pattern_type", pattern_type), ("severity", severity), ("status", status)):
        if wanted is not None:
            out = out.where(F.col(name) == wanted)
    out = out.orderBy(F.col("updated_at").desc(), "pattern_id").offset(offset)
    return out if limit is None else out.limit(limit)


def search(library: DataFrame, text: str) -> DataFrame:
    """Case-insensitive substring in name, description or any tag."""
    q = F.lit(text.lower())
    hit = F.lower("name").contains(q) | F.lower("description").contains(q) | F.exists(
        "tags", lambda t: F.lower(t).contains(q)
    )
    return library.where(hit)


def with_novelty(library: DataFrame, as_of: Column) -> DataFrame:
    return library.withColumn(
        "novelty", novelty(F.col("last_seen"), F.col("confidence"), F.col("source_bank_count"), as_of)
    )


def fact_based(library: DataFrame) -> DataFrame:
    return library.where(is_fact_based(F.col("observation_count"), F.col("confidence"), F.col("source_bank_count")))


def emergent(library: DataFrame, as_of: Column, minimum: float = 0.3) -> DataFrame:
    """Emergent and zero-day patterns by novelty."""
    return (
        with_novelty(library.where(F.col("pattern_type").isin("emergent", "zero_day")), as_of)
        .where(F.col("novelty") >= minimum)
        .orderBy(F.col("novelty").desc(), "pattern_id")
    )


def trending(library: DataFrame, as_of: Column, k: int = 10) -> DataFrame:
    score = F.lit(0.5) * F.col("frequency_per_day") + F.lit(0.5) * F.col("novelty")
    return with_novelty(library, as_of).withColumn("trend", score).orderBy(F.col("trend").desc(), "pattern_id").limit(k)


def promote(library: DataFrame, as_of: Column) -> DataFrame:
    """Emergent patterns with enough backing become confirmed facts of the next version."""
    ready = (F.col("pattern_type") == "emergent") & is_fact_based(
        F.col("observation_count"), F.col("confidence"), F.col("source_bank_count")
    )
    return library.withColumns(
        {
            "pattern_type": F.when(ready, F.lit("fact")).otherwise(F.col("pattern_type")),
            "status": F.when(ready, F.lit("confirmed")).otherwise(F.col("status")),
            "version": F.when(ready, F.col("version") + 1).otherwise(F.col("version")),
            "updated_at": F.when(ready, as_of.cast("timestamp")).otherwise(F.col("updated_at")),
        }
    )


def zero_filled(df: DataFrame, column: str, names: list[str]) -> DataFrame:
    """(kind, name, n) with a row for every known value of an enumeration."""
    wide = df.agg(*[F.count_if(F.col(column) == v).alias(v) for v in names])
    cells = [F.struct(F.lit(column).alias("kind"), F.lit(v).alias("name"), F.col(v).alias("n")) for v in names]
    return wide.select(F.explode(F.array(*cells)).alias("r")).select("r.*")


def statistics(library: DataFrame) -> DataFrame:
    """One row: totals, per type and severity, fact-based and emergent counts, confidence, coverage."""
    fact = is_fact_based(F.col("observation_count"), F.col("confidence"), F.col("source_bank_count"))
    return library.agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(F.col("pattern_type") == t).alias(f"type_{t}") for t in PATTERN_TYPES],
        *[F.count_if(F.col("severity") == s).alias(f"severity_{s}") for s in SEVERITIES],
        F.count_if(fact).alias("fact_based"),
        F.count_if(F.col("pattern_type").isin("emergent", "zero_day")).alias("emergent"),
        F.round(F.coalesce(F.avg("confidence"), F.lit(0.0)), 4).alias("avg_confidence"),
        F.coalesce(F.sum("observation_count"), F.lit(0)).alias("total_observations"),
        F.coalesce(F.max("source_bank_count"), F.lit(0)).alias("banks_contributing"),
    )



def empty(spark: SparkSession) -> DataFrame:
    """A library without patterns; a deployment starts from this or from a stored table."""
    return spark.createDataFrame([], SCHEMA)
