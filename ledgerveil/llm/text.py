"""Small helpers the operators of this package share."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerveil.session import materialize

PART_ROWS = 512
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def spaced_words(text: str | None) -> list[bytes]:
    """Maximal runs without blank or \\x09-\\x0D, ASCII capitals lowered; null gives none."""
    return (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()


def bucket_of(key: str, divisor: int) -> Column:
    """crc32 of the key as text, modulo ``divisor``; a null key gives 0."""
    return F.coalesce(F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(divisor)).cast("int"), F.lit(0))


def numbered(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with columns in0, in1, ... in their order, and which is which: no column of the input clashes with those an operator adds."""
    names = {c: f"in{i}" for i, c in enumerate(df.columns)}
    return df.toDF(*names.values()), names


def small_batches(df: DataFrame) -> DataFrame:
    """Have the session hand rows to Python in Arrow batches of ``PART_ROWS``: whole texts are long, and two tasks share a worker's memory."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", PART_ROWS)
    return df


def map_arrow(df: DataFrame, rows: Callable[[Iterator[dict]], Iterator[dict]], schema: str) -> DataFrame:
    """Run ``rows`` over each partition; it takes and yields dicts of column lists, one per Arrow batch."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in rows(b.to_pydict() for b in batches if b.num_rows):
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in arrow], schema=arrow)

    return small_batches(df).mapInArrow(run, schema)


def written(df: DataFrame, purpose: str) -> DataFrame:
    """``materialize`` for large steps: lets go at once of the shuffle files behind the table.

    Spark frees them when the driver happens to collect its garbage; the second collection sees what the first released.
    """
    out = materialize(df, purpose)
    time.sleep(0.2)  # until the listeners have let go of the query
    del df
    for _ in range(2):
        out.sparkSession.sparkContext._jvm.System.gc()
        time.sleep(0.2)
    return out


FILTER_BITS = 1 << 23


def bit_set(wanted: DataFrame, key: str) -> DataFrame:
    """(_word, _bits): a set of hash-like longs as bits, FILTER_BITS / 64 rows at most, built in Spark and small to send out."""
    slot = F.pmod(key, F.lit(FILTER_BITS))
    bit = F.expr(f"shiftleft(1L, CAST(pmod(`{key}`, {FILTER_BITS}) & 63 AS INT))")
    return materialize(wanted.select(F.shiftright(slot, 6).alias("_word"), bit.alias("b")).groupBy("_word").agg(F.bit_or("b").alias("_bits")), "bits")


def with_bit(df: DataFrame, key: str, bits: DataFrame) -> DataFrame:
    """``df`` with _in: false if ``key`` is certainly not in the set, true if it may be."""
    slot = F.pmod(key, F.lit(FILTER_BITS))
    joined = df.withColumn("_word", F.shiftright(slot, 6)).join(F.broadcast(bits), "_word", "left")
    return joined.withColumn("_in", F.coalesce(F.getbit("_bits", slot.bitwiseAND(F.lit(63)).cast("int")) == 1, F.lit(False))).drop("_word", "_bits")


def parted(df: DataFrame, key: Column, wanted: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """(rows whose hash-like long ``key`` may be in ``wanted``, rows whose key is not), so that only the first need a join.

    ``name`` is the column of ``wanted``. A null key is in neither set of keys and goes with the second.
    """
    told = with_bit(df.withColumn("_key", key), "_key", bit_set(wanted, name)).drop("_key")
    return told.where("_in").drop("_in"), told.where("NOT _in").drop("_in")


#: A key is hot when it holds over 1 / HOT_SHARE of all rows; there are fewer than HOT_SHARE such keys, whatever the data.
HOT_SHARE = 1000


def join_totals(rows: DataFrame, totals: DataFrame, key: str) -> DataFrame:
    """``rows`` with the columns of ``totals`` (one row a key, null included, with the number of rows as n).

    Totals of hot keys, fewer than HOT_SHARE rows, are sent out; rows of all other keys are joined by a shuffle in which no key
    holds more than 1 / HOT_SHARE of the rows. ``rows`` and ``totals`` are read twice: pass written tables or cheap plans.
    """
    others = [c for c in totals.columns if c != key]
    all_rows = materialize(totals, "totals")
    whole = all_rows.agg(F.sum("n")).first()[0] or 0
    hot = F.col("n") * HOT_SHARE > F.lit(whole)
    few, rest = (all_rows.where(c).withColumnRenamed(key, "_total_key") for c in (hot, ~hot))
    same = rows[key].eqNullSafe(F.col("_total_key"))
    sent = rows.join(F.broadcast(few), same, "inner")
    shuffled = rows.join(F.broadcast(few.select("_total_key")), same, "left_anti")
    shuffled = shuffled.join(rest, shuffled[key].eqNullSafe(F.col("_total_key")), "inner")
    return sent.select(*rows.columns, *others).unionByName(shuffled.select(*rows.columns, *others))
