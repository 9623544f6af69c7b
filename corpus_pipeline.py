"""A training corpus from ``documents``: toxicity, line dedup, document dedup, decontamination, mixing."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerveil.llm import fuzzy_lines, ngram_join, pfair, toxicity, wumanber
from ledgerveil.llm.text import bucket_of, numbered
from ledgerveil.session import durable_dir
from ledgerveil.sources.tables import table

#: No SQL twin: the first stage is a trained classifier.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scoring below 0.5; labels of the held-out fold (crc32 of the id modulo 5 is 0) are not learned from."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").where(bucket_of("doc_id", 5) != 0))
    return toxicity.reject(docs, model)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without repeated and near-repeated lines; a document left with blank lines only goes."""
    count = next(f"removed{i}" for i in range(len(docs.columns) + 1) if f"removed{i}" not in docs.columns)
    out = fuzzy_lines.dedup(docs, removed=count)
    emptied = (F.col(count) > 0) & ~F.col("text").rlike(r"\S")
    return out.where(~F.coalesce(emptied, F.lit(False))).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group linked at shingle similarity 0.75."""
    return ngram_join.first_of_group(docs).select(*docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no ten-word window of the benchmark."""
    return wumanber.clean(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the order of the mix, with mix_slot and mix_position; targets follow the square root of source sizes.

    Input columns of these two names give way to the new ones; null and repeated ids have a place like any other.
    """
    names = docs.columns
    docs, of = numbered(docs)
    as_source = docs.select(F.col(of["doc_id"]).alias("doc_id"), F.col(of["source"]).alias("source"))
    place = pfair.mix(as_source, pfair.tempered(as_source)).groupBy("doc_id").agg(F.min("slot").alias("slot"), F.min("position").alias("position"))
    out = docs.join(place, docs[of["doc_id"]].eqNullSafe(place["doc_id"]), "left").orderBy("position")
    added = {"mix_slot": "slot", "mix_position": "position"}
    return out.select(*[F.col(of[c]).alias(c) for c in names if c not in added], *[F.col(p).alias(c) for c, p in added.items()])


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_lines),
    ("n-gram Jaccard join", drop_copies),
    ("benchmark decontamination", drop_leaks),
    ("mixing", mix),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = spark.read.parquet(os.path.join(sf_dir, "documents.parquet"))
    for name, stage in STAGES:
        path = durable_dir(spark, "pipeline-" + name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
