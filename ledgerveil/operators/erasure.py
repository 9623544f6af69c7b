"""Erasure of data subjects from a stored table, copy on write.

A table is a folder of Parquet files and a manifest that names the files of each version. Only files that hold a requested
subject are rewritten; the others keep their names and are listed again. The next version appears when its manifest, one
file written by one task, is in place, so readers see the table before or after an erasure and a failed one leaves no
trace but files that no manifest names. Each request is answered by one event of the audit chain.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerveil.functions.hashing import value_hash
from ledgerveil.operators import audit
from ledgerveil.session import materialize

MANIFEST = "file string, version int"


class StoredTable:
    """A versioned table under ``path``."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    @classmethod
    def create(cls, df: DataFrame, path: str) -> StoredTable:
        out = cls(df.sparkSession, path)
        out._commit(out._write(df, 0), 0)
        return out

    def _write(self, df: DataFrame, version: int) -> DataFrame:
        """Write rows into new files and return their names, relative to the table's folder."""
        folder = os.path.join("data", f"{version}-{uuid.uuid4().hex}")
        target = os.path.join(self.path, folder)
        df.write.parquet(target)
        found = self.spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(target)
        return found.select(F.concat(F.lit(folder + "/"), F.element_at(F.split("path", "/"), -1)).alias("file"))

    def _commit(self, files: DataFrame, version: int) -> None:
        files.select("file", F.lit(version).alias("version")).coalesce(1).write.mode("append").parquet(os.path.join(self.path, "manifest"))

    def manifest(self) -> DataFrame:
        return self.spark.read.schema(MANIFEST).parquet(os.path.join(self.path, "manifest"))

    def version(self) -> int:
        return self.manifest().agg(F.max("version")).first()[0]

    def files(self, version: int | None = None) -> DataFrame:
        """Names of a version's files, the latest by default."""
        at = self.version() if version is None else version
        return self.manifest().where(F.col("version") == at).select("file")

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version; its file names, which Spark lists on the driver for any table, are read from the manifest."""
        return self._rows([r["file"] for r in self.files(version).collect()])

    def _rows(self, names: list[str]) -> DataFrame:
        return self.spark.read.parquet(*[os.path.join(self.path, n) for n in names])


def file_of(table: StoredTable) -> Column:
    """Name, relative to the table's folder, of the file a row was read from."""
    return F.concat_ws("/", F.lit("data"), F.slice(F.split(F.col("_metadata.file_path"), "/"), -2, 2))


def erase(table: StoredTable, requests: DataFrame, subject: str, request_id: str, session: str, ts: Column, heads: DataFrame | None = None) -> DataFrame:
    """Remove the rows of all requested subjects and return the linked audit events, one for each request.

    ``requests``: request id and subject. Requests without a subject remove nothing and are answered too; several requests
    may name one subject. An event names its subject by a digest only, and says how many rows and files were concerned.
    ``heads`` continues a stored chain of the session.
    """
    version = table.version()
    asked = materialize(requests.select(F.col(request_id).alias("request_id"), F.col(subject).alias("subject")), "requests")
    subjects = asked.where("subject IS NOT NULL").select("subject").distinct()
    rows = table.read(version)
    # what a request concerns: rows by subject and file, folded before anything is joined again
    held = rows.select(F.col(subject).alias("subject"), file_of(table).alias("file")).join(subjects, "subject", "left_semi")
    met = materialize(held.groupBy("subject", "file").agg(F.count(F.lit(1)).alias("n")), "erased")
    touched = met.select("file").distinct()
    names = [r["file"] for r in touched.collect()]  # part of a list that the driver holds anyway, to read the table
    if names:
        kept = table._rows(names).join(subjects.withColumnRenamed("subject", subject), subject, "left_anti").select(*rows.columns)
        new = table._write(kept, version + 1)
        table._commit(table.files(version).join(touched, "file", "left_anti").unionByName(new), version + 1)
    sizes = met.groupBy("subject").agg(F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_files"))
    answered = asked.join(sizes, "subject", "left")
    details = F.to_json(F.struct(
        F.col("request_id").cast("string").alias("request"), value_hash(F.col("subject")).alias("subject"),
        F.coalesce("n_rows", F.lit(0)).alias("rows"), F.coalesce("n_files", F.lit(0)).alias("files"),
    ))
    first = 1 if heads is None else 1 + (heads.where(F.col("session_id") == session).agg(F.max("seq")).first()[0] or 0)
    # requests of one erasure are numbered in one session, as the chain walks them in order anyway
    events = answered.select(
        F.lit(session).alias("session_id"), (F.row_number().over(Window.orderBy(F.col("request_id").cast("string"), F.xxhash64("subject"))) + first - 1).cast("long").alias("seq"),
        F.lit("transformation_completed").alias("event_type"), ts.alias("ts"), F.lit("erasure").alias("actor"), F.lit(os.path.basename(table.path)).alias("resource"),
        F.lit("erase_subject").alias("action"), details.alias("details"),
    )
    return materialize(audit.link(events, None if heads is None else heads.where(F.col("session_id") == session).select("session_id", "event_hash", "seq").orderBy(F.desc("seq")).limit(1)), "erasure-events")
