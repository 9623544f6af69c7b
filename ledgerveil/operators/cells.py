"""Inverted-file index of document vectors with exact answers.

Centroids are fitted on a bounded sample; every document goes to the cell of its nearest centroid and keeps its distance
to it, and a cell knows its radius. A query looks at the cells in order of the best similarity they could hold (triangle
inequality between query, centroid and radius) and stops once no unopened cell can hold a better or equal hit, so that
answers are those of a full scan while most cells stay shut. Cells are folders of the stored index, so shut cells are not
read; large cells are split into blocks, and queries meet blocks in a shuffle, with no pass through the driver.

Vectors are compared by cosine; one of length zero is as similar to everything as 0. The dimension of an
index is the most frequent one, of equally frequent ones the largest; null vectors and vectors of another dimension are not indexed and find nothing.
"""

from __future__ import annotations

import math
import os
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerveil.plans.sizing import lowest_hashed
from ledgerveil.session import durable_dir, materialize

#: Centroids are fitted on so many documents at most, those of the smallest hashed ids.
SAMPLE = 50_000
MOST_CELLS = 4096
#: Rows of a cell that meet queries in one task, and queries that meet them there.
BLOCK_ROWS, BLOCK_QUERIES, BLOCK_BYTES = 20_000, 256, 32 << 20
#: Cells a query opens in its first round; each round opens GROWTH times as many.
FIRST_CELLS, GROWTH = 4, 4
#: Similarities are compared at so many decimals, so that equal vectors tie wherever they are; SLACK is the room bounds leave for rounding.
DIGITS = 12
SLACK = 1e-9
_SLICE = 1024
ZERO_CELL = -1


@dataclass(frozen=True)
class Index:
    """A stored index: ``rows`` in folders by cell, and ``cells`` (cell, centroid, radius, n, blocks)."""

    spark: SparkSession
    path: str
    version: int = 0

    @property
    def cells(self) -> DataFrame:
        return self.spark.read.parquet(os.path.join(self.path, f"cells-{self.version}"))

    @property
    def rows(self) -> DataFrame:
        return self.spark.read.option("basePath", os.path.join(self.path, "rows")).parquet(os.path.join(self.path, "rows"))


def unit(vectors: Sequence) -> np.ndarray:
    m = np.vstack([np.asarray(v, dtype=np.float64) for v in vectors])
    length = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, length, out=np.zeros_like(m), where=length > 0)


def _units(vectors: DataFrame) -> DataFrame:
    """w, of length one; zero vectors go. The length is bound to a lambda variable, so that it is worked out once a vector and not once a component."""
    length = F.sqrt(F.aggregate(F.col("w"), F.lit(0.0), lambda a, x: a + x * x))
    made = F.transform(F.array(F.struct("w", length.alias("n"))), lambda t: F.when(t["n"] > 0, F.transform(t["w"], lambda x: x / t["n"])))
    return vectors.select(F.get(made, F.lit(0)).alias("w")).where("w IS NOT NULL")


def fit_centroids(docs: DataFrame, doc_id: str, vector: str, cells: int | None = None, sample: int = SAMPLE, seed: int = 7) -> np.ndarray:
    """Centroids of the sample's unit vectors; about the square root of the number of documents, MOST_CELLS at most."""
    width = docs.where(F.size(vector) > 0).groupBy(F.size(vector).alias("width")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("width")).first()
    if width is None:
        return np.zeros((0, 0))
    known = docs.where(F.size(vector) == width["width"])
    cells = min(cells or max(1, math.isqrt(width["n"])), MOST_CELLS)
    some = _units(lowest_hashed(known, [doc_id], sample, width["n"]).select(F.col(vector).cast("array<double>").alias("w")))
    # copies count once; the fit runs over all cores
    some = materialize(some.distinct().repartition(docs.sparkSession.sparkContext.defaultParallelism), "sample")
    found = some.count()
    if min(found, cells) < 2:
        return unit([r["w"] for r in some.limit(1).collect()]) if found else np.zeros((0, 0))
    model = KMeans(featuresCol="v", k=min(cells, found), maxIter=10, seed=seed).fit(some.select(array_to_vector("w").alias("v")))
    return np.vstack(model.clusterCenters())


def assigned(docs: DataFrame, vector: str, centroids: np.ndarray) -> DataFrame:
    """``docs`` of the index's dimension with cell and distance (to its centroid, of the unit vector); zero vectors go to ZERO_CELL."""

    @F.pandas_udf("cell int, distance double")
    def place(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        squares = (centroids**2).sum(axis=1)
        for batch in batches:
            out = []
            for at in range(0, len(batch), _SLICE):
                u = unit(batch.iloc[at : at + _SLICE])
                cell = (squares - 2 * (u @ centroids.T)).argmin(axis=1)
                distance = np.linalg.norm(u - centroids[cell], axis=1)
                zero = ~u.any(axis=1)
                out.append(pd.DataFrame({"cell": np.where(zero, ZERO_CELL, cell).astype(np.int32), "distance": np.where(zero, 0.0, distance)}))
            yield pd.concat(out) if out else pd.DataFrame({"cell": pd.Series([], dtype="int32"), "distance": pd.Series([], dtype="float64")})

    fit = docs.where(F.col(vector).isNotNull() & (F.size(vector) == (centroids.shape[1] if centroids.size else -1)))
    return fit.withColumn("_p", place(vector)).select("*", "_p.cell", "_p.distance").drop("_p")


def _store(index: Index, docs: DataFrame, doc_id: str, vector: str, centroids: np.ndarray, before: DataFrame | None) -> Index:
    """Write assigned rows into their cells' folders, and the next version of the table of cells."""
    spark, last = index.spark, index.version
    placed = materialize(assigned(docs, vector, centroids), "placed")
    counts = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("distance").alias("radius"))
    # one row a cell, MOST_CELLS at most
    block_rows = max(1, min(BLOCK_ROWS, BLOCK_BYTES // (8 * max(centroids.shape[1], 1))))
    sizes = materialize(counts.withColumn("blocks", F.ceil(F.col("n") / block_rows).cast("int")), "cell-sizes")
    table = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centroids)] + [(ZERO_CELL, [0.0] * centroids.shape[1])], "cell int, centroid array<double>")
    old = before if before is not None else table.select("cell", F.lit(0).cast("long").alias("old_n"), F.lit(0.0).alias("old_radius"), F.lit(0).alias("old_blocks"))
    merged = table.join(F.broadcast(old), "cell", "left").join(F.broadcast(sizes), "cell", "left").select(
        "cell", "centroid",
        F.greatest(F.coalesce("radius", F.lit(0.0)), "old_radius").alias("radius"), (F.coalesce("n", F.lit(0)) + F.col("old_n")).alias("n"), (F.coalesce("blocks", F.lit(0)) + F.col("old_blocks")).alias("blocks"),
    )
    at = sizes.join(F.broadcast(old), "cell").select("cell", "blocks", "old_blocks")
    # the blocks of a cell are numbered on from those it has; rows of one block are written by one task
    rows = placed.join(F.broadcast(at), "cell").withColumn("block", (F.col("old_blocks") + F.pmod(F.xxhash64(doc_id, "distance"), F.col("blocks"))).cast("int")).drop("blocks", "old_blocks")
    rows.repartition("cell", "block").sortWithinPartitions("cell", "block").write.mode("append").partitionBy("cell").parquet(os.path.join(index.path, "rows"))
    out = Index(spark, index.path, last + 1)
    merged.coalesce(1).write.parquet(os.path.join(index.path, f"cells-{out.version}"))
    return out


def build(docs: DataFrame, doc_id: str, vector: str, cells: int | None = None, path: str | None = None, sample: int = SAMPLE) -> Index:
    """Index all documents that have a vector; other columns of ``docs`` are stored too, for filters."""
    spark = docs.sparkSession
    centroids = fit_centroids(docs, doc_id, vector, cells, sample)
    return _store(Index(spark, path or durable_dir(spark, "cells")), docs, doc_id, vector, centroids, None)


def append(index: Index, docs: DataFrame, doc_id: str, vector: str) -> Index:
    """Add documents to the cells there are; radii grow where they must, so answers stay exact."""
    now = index.cells.orderBy("cell").collect()
    centroids = np.array([r["centroid"] for r in now if r["cell"] != ZERO_CELL])
    before = index.spark.createDataFrame([(r["cell"], r["n"], r["radius"], r["blocks"]) for r in now], "cell int, old_n long, old_radius double, old_blocks int")
    return _store(index, docs, doc_id, vector, centroids, before)


def plan(index: Index, queries: DataFrame) -> DataFrame:
    """(q, query_id, vector, cells, bounds): for each query all cells that hold documents, best possible similarity first; written."""
    known = [r for r in index.cells.where("n > 0").orderBy("cell").collect()]  # MOST_CELLS + 1 rows at most
    names = np.array([r["cell"] for r in known], dtype=np.int32)
    width = len(known[0]["centroid"]) if known else -1
    centroids, radius = np.array([r["centroid"] for r in known]), np.array([r["radius"] for r in known])
    query_type = queries.schema["query_id"].dataType.simpleString()

    def rank(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for start in range(0, len(pdf), _SLICE):
                part = pdf.iloc[start : start + _SLICE]
                u = unit(part["vector"])
                away = np.sqrt(np.maximum((u**2).sum(axis=1)[:, None] - 2 * (u @ centroids.T) + (centroids**2).sum(axis=1)[None], 0.0))
                least = np.maximum(away - radius[None] - SLACK, 0.0)
                best = 1.0 - least**2 / 2
                best[:, names == ZERO_CELL] = 0.0
                best[~u.any(axis=1)] = 0.0
                order = np.argsort(-best, axis=1, kind="stable")
                yield pd.DataFrame({"q": part["q"], "query_id": part["query_id"], "vector": part["vector"], "cells": list(names[order]), "bounds": list(np.take_along_axis(best, order, axis=1))})

    numbered = queries.select(F.monotonically_increasing_id().alias("q"), "query_id", F.col("vector").cast("array<double>").alias("vector")).where(F.size("vector") == width)
    return materialize(materialize(numbered, "queries").mapInPandas(rank, f"q long, query_id {query_type}, vector array<double>, cells array<int>, bounds array<double>"), "cell-plan")


def _meet(index: Index, opened: DataFrame, doc_id: str, vector: str, n: int, condition: Column | None) -> DataFrame:
    """(q, doc, similarity): the best n documents of each block for the queries that opened its cell."""
    asked = opened.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK_QUERIES).cast("int").alias("chunks"))
    cells = index.cells.select("cell", "blocks").join(asked, "cell")
    wanted = [r["cell"] for r in cells.select("cell").collect()]  # MOST_CELLS + 1 at most
    cells = F.broadcast(cells)
    rows = index.rows.where(F.col("cell").isin(wanted))
    if condition is not None:
        rows = rows.where(condition)
    doc_type = index.rows.schema[doc_id].dataType.simpleString()
    blocks = rows.select("cell", "block", F.col(doc_id).alias("doc"), F.col(vector).alias("vector")).join(cells, "cell").select(
        "cell", "block", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), "doc", "vector"
    )
    groups = opened.join(cells, "cell").select(
        "cell", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.pmod(F.xxhash64("q"), F.col("chunks")).cast("int").alias("chunk"), "q", "vector"
    )

    def best(docs: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if docs.empty or asked.empty:
            return pd.DataFrame({"q": [], "doc": [], "similarity": []})
        similar = np.round(unit(asked["vector"]) @ unit(docs["vector"]).T, DIGITS)
        ids, k = docs["doc"].to_numpy(), min(n, len(docs))
        order = np.lexsort((np.broadcast_to(ids, similar.shape), -similar), axis=1)[:, :k]
        return pd.DataFrame({"q": np.repeat(asked["q"].to_numpy(), k), "doc": ids[order].ravel(), "similarity": np.take_along_axis(similar, order, axis=1).ravel()})

    keys = ["cell", "block", "chunk"]
    return blocks.groupBy(*keys).cogroup(groups.groupBy(*keys)).applyInPandas(best, f"q long, doc {doc_type}, similarity double")


def search(index: Index, queries: DataFrame, doc_id: str, vector: str, n: int = 5, condition: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Exact top n: ((query_id, doc_id, similarity, rank), (query_id, opened, cells): how many of how many cells a query opened).

    ``condition`` is a filter on stored columns, applied at the scan.
    """
    todo = plan(index, queries)
    spark, whole = index.spark, todo
    doc_type = index.rows.schema[doc_id].dataType.simpleString() if index.cells.where("n > 0").count() else "long"
    hits = spark.createDataFrame([], f"q long, doc {doc_type}, similarity double")
    counted = todo.select("q", F.lit(0).alias("opened")).limit(0)
    at, step = 0, FIRST_CELLS
    top = Window.partitionBy("q").orderBy(F.col("similarity").desc(), "doc")
    while True:
        # cells from place ``at`` on that may still hold a better or equal hit; bounds fall from place to place
        floor = F.coalesce("floor", F.lit(-2.0)) if "floor" in todo.columns else F.lit(-2.0)
        now = todo.select("q", "vector", F.posexplode(F.arrays_zip(F.slice("cells", at + 1, step).alias("cell"), F.slice("bounds", at + 1, step).alias("bound"))).alias("i", "c"), floor.alias("floor"))
        opened = materialize(now.where(F.col("c.bound") >= F.col("floor") - SLACK).select("q", "vector", F.col("c.cell").alias("cell")), "opened")
        if opened.isEmpty():
            break
        counted = counted.unionByName(opened.groupBy("q").agg(F.count(F.lit(1)).cast("int").alias("opened")))
        found = hits.unionByName(_meet(index, opened, doc_id, vector, n, condition))
        hits = materialize(found.withColumn("rank", F.row_number().over(top)).where(F.col("rank") <= n).drop("rank"), "hits")
        at, step = at + step, step * GROWTH
        worst = hits.groupBy("q").agg(F.when(F.count(F.lit(1)) >= n, F.min("similarity")).alias("floor"))
        left = whole.where(F.size("cells") > at).join(worst, "q", "left")
        todo = materialize(left.where(F.get("bounds", F.lit(at)) >= F.coalesce("floor", F.lit(-2.0)) - SLACK), "unfinished")
    names = whole.select("q", "query_id")
    answers = hits.withColumn("rank", F.row_number().over(top)).join(names, "q").select("query_id", F.col("doc").alias(doc_id), "similarity", "rank")
    return answers, whole.select("q", "query_id", F.size("cells").alias("cells")).join(counted.groupBy("q").agg(F.sum("opened").alias("opened")), "q", "left").select("query_id", "opened", "cells")
