"""Document table, text features, nearest-document retrieval and context assembly."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import IDF, HashingTF, Normalizer, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ledgerveil.plans.sizing import bounded_rows

# queries (and their bytes) handled in one pass over the corpus; more are answered in further passes
QUERY_BLOCK = 20_000
QUERY_BYTES = 64 << 20
# queries scored against one Arrow batch at a time
_SLICE = 512
# sparse documents multiplied with a slice of queries at a time
_ROWS = 32
# hash buckets of sparse text vectors
SPARSE_FEATURES = 1 << 20


def upsert_documents(corpus: DataFrame, incoming: DataFrame, key: str = "doc_id") -> DataFrame:
    """Corpus with new and replaced documents (equal ids: the incoming row wins)."""
    return corpus.join(incoming.select(key), key, "left_anti").unionByName(incoming)


def _unit(rows: list) -> np.ndarray:  # noqa: ANN001
    m = np.vstack([np.asarray(r, dtype=np.float64) for r in rows])
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, n, out=np.zeros_like(m), where=n > 0)


class _Postings:
    """Sparse unit vectors of some queries, by feature."""

    def __init__(self, indices: list, values: list) -> None:
        self.n = len(indices)
        row, at, w = _flat(indices, values)
        order = np.argsort(at, kind="stable")
        self.at, self.row, self.w = at[order], row[order], w[order]

    def dot(self, indices: list, values: list) -> np.ndarray:
        """Similarities (documents x queries) of sparse documents."""
        out = np.zeros((len(indices), self.n))
        for i in range(0, len(indices), _ROWS):
            row, at, w = _flat(indices[i : i + _ROWS], values[i : i + _ROWS])
            low, high = np.searchsorted(self.at, at), np.searchsorted(self.at, at, "right")
            size = high - low
            met = np.arange(size.sum()) + np.repeat(low - (np.cumsum(size) - size), size)
            part = np.bincount(np.repeat(row, size) * self.n + self.row[met], np.repeat(w, size) * self.w[met], len(out[i : i + _ROWS]) * self.n)
            out[i : i + _ROWS] = part.reshape(-1, self.n)
        return out


def _flat(indices: list, values: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, feature, weight) of sparse vectors scaled to unit length."""
    row = np.repeat(np.arange(len(indices)), [len(x) for x in indices])
    at = np.concatenate([np.asarray(x, np.int64) for x in indices] or [np.zeros(0, np.int64)])
    w = np.concatenate([np.asarray(x, np.float64) for x in values] or [np.zeros(0)])
    norm = np.sqrt(np.bincount(row, w * w, len(indices)))
    return row, at, np.divide(w, norm[row], out=np.zeros_like(w), where=norm[row] > 0)


def _block(corpus: DataFrame, queries: list, doc_id: str, vector: str, n: int, query_type: str) -> DataFrame:  # noqa: ANN001
    """Candidates of one query block: each Arrow batch hands on its own top n per query."""
    qids = [r["query_id"] for r in queries]
    sparse = isinstance(corpus.schema[vector].dataType, StructType)
    if sparse:
        asked = [[r["vector"] for r in queries[at : at + _SLICE]] for at in range(0, len(queries), _SLICE)]
        shared = corpus.sparkSession.sparkContext.broadcast([_Postings([v["indices"] for v in vs], [v["values"] for v in vs]) for vs in asked])
        corpus = corpus.select(doc_id, F.col(f"{vector}.indices").alias("_at"), F.col(f"{vector}.values").alias("_w"))
    else:
        shared = corpus.sparkSession.sparkContext.broadcast(_unit([r["vector"] for r in queries]))
        corpus = corpus.select(doc_id, vector)
    doc_type = corpus.schema[doc_id].dataType.simpleString()

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if pdf.empty:
                continue
            docs, ids, k = None if sparse else _unit(list(pdf[vector])), pdf[doc_id].to_numpy(), min(n, len(pdf))
            for at in range(0, len(qids), _SLICE):
                if sparse:
                    sims = shared.value[at // _SLICE].dot(list(pdf["_at"]), list(pdf["_w"]))
                else:
                    sims = docs @ shared.value[at : at + _SLICE].T
                order = np.lexsort((np.broadcast_to(ids[:, None], sims.shape), -sims), axis=0)[:k]
                yield pd.DataFrame(
                    {
                        "query_id": np.repeat(np.asarray(qids[at : at + _SLICE]), k),
                        doc_id: ids[order].T.ravel(),
                        "similarity": np.take_along_axis(sims, order, axis=0).T.ravel(),
                    }
                )

    return corpus.mapInPandas(
        score, f"query_id {query_type}, {doc_id} {doc_type}, similarity double"
    )


def nearest(
    corpus: DataFrame, queries: DataFrame, doc_id: str, vector: str, n: int = 5, query_block: int = QUERY_BLOCK,
) -> DataFrame:
    """Exact top n documents by cosine similarity: (query_id, doc_id, similarity, rank).

    ``queries``: query_id, vector; vectors are arrays or, on both sides, structs (indices, values). The corpus is scanned once per block of queries and
    never shuffled whole; only per-batch top n rows travel. A metadata filter is a
    ``where`` on the corpus and reaches the scan.
    """
    query_type = queries.schema["query_id"].dataType.simpleString()
    q = queries.select("query_id", "vector")
    sparse = isinstance(corpus.schema[vector].dataType, StructType)
    total, width = q.agg(F.count(F.lit(1)), F.max(F.size("vector.indices") * 3 if sparse else F.size("vector"))).first()
    query_block = max(1, min(query_block, QUERY_BYTES // (8 * max(width or 1, 1))))
    blocks = max(1, -(-total // query_block))
    out: DataFrame | None = None
    for b in range(blocks):
        part = q if blocks == 1 else q.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b)
        rows = bounded_rows(part, query_block * 2 + 100, "query block")
        if not rows:
            continue
        found = _block(corpus, rows, doc_id, vector, n, query_type)
        out = found if out is None else out.unionByName(found)
    if out is None:
        doc_type = corpus.schema[doc_id].dataType.simpleString()
        return corpus.sparkSession.createDataFrame([], f"query_id {query_type}, {doc_id} {doc_type}, similarity double, rank int")
    w = Window.partitionBy("query_id").orderBy(F.col("similarity").desc(), doc_id)
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def context(hits: DataFrame, documents: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(query_id, context): '[Source i]: text' blocks in rank order (at most n texts per query)."""
    j = hits.join(documents.select(doc_id, F.col(text).alias("_t")), doc_id)
    items = F.array_sort(F.collect_list(F.struct("rank", "_t")))
    blocks = F.transform(items, lambda s: F.concat(F.lit("[Source "), s["rank"].cast("string"), F.lit("]: "), s["_t"]))
    return j.groupBy("query_id").agg(F.array_join(blocks, "\n\n").alias("context"))


def text_model(features: int = 1 << 14, text: str = "text") -> Pipeline:
    """Tokens -> hashed term frequencies -> inverse document frequency -> unit vectors."""
    return Pipeline(
        stages=[
            RegexTokenizer(inputCol=text, outputCol="_tokens", pattern=r"\W+", toLowercase=True),
            HashingTF(inputCol="_tokens", outputCol="_tf", numFeatures=features),
            IDF(inputCol="_tf", outputCol="_idf", minDocFreq=1),
            Normalizer(inputCol="_idf", outputCol="embedding_vector"),
        ]
    )


def embed(df: DataFrame, model: PipelineModel, as_array: bool = False) -> DataFrame:
    out = model.transform(df).drop("_tokens", "_tf", "_idf")
    return out.withColumn("embedding", vector_to_array("embedding_vector")).drop("embedding_vector") if as_array else out


def embed_sparse(df: DataFrame, model: PipelineModel) -> DataFrame:
    """``df`` with embedding: struct of the indices and values that are not zero."""
    v = F.unwrap_udt("embedding_vector")
    return embed(df, model).withColumn("embedding", F.struct(v["indices"].alias("indices"), v["values"].alias("values"))).drop("embedding_vector")


# --- starting corpus ----------------------------------------------------------------------------

# doc_id, category, content
SEED_DOCUMENTS = [
    ("velocity", "pattern", "Many transactions of one account within an hour often mean card testing or an automated attack."),
    ("takeover", "pattern", "A new device, a changed password and a large transfer in one session suggest account takeover."),
    ("synthetic", "pattern", "An application mixing real and invented identity details builds credit before it defaults at once."),
    ("mule", "pattern", "A mule account receives several deposits and forwards nearly all of the money within a day."),
    ("not-present", "pattern", "Purchases without the card concentrate on goods that are easy to resell and ship elsewhere."),
    ("geography", "pattern", "Two payments in places too far apart for the time between them cannot both be genuine."),
    ("amount", "indicator", "An amount many deviations above the account's usual spending deserves a second look."),
    ("night", "indicator", "Activity at night is weak evidence alone but raises the weight of other signs."),
    ("merchant", "indicator", "A merchant with a high historical fraud rate raises the risk of each of its payments."),
    ("review", "procedure", "Hold the payment, contact the customer over a known channel, and record the decision."),
    ("reporting", "regulation", "Suspicious transactions are reported within the legal deadline with their supporting evidence."),
]


def seed_documents(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        [(i, t, {"category": c}) for i, c, t in SEED_DOCUMENTS], "doc_id string, content string, metadata map<string,string>"
    )
