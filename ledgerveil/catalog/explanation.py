"""Explanations of predictions and document retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerveil.catalog.base import query, rounded
from ledgerveil.functions import scoring
from ledgerveil.operators import cells, explain, retrieval
from ledgerveil.sources.tables import table

# --- predictions over orders ----------------------------------------------------------------------


def _predictions(spark: SparkSession, sf: str) -> DataFrame:
    """orders as scored transactions with a map of feature values (two decimals each)."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    values = {
        "amount_zscore": (k % 700) / 100 - 2, "velocity_1h": (c % 7).cast("double"), "distance_from_home": (k % 300).cast("double"),
        "is_night": (k % 2).cast("double"), "merchant_fraud_rate": (c % 30) / 100, "trans_hour": (k % 24).cast("double"), "balance_gap": (c % 50) / 10 - 2.5,
    }
    pairs = [x for n, v in values.items() for x in (F.lit(n), v)]
    return table(spark, sf, "orders").select(k.alias("tx"), ((k * 37 % 1000) / 1000).alias("p"), F.create_map(*pairs).alias("v"))


_PRED = """pd AS (SELECT o_orderkey AS tx, (o_orderkey * 37 % 1000) / 1000 AS p, (o_orderkey % 700) / 100 - 2 AS amount_zscore, (o_custkey % 7)::DOUBLE AS velocity_1h, (o_orderkey % 300)::DOUBLE AS distance_from_home,
  (o_orderkey % 2)::DOUBLE AS is_night, (o_custkey % 30) / 100 AS merchant_fraud_rate, (o_orderkey % 24)::DOUBLE AS trans_hour, (o_custkey % 50) / 10 - 2.5::DOUBLE AS balance_gap FROM orders),
tg AS (SELECT tx, p, list_filter([CASE WHEN amount_zscore > 2 THEN 'Unusually high transaction amount' END, CASE WHEN velocity_1h > 3 THEN 'High transaction velocity in short period' END,
    CASE WHEN distance_from_home > 100 THEN 'Transaction far from usual location' END, CASE WHEN is_night > 0.5 THEN 'Unusual transaction time (nighttime)' END, CASE WHEN merchant_fraud_rate > 0.1::DOUBLE THEN 'High-risk merchant' END], lambda x: x IS NOT NULL) AS hits,
    greatest(0.5::DOUBLE, CASE WHEN amount_zscore > 2 THEN 0.7 END, CASE WHEN velocity_1h > 3 THEN 0.75 END, CASE WHEN distance_from_home > 100 THEN 0.6 END, CASE WHEN is_night > 0.5 THEN 0.55 END, CASE WHEN merchant_fraud_rate > 0.1::DOUBLE THEN 0.65 END) AS hc FROM pd),
ex AS (SELECT tx, p, CASE WHEN p >= 0.9 THEN 'critical' WHEN p >= 0.7 THEN 'high' WHEN p >= 0.5 THEN 'medium' ELSE 'low' END AS risk_level, CASE WHEN len(hits) > 0 THEN hits ELSE ['No clear fraud pattern detected'] END AS tags,
    CASE WHEN len(hits) > 0 THEN hc ELSE 0.3::DOUBLE END AS tc FROM tg)"""


@query("risk_levels", f"WITH {_PRED} SELECT risk_level, count(*) AS n FROM ex GROUP BY 1")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return _predictions(spark, sf).groupBy(scoring.risk_level(F.col("p")).alias("risk_level")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "explain_predictions",
    f"""WITH {_PRED} SELECT tx AS transaction_id, p >= 0.5 AS is_fraud, risk_level, array_to_string(tags, '; ') AS patterns,
      upper(risk_level[1]) || risk_level[2:] || ' risk (' || printf('%.1f', p * 100) || '% probability) due to ' || lower(tags[1]) || '.' AS brief,
      round(greatest(0, least(1, 0.4::DOUBLE * (1 - 4::DOUBLE * (p - 0.5::DOUBLE) ** 2) + 0.3::DOUBLE + 0.3::DOUBLE * tc)), 3) AS confidence FROM ex""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    e = explain.explain(_predictions(spark, sf), "tx", "p", "v")
    return e.select("transaction_id", "is_fraud", "risk_level", F.array_join("patterns", "; ").alias("patterns"), "brief", "confidence")


@query(
    "recommended_actions",
    f"""WITH {_PRED}, ac AS (SELECT tx, list_sort(list_distinct(list_concat(
        CASE WHEN risk_level IN ('critical', 'high') THEN ['Temporarily hold the transaction', 'Request additional customer verification', 'Alert fraud investigation team']
          WHEN risk_level = 'medium' THEN ['Send SMS/email verification to cardholder', 'Log for periodic review'] ELSE ['Process normally with standard monitoring'] END,
        list_filter([CASE WHEN list_contains(tags, 'High transaction velocity in short period') THEN 'Review recent transaction history' END,
          CASE WHEN list_contains(tags, 'Transaction far from usual location') THEN 'Verify customer location' END, CASE WHEN list_contains(tags, 'High-risk merchant') THEN 'Flag merchant for review' END], lambda x: x IS NOT NULL)))) AS a FROM ex)
      SELECT tx AS transaction_id, array_to_string(a, '; ') AS actions FROM ac""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    e = explain.explain(_predictions(spark, sf), "tx", "p", "v")
    return e.select("transaction_id", F.array_join("actions", "; ").alias("actions"))


_W = "CASE feature_name " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in scoring.IMPORTANCE_WEIGHTS.items()) + " ELSE 0.03::DOUBLE END"
_RANKED = f"""{_PRED}, un AS (UNPIVOT pd ON amount_zscore, velocity_1h, distance_from_home, is_night, merchant_fraud_rate, trans_hour, balance_gap INTO NAME feature_name VALUE value),
  sc AS (SELECT tx, feature_name, value, {_W} * greatest(-10, least(10, value)) AS s FROM un),
  rf AS (SELECT tx AS transaction_id, feature_name, value, abs(s) AS contribution, CASE WHEN s > 0 THEN 'increases' ELSE 'decreases' END AS direction, row_number() OVER (PARTITION BY tx ORDER BY abs(s) DESC, feature_name) AS importance_rank FROM sc)"""


@query("feature_ranks", f"WITH {_RANKED} SELECT transaction_id, feature_name, round(value, 6) AS value, round(contribution, 6) AS contribution, direction, importance_rank::INT AS importance_rank FROM rf WHERE importance_rank <= 5")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(explain.feature_rows(explain.explain(_predictions(spark, sf), "tx", "p", "v")))


_TXT = "CASE feature_name " + " ".join(f"WHEN '{k}' THEN '{v.replace(chr(39), chr(39) * 2)}'" for k, v in scoring.FEATURE_TEXT.items()) + " ELSE replace(feature_name, '_', ' ') END"


@query("feature_summaries", f"WITH {_RANKED} SELECT transaction_id, string_agg({_TXT} || ' (' || printf('%.2f', value) || ') ' || direction || ' risk', '; ' ORDER BY importance_rank) AS summary FROM rf WHERE importance_rank <= 3 GROUP BY 1")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return explain.explain(_predictions(spark, sf), "tx", "p", "v").select("transaction_id", "summary")


@query("detailed_explanations")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return explain.explain(_predictions(spark, sf), "tx", "p", "v").select("transaction_id", "detail")


@query(
    "linear_contributions",
    """WITH c AS (SELECT l_orderkey, l_linenumber, l_partkey, unnest(['l_quantity', 'l_discount', 'l_tax']) AS feature_name, unnest([l_quantity * 0.02::DOUBLE, l_discount * -4.0::DOUBLE, l_tax * 1.5::DOUBLE]) AS v FROM lineitem)
      SELECT feature_name, round(sum(abs(v)), 4) AS total, count(*) FILTER (v > 0) AS n_positive FROM c GROUP BY 1""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    m = explain.linear_contributions(["l_quantity", "l_discount", "l_tax"], [0.02, -4.0, 1.5])
    long = table(spark, sf, "lineitem").select(F.explode(m).alias("feature_name", "v"))
    return long.groupBy("feature_name").agg(F.round(F.sum(F.abs("v")), 4).alias("total"), F.count_if(F.col("v") > 0).alias("n_positive"))


# --- retrieval ----------------------------------------------------------------------------------------


def _centroids(spark: SparkSession, sf: str) -> DataFrame:
    """One query per label: the mean vector of the label's embeddings."""
    e = table(spark, sf, "embeddings").select("label", F.posexplode("embedding").alias("i", "w"))
    m = e.groupBy("label", "i").agg(F.avg(F.col("w").cast("double")).alias("w"))
    return m.groupBy(F.col("label").alias("query_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "w"))), lambda s: s["w"]).alias("vector"))


_COS = """ce AS (SELECT vec_id, label, i, embedding[i]::DOUBLE AS w FROM (SELECT *, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)),
  qv AS (SELECT label AS query_id, i, avg(w) AS w FROM ce GROUP BY 1, 2), qn AS (SELECT query_id, sqrt(sum(w * w)) AS n FROM qv GROUP BY 1), dn AS (SELECT vec_id, label, sqrt(sum(w * w)) AS n FROM ce GROUP BY 1, 2),
  dt AS (SELECT qv.query_id, ce.vec_id, sum(qv.w * ce.w) AS d FROM ce JOIN qv ON ce.i = qv.i GROUP BY 1, 2),
  si AS (SELECT dt.query_id, dt.vec_id, label, d / (qn.n * dn.n) AS similarity FROM dt JOIN qn ON dt.query_id = qn.query_id JOIN dn ON dt.vec_id = dn.vec_id)"""


@query(
    "nearest_documents",
    f"""WITH {_COS}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS rank FROM si) SELECT query_id, vec_id, round(similarity, 6) AS similarity, rank::INT AS rank FROM r WHERE rank <= 5""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(retrieval.nearest(table(spark, sf, "embeddings"), _centroids(spark, sf), "vec_id", "embedding", 5))


@query(
    "nearest_documents_filtered",
    f"""WITH {_COS}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS rank FROM si WHERE label = 3) SELECT query_id, vec_id, round(similarity, 6) AS similarity, rank::INT AS rank FROM r WHERE rank <= 3""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    """Equality filter on metadata, applied at the scan."""
    corpus = table(spark, sf, "embeddings").where(F.col("label") == 3)
    return rounded(retrieval.nearest(corpus, _centroids(spark, sf), "vec_id", "embedding", 3))


_NEAREST_SQL = f"""WITH {_COS}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS rank FROM si) SELECT query_id, vec_id, round(similarity, 6) AS similarity, rank::INT AS rank FROM r WHERE rank <= 5"""


@query("indexed_documents", _NEAREST_SQL)
def _(spark: SparkSession, sf: str) -> DataFrame:
    """The exact nearest documents through an inverted-file index of all vectors."""
    index = cells.build(table(spark, sf, "embeddings"), "vec_id", "embedding")
    return rounded(cells.search(index, _centroids(spark, sf), "vec_id", "embedding", 5)[0])


@query(
    "indexed_documents_filtered",
    f"""WITH {_COS}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS rank FROM si WHERE label = 3) SELECT query_id, vec_id, round(similarity, 6) AS similarity, rank::INT AS rank FROM r WHERE rank <= 3""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    """An equality filter on stored metadata, applied to the opened cells."""
    index = cells.build(table(spark, sf, "embeddings"), "vec_id", "embedding")
    return rounded(cells.search(index, _centroids(spark, sf), "vec_id", "embedding", 3, F.col("label") == 3)[0])


@query("indexed_after_append", _NEAREST_SQL)
def _(spark: SparkSession, sf: str) -> DataFrame:
    """An index of the documents with even ids, to which the others are added."""
    e = table(spark, sf, "embeddings")
    index = cells.build(e.where("vec_id % 2 = 0"), "vec_id", "embedding")
    index = cells.append(index, e.where("vec_id % 2 <> 0"), "vec_id", "embedding")
    return rounded(cells.search(index, _centroids(spark, sf), "vec_id", "embedding", 5)[0])


@query(
    "retrieval_context",
    f"""WITH {_COS}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS rank FROM si)
      SELECT query_id, string_agg('[Source ' || rank || ']: ' || text, chr(10) || chr(10) ORDER BY rank) AS context FROM r JOIN documents ON doc_id = vec_id WHERE rank <= 3 GROUP BY 1""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    hits = retrieval.nearest(table(spark, sf, "embeddings"), _centroids(spark, sf), "vec_id", "embedding", 3).withColumnRenamed("vec_id", "doc_id")
    return retrieval.context(hits, table(spark, sf, "documents"), "doc_id", "text")


@query("text_retrieval")
def _(spark: SparkSession, sf: str) -> DataFrame:
    """Benchmark passages against the documents by sparse hashed tf-idf vectors, five for each passage."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    model = retrieval.text_model(retrieval.SPARSE_FEATURES).fit(docs)
    corpus = retrieval.embed_sparse(docs, model).select("doc_id", "embedding")
    asked = retrieval.embed_sparse(table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text"), model)
    return retrieval.nearest(corpus, asked.select("query_id", F.col("embedding").alias("vector")), "doc_id", "embedding")


@query(
    "document_upsert",
    """SELECT doc_id, text, lang FROM documents WHERE doc_id % 3 <> 0 OR doc_id % 2 = 1 UNION ALL SELECT doc_id, upper(lang) AS text, 'new' FROM documents WHERE doc_id % 3 = 0 AND doc_id % 2 = 0""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", "text", "lang")
    new = d.where("doc_id % 6 = 0").select("doc_id", F.upper("lang").alias("text"), F.lit("new").alias("lang"))
    return retrieval.upsert_documents(d, new)
