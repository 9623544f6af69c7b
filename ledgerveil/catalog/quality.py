"""Personal-data profiling, transformation and certification."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerveil.catalog.base import query, rounded
from ledgerveil.functions import binning, hashing, masking, pii
from ledgerveil.operators import audit, certify, profile, sketches, transform
from ledgerveil.plans.ranking import with_totals
from ledgerveil.session import durable_dir, materialize
from ledgerveil.sources.tables import table

_KEY = "demonstration-key"


def _values(expr: str) -> str:
    """SQL rows (ord, pii_type, pattern, n_match) of the value patterns over one text expression."""
    cols = [f"count(*) FILTER (regexp_matches({expr}, '{p.replace(chr(39), chr(39) * 2)}'))" for _, _, p in pii.value_pattern_list()]
    return ", ".join(f"{c} AS m{i}" for i, c in enumerate(cols))


def _unpivot(name: str, source: str) -> str:
    """SQL: one row per pattern for the counts of ``source`` (columns n, m0..)."""
    return " UNION ALL ".join(
        f"SELECT '{name}' AS column_name, {i} AS ord, '{t}' AS pii_type, '{p.replace(chr(39), chr(39) * 2)}' AS pattern, n AS n_values, m{i} AS n_match FROM {source}"
        for i, t, p in pii.value_pattern_list()
    )


_DOC_PROFILE = f"WITH d AS (SELECT count(text) AS n, {_values('text')} FROM documents), p AS ({_unpivot('text', 'd')})"


@query("value_profile_documents", f"{_DOC_PROFILE} SELECT * FROM p")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return profile.value_profile(table(spark, sf, "documents"), ["text"])


def _sql_case(key: str, mapping: dict[str, str], default: str) -> str:
    return f"CASE {key} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in mapping.items()) + f" ELSE '{default}' END"


_SENS = _sql_case("pii_type", pii.SENSITIVITY, "low")
_MATCHES = f"""SELECT column_name, pii_type, {_SENS} AS sensitivity, 'regex' AS detection_method,
  round(least(0.9::DOUBLE, 0.5::DOUBLE + n_match / n_values), 6) AS confidence, pattern AS pattern_matched,
  CASE WHEN {_SENS} = 'critical' THEN 'remove' ELSE 'transform' END AS recommendation, ord FROM p WHERE n_values > 0 AND n_match / n_values > 0.1"""


def contact_table(spark: SparkSession, sf: str) -> DataFrame:
    """customer with contact columns derived from its own values."""
    k = F.col("c_custkey")
    return table(spark, sf, "customer").select(
        "c_custkey",
        F.col("c_name").alias("customer_name"),
        F.concat(F.lit("user"), k.cast("string"), F.lit("@example.com")).alias("email"),
        F.concat(F.lit("555-01"), F.lpad((k % 100).cast("string"), 2, "0"), F.lit("-"), F.lpad((k % 10000).cast("string"), 4, "0")).alias("contact"),
        (k % 60 + 15).cast("int").alias("customer_age"),
        F.col("c_acctbal").alias("income"),
        F.lpad((k % 90000 + 10000).cast("string"), 5, "0").alias("zip"),
        F.date_format(F.date_add(F.lit("1950-01-01").cast("date"), (k * 13 % 18000).cast("int")), "dd/MM/yyyy").alias("birth_date"),
        F.concat(((k % 900) / 10).cast("string"), F.lit(","), (-(k % 1700) / 10).cast("string")).alias("gps"),
        "c_mktsegment",
    )


_CONTACT = """ct AS (SELECT c_custkey, c_name AS customer_name, 'user' || c_custkey || '@example.com' AS email,
  '555-01' || lpad((c_custkey % 100)::VARCHAR, 2, '0') || '-' || lpad((c_custkey % 10000)::VARCHAR, 4, '0') AS contact,
  (c_custkey % 60 + 15)::INT AS customer_age, c_acctbal AS income, lpad((c_custkey % 90000 + 10000)::VARCHAR, 5, '0') AS zip,
  strftime(DATE '1950-01-01' + (c_custkey * 13 % 18000)::INT, '%d/%m/%Y') AS birth_date,
  ((c_custkey % 900) / 10)::VARCHAR || ',' || (-(c_custkey % 1700) / 10)::VARCHAR AS gps, c_mktsegment FROM customer)"""

_TEXTS = ["customer_name", "email", "contact", "zip", "birth_date", "gps", "c_mktsegment"]


def _profile_ctes() -> str:
    ctes = ", ".join(f"d_{c} AS (SELECT count({c}) AS n, {_values(c)} FROM ct)" for c in _TEXTS)
    union = " UNION ALL ".join(_unpivot(c, f"d_{c}") for c in _TEXTS)
    return f"{_CONTACT}, {ctes}, p AS ({union})"


@query("value_matches", f"WITH {_profile_ctes()} {_MATCHES}")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(profile.value_matches(contact_table(spark, sf)))


def _detect_sql() -> str:
    names = []
    for c in ["c_custkey", *_TEXTS[:4], "customer_age", "income", *_TEXTS[4:]]:
        hit = profile.name_match(c)
        if hit:
            names.append(
                f"SELECT '{c}', '{hit[0]}', '{pii.SENSITIVITY[hit[0]]}', 'column_name', 0.8::DOUBLE, '{hit[1]}', '{pii.recommendation(hit[0])}', -1"
            )
    return f"""WITH {_profile_ctes()}, m AS ({_MATCHES} UNION ALL {' UNION ALL '.join(names)}),
      r AS (SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY confidence DESC, ord) AS rn FROM m)"""


DETECT_SQL = _detect_sql()


@query("detect_contacts", f"{DETECT_SQL} SELECT column_name, pii_type, sensitivity, detection_method, confidence, pattern_matched, recommendation FROM r WHERE rn = 1")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(profile.detect(contact_table(spark, sf)).drop("ord"))


@query(
    "detection_summary",
    f"""{DETECT_SQL} SELECT 10::BIGINT AS total_columns, count(*) AS columns_with_pii, bool_or(sensitivity = 'critical') AS critical_pii_found,
      bool_or(sensitivity IN ('critical', 'high')) AS high_pii_found, NOT bool_or(sensitivity IN ('critical', 'high')) AS passed FROM r WHERE rn = 1""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    c = contact_table(spark, sf)
    return profile.detection_summary(c, profile.detect(c))


@query(
    "detection_report",
    f"""{DETECT_SQL} SELECT sensitivity, column_name, '[' || rpad(upper(sensitivity), 8, ' ') || '] ' || rpad(column_name, 30, ' ') || ' | ' || rpad(pii_type, 15, ' ')
      || ' | conf=' || printf('%.2f', confidence) || ' | ' || recommendation AS line FROM r WHERE rn = 1""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return profile.detection_report(profile.detect(contact_table(spark, sf)))


@query(
    "transformation_plan",
    f"{DETECT_SQL} SELECT column_name, pii_type, {_sql_case('pii_type', pii.DEFAULT_TREATMENT, 'hash')} AS transformation FROM r WHERE rn = 1",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return transform.plan_table(profile.detect(contact_table(spark, sf)))


def _mask_sql(c: str) -> str:
    return f"CASE WHEN length({c}) <= 4 THEN repeat('*', length({c})) ELSE substr({c}, 1, 2) || repeat('*', length({c}) - 4) || right({c}, 2) END"


def _cut_sql(c: str, breaks: list, labels: list[str]) -> str:
    arms = " ".join(f"WHEN {c} <= {b} THEN '{x}'" for b, x in zip(breaks, labels))
    return f"CASE WHEN {c} IS NULL THEN NULL {arms} ELSE '{labels[-1]}' END"


_DECADE = "CASE WHEN birth_date IS NULL THEN NULL ELSE (floor((2026 - year(strptime(birth_date, '%d/%m/%Y'))) / 10) * 10)::BIGINT || 's' END"
_PLAN = {
    "customer_name": ("name", "hash"), "email": ("email", "hmac"), "contact": ("phone", "mask"), "customer_age": ("age", "generalize"),
    "income": ("income", "generalize"), "zip": ("zip_code", "generalize"), "birth_date": ("date_of_birth", "generalize"),
    "gps": ("gps_coordinates", "generalize"), "c_mktsegment": ("gender", "suppress"),
}


def _hmac_sql(c: str) -> str:
    inner, outer = hashing.hmac_pads(_KEY)
    return f"substr(sha256(from_hex('{outer.hex()}') || from_hex(sha256(from_hex('{inner.hex()}') || encode({c})))), 1, 16)"


@query(
    "apply_plan",
    f"""WITH {_CONTACT} SELECT c_custkey, substr(sha256(customer_name), 1, 16) AS customer_name, {_hmac_sql('email')} AS email, {_mask_sql('contact')} AS contact,
      {_cut_sql('customer_age', binning.AGE_BREAKS, binning.AGE_LABELS)} AS customer_age, {_cut_sql('income', binning.INCOME_BREAKS, binning.INCOME_LABELS)} AS income,
      substr(zip, 1, 3) || 'XX' AS zip, {_DECADE} AS birth_date, gps, NULL::VARCHAR AS c_mktsegment FROM ct""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return transform.apply_plan(contact_table(spark, sf), _PLAN, _KEY, as_of_year=2026)[0]


@query(
    "transformation_log",
    f"""WITH {_CONTACT} SELECT column_name, how AS transformation_type, dt AS original_dtype, n AS rows_transformed, t - n AS null_count, how <> 'bad' AND success AS success FROM (
      SELECT 'customer_name' AS column_name, 'hash' AS how, 'string' AS dt, count(customer_name) AS n, count(*) AS t, true AS success FROM ct
      UNION ALL SELECT 'contact', 'generalize', 'string', count(contact), count(*), false FROM ct
      UNION ALL SELECT 'income', 'noise', 'double', count(income), count(*), true FROM ct)""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    plan = {"customer_name": ("name", "hash"), "contact": ("age", "generalize"), "income": ("income", "noise")}
    return transform.apply_plan(contact_table(spark, sf), plan, _KEY)[1].drop("error_message")


@query("noise_column")
def _(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").select("c_custkey", "c_acctbal")
    return transform.apply_plan(c, {"c_acctbal": ("income", "noise")}, _KEY, seed=5)[0]


@query("tokenize_names")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select("c_custkey", masking.tokenize("c_name", _KEY).alias("token"))


@query(
    "scalar_treatments",
    f"""SELECT p_partkey, {_mask_sql('p_name')} AS masked, CASE WHEN length(p_brand) <= 3 THEN repeat('*', length(p_brand)) ELSE substr(p_brand, 1, 3) || repeat('*', length(p_brand) - 3) END AS logged,
      CASE WHEN length(p_type) > 4 THEN substr(p_type, 1, length(p_type) // 2) || '...' ELSE p_type END AS truncated, '[REDACTED]' AS redacted,
      substr(sha256(p_name), 1, 16) AS hashed, {_hmac_sql('p_name')} AS keyed,
      upper(substr(md5(p_brand), 1, 6)) AS tag, upper(substr(sha256('2026|gold|' || p_size), 1, 12)) AS certificate FROM part""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select(
        "p_partkey", masking.mask_middle("p_name").alias("masked"), masking.mask_for_log("p_brand").alias("logged"), masking.truncate_half("p_type").alias("truncated"),
        masking.redact().alias("redacted"), hashing.value_hash("p_name").alias("hashed"), hashing.keyed_hash("p_name", _KEY).alias("keyed"),
        hashing.feature_tag(F.col("p_brand")).alias("tag"), hashing.certificate_id(F.lit("2026"), F.lit("gold"), F.col("p_size")).alias("certificate"),
    )


@query(
    "generalised_values",
    """SELECT o_orderkey, CASE lower(o_orderpriority) WHEN '1-urgent' THEN 'fast' WHEN '2-high' THEN 'fast' WHEN '5-low' THEN 'slow' ELSE 'other' END AS pace,
      strftime(date_trunc('week', o_orderdate), '%Y-%m-%d') AS week, strftime(date_trunc('day', o_orderdate), '%Y-%m-%d') AS day FROM orders""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select(
        "o_orderkey", binning.to_group("o_orderpriority", {"1-URGENT": "fast", "2-HIGH": "fast", "5-LOW": "slow"}).alias("pace"),
        F.date_format(binning.coarse_time("o_orderdate", "week"), "yyyy-MM-dd").alias("week"),
        F.date_format(binning.coarse_time("o_orderdate", "day"), "yyyy-MM-dd").alias("day"),
    )


@query("location_roll_up", "SELECT c_custkey, r_name AS c_nationkey FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def _(spark: SparkSession, sf: str) -> DataFrame:
    """Nation of a customer replaced by its region."""
    places = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return transform.roll_up(table(spark, sf, "customer").select("c_custkey", "c_nationkey"), "c_nationkey", places.withColumnRenamed("n_nationkey", "c_nationkey"), "r_name")


@query(
    "quantile_buckets",
    """WITH q AS (SELECT quantile_cont(l_extendedprice, [0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9]) AS b FROM lineitem),
      c AS (SELECT len(list_filter(b, lambda x: x < l_extendedprice)) AS k FROM lineitem, q) SELECT 'bin_' || k AS bucket, count(*) AS n FROM c GROUP BY 1""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    """Deciles through the plan that generalises a numeric column."""
    line = table(spark, sf, "lineitem").select("l_extendedprice")
    out, _ = transform.apply_plan(line, {"l_extendedprice": ("financial", "generalize")}, _KEY)
    return out.groupBy(F.col("l_extendedprice").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query("pseudonym_map", "SELECT c_name AS value, 'PSEUDO_C_NAME_' || printf('%06d', row_number() OVER (ORDER BY md5('42:' || c_name), c_name) - 1) AS pseudonym FROM (SELECT DISTINCT c_name FROM customer)")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return transform.pseudonym_map(table(spark, sf, "customer"), "c_name")


@query(
    "pseudonym_extension",
    """WITH old AS (SELECT p_brand AS value, row_number() OVER (ORDER BY md5('42:' || p_brand), p_brand) - 1 AS n FROM (SELECT DISTINCT p_brand FROM part WHERE p_size <= 2)),
      new AS (SELECT DISTINCT p_brand AS value FROM part WHERE p_brand NOT IN (SELECT value FROM old)),
      u AS (SELECT value, n FROM old UNION ALL SELECT value, row_number() OVER (ORDER BY md5('42:' || value), value) - 1 + (SELECT count(*) FROM old) FROM new)
    SELECT p_partkey, 'PSEUDO_P_BRAND_' || printf('%06d', n) AS p_brand FROM part JOIN u ON p_brand = value""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part").select("p_partkey", "p_brand", "p_size")
    stored = transform.pseudonym_map(part.where("p_size <= 2"), "p_brand")
    mapping = transform.pseudonym_map(part, "p_brand", stored)
    return transform.apply_plan(part.drop("p_size"), {"p_brand": ("name", "pseudonymize")}, _KEY, pseudonyms={"p_brand": mapping})[0]


# --- uniqueness, anonymity, entropy, certificate ----------------------------------------------------

_ORDER_COLS = [("o_orderkey", 0), ("o_custkey", 0), ("o_orderstatus", 1), ("o_totalprice", 0), ("o_orderpriority", 1)]


def _unique_sql(tab: str, cols: list[tuple[str, int]]) -> str:
    parts = []
    for c, text in cols:
        u = f"(SELECT count(*) FROM (SELECT DISTINCT {c} FROM {tab}))"
        k = f"(SELECT min(m) FROM (SELECT count(*) AS m FROM {tab} GROUP BY {c}))" if text else f"greatest(1, floor((SELECT count(*) FROM {tab}) / {u}))::BIGINT"
        parts.append(f"SELECT '{c}' AS column_name, {u} AS unique_count, (SELECT count(*) FROM {tab}) AS total_count, {k} AS k_anonymity_estimate")
    return " UNION ALL ".join(parts)


_UNIQ = """SELECT column_name, unique_count, total_count, round(unique_count / total_count, 8) AS unique_ratio, k_anonymity_estimate,
  unique_count / total_count > 0.95 OR k_anonymity_estimate < 5 AS is_quasi_identifier FROM u"""


@query("column_uniqueness", f"WITH u AS ({_unique_sql('orders', _ORDER_COLS)}) {_UNIQ}")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(profile.uniqueness(table(spark, sf, "orders").select(*[c for c, _ in _ORDER_COLS])), 8)


_SKETCHED = ["l_orderkey", "l_partkey", "l_quantity", "l_extendedprice", "l_returnflag", "l_linestatus"]


def _sketched(spark: SparkSession, sf: str) -> tuple[DataFrame, sketches.SketchStore]:
    """(line items, their sketches by year of shipping and for lines without a date)."""
    line = table(spark, sf, "lineitem").select(*_SKETCHED, F.year("l_shipdate").alias("y"))
    store = sketches.SketchStore(spark, durable_dir(spark, "sketches"))
    years = [r["y"] for r in line.select("y").distinct().collect()]  # one name a partition
    for y in years:
        store.add(line.where(F.col("y").eqNullSafe(y)).drop("y"), str(y))
    return line.drop("y"), store


@query("sketched_uniqueness", "SELECT unnest(['l_orderkey', 'l_partkey', 'l_quantity', 'l_extendedprice', 'l_returnflag', 'l_linestatus']) AS column_name, count(*) AS total_count, true AS within_error FROM lineitem")
def _(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct counts from sketches of partitions, merged, against the exact profile."""
    line, store = _sketched(spark, sf)
    exact = profile.uniqueness(line).select("column_name", "total_count", "unique_count")
    merged = store.distinct().select("column_name", "n_distinct", "error")
    close = F.abs(F.col("n_distinct") - F.col("unique_count")) <= F.greatest(F.col("error") * F.col("unique_count"), F.lit(0.5))
    return exact.join(merged, "column_name").select("column_name", "total_count", close.alias("within_error"))


@query("sketched_quantiles", "SELECT column_name, probability, true AS within_error FROM (SELECT unnest(['l_quantity', 'l_extendedprice']) AS column_name), (SELECT unnest([0.1, 0.25, 0.5, 0.9, 0.99]) AS probability)")
def _(spark: SparkSession, sf: str) -> DataFrame:
    """Quantiles from merged sketches: the ranks of the answers in the whole table against the asked ones."""
    line, store = _sketched(spark, sf)
    found = store.quantiles([0.1, 0.25, 0.5, 0.9, 0.99]).where(F.col("column_name").isin("l_quantity", "l_extendedprice"))
    long = line.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("double").alias("v")) for c in ("l_quantity", "l_extendedprice")])).alias("c")).select("c.*")
    met = long.join(F.broadcast(found), "column_name").groupBy("column_name", "probability").agg(
        F.avg((F.col("v") < F.col("value")).cast("int")).alias("below"), F.avg((F.col("v") <= F.col("value")).cast("int")).alias("until"), F.max("rank_error").alias("error")
    )
    inside = (F.col("probability") >= F.col("below") - F.col("error")) & (F.col("probability") <= F.col("until") + F.col("error"))
    return met.select("column_name", "probability", inside.alias("within_error"))


@query("k_anonymity", "SELECT min(n) >= 5 AS passed, min(n) AS actual_k FROM (SELECT count(*) AS n FROM customer GROUP BY c_nationkey, c_mktsegment)")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return profile.k_anonymity(table(spark, sf, "customer"), ["c_nationkey", "c_mktsegment"])


@query(
    "violating_classes",
    "SELECT c_nationkey, c_mktsegment, b, count(*) AS group_size FROM (SELECT *, round(c_acctbal / 1000, 0) AS b FROM customer) GROUP BY ALL HAVING count(*) < 5",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").withColumn("b", F.round(F.col("c_acctbal") / 1000, 0))
    return profile.violating_classes(c, ["c_nationkey", "c_mktsegment", "b"])


@query(
    "reidentification_risk",
    """WITH c AS (SELECT l_suppkey, l_returnflag, count(*) AS size, count(DISTINCT l_quantity) AS l FROM lineitem GROUP BY 1, 2)
      SELECT count(*) AS n_classes, min(size) AS k_min, min(l) AS l_diversity, round(1 / min(size), 8) AS risk, 1 / min(size) >= 0.05 AS blocked FROM c""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(profile.reidentification_risk(table(spark, sf, "lineitem"), ["l_suppkey", "l_returnflag"], "l_quantity"), 8)


def _entropy_sql(tab: str, cols: list[str]) -> str:
    parts = []
    for c in cols:
        parts.append(
            f"""SELECT '{c}' AS column_name, h.entropy, h.k, r.unique_ratio FROM (SELECT log2(sum(m)) - sum(m * log2(m)) / sum(m) AS entropy, count(*) AS k FROM
            (SELECT ch, count(*) AS m FROM (SELECT unnest(string_split({c}, '')) AS ch FROM {tab}) WHERE ch <> '' GROUP BY ch)) h,
            (SELECT count(DISTINCT {c}) / count({c}) AS unique_ratio FROM {tab}) r"""
        )
    return " UNION ALL ".join(parts)


_ENT = """SELECT column_name, round(entropy, 6) AS entropy, round(least(entropy / CASE WHEN k > 1 THEN log2(k) ELSE 1 END, 1), 6) AS normalized_entropy,
  round(unique_ratio, 8) AS unique_ratio, entropy > 4 AND unique_ratio > 0.5 AS is_high_entropy, 4.0::DOUBLE AS threshold_used FROM e"""


@query("character_entropy", f"WITH e AS ({_entropy_sql('documents', ['text', 'lang', 'source'])}) {_ENT}")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(rounded(profile.character_entropy(table(spark, sf, "documents")), 8, ["unique_ratio"]), 6, ["entropy", "normalized_entropy"])


_CERT_TABLE = "ctab AS (SELECT substr(sha256(c_name), 1, 16) AS id_hash, c_nationkey, c_mktsegment FROM customer)"


#: The certificate of customers' hashed names, nations and segments in SQL.
_CERTIFIED = f"""WITH {_CERT_TABLE}, u AS ({_unique_sql('ctab', [('id_hash', 1), ('c_nationkey', 0), ('c_mktsegment', 1)])}), q AS ({_UNIQ}),
      e AS ({_entropy_sql('ctab', ['id_hash', 'c_mktsegment'])}), h AS ({_ENT}),
      d0 AS (SELECT count(id_hash) AS n, {_values('id_hash')} FROM ctab), d1 AS (SELECT count(c_mktsegment) AS n, {_values('c_mktsegment')} FROM ctab),
      p AS ({_unpivot('id_hash', 'd0')} UNION ALL {_unpivot('c_mktsegment', 'd1')}), m AS ({_MATCHES}),
      g AS (SELECT true AS g1, (SELECT coalesce(NOT bool_or(sensitivity IN ('critical', 'high')), true) FROM m) AS g2,
        (SELECT NOT bool_or(is_quasi_identifier) FROM q) AS g3, (SELECT NOT bool_or(is_high_entropy) FROM h) AS g4,
        (SELECT count(DISTINCT column_name) FROM m) AS f)
    SELECT CASE WHEN g1::INT + g2::INT + g3::INT + g4::INT = 4 THEN 'gold' WHEN g1::INT + g2::INT + g3::INT + g4::INT = 3 THEN 'silver'
        WHEN g1::INT + g2::INT + g3::INT + g4::INT = 2 THEN 'bronze' ELSE 'failed' END AS certification_level,
      (g1::INT + g2::INT + g3::INT + g4::INT + 1) / 5.0::DOUBLE * 100 AS certification_score, g1 AS gate1_passed, g2 AS gate2_passed, g3 AS gate3_passed,
      g4 AS gate4_passed, true AS gate5_passed, 3::BIGINT AS total_columns, 3 - f AS safe_columns, f AS transformed_columns FROM g"""


def _certified_table(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select(hashing.value_hash("c_name").alias("id_hash"), "c_nationkey", "c_mktsegment")


@query("certify_customers", _CERTIFIED)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return certify.certify(_certified_table(spark, sf)).select(
        "certification_level", "certification_score", *[f"gate{i}_passed" for i in range(1, 6)], "total_columns", "safe_columns", "transformed_columns"
    )


@query("certify_full_run")
def _(spark: SparkSession, sf: str) -> DataFrame:
    _, certificate, events = certify.full_run(contact_table(spark, sf), "contacts", _KEY, "2026-01-01T00:00:00")
    shown = certificate.select("certification_level", "certification_score", "total_columns", "transformed_columns")
    return with_totals(shown, events.agg(F.count(F.lit(1)).alias("audit_events")), [])


@query(
    "run_events",
    f"""{DETECT_SQL}, b AS (SELECT * FROM r WHERE rn = 1), n AS (SELECT count(*) AS k FROM b)
      SELECT event_type, resource, n FROM (
        SELECT 'pii_detected' AS event_type, column_name AS resource, count(*) AS n FROM b GROUP BY ALL
        UNION ALL SELECT unnest(['pii_scan_started', 'pii_scan_completed', 'transformation_started', 'transformation_completed', 'certification_requested']), 'contacts', 1
        UNION ALL SELECT 'data_export', 'contacts', 1 UNION ALL SELECT 'chain issues', 'contacts', 0)""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    """Kinds of audit events of a whole run with its export, and the issues of their chain; the verdict itself is left out."""
    df = contact_table(spark, sf)
    clean, log, matches = certify.sanitise(df, _KEY)
    place, certificate, _ = certify.release_certified(clean, durable_dir(spark, "release"), "2026-01-01T00:00:00")
    exports = clean.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(place).alias("destination"), F.lit("parquet").alias("format"), "n_rows")
    events = materialize(certify.run_events(df, "contacts", matches, log, certificate, "2026-01-01T00:00:00", exports=exports), "events")
    counts = events.where(~F.col("event_type").isin("certification_granted", "certification_denied", "error")).groupBy("event_type", "resource").agg(F.count(F.lit(1)).alias("n"))
    issues = audit.verify(events).agg(F.lit("chain issues").alias("event_type"), F.lit("contacts").alias("resource"), F.count(F.lit(1)).alias("n"))
    return counts.unionByName(issues)


@query(
    "certificate_text",
    f"""WITH x AS ({_CERTIFIED}), t AS (SELECT *, upper(substr(sha256('2026-01-01T00:00:00|' || certification_level || '|' || total_columns), 1, 12)) AS certificate_id FROM x)
      SELECT certificate_id, concat_ws(chr(10), 'Certificate ' || certificate_id, 'Issued 2026-01-01T00:00:00',
        'Status ' || CASE WHEN certification_level <> 'failed' THEN 'certified, level ' || certification_level ELSE 'not certified' END, 'Score ' || round(certification_score)::INT || '/100',
        'Gate 1 (column names): ' || CASE WHEN gate1_passed THEN 'pass' ELSE 'FAIL' END, 'Gate 2 (value patterns): ' || CASE WHEN gate2_passed THEN 'pass' ELSE 'FAIL' END,
        'Gate 3 (uniqueness): ' || CASE WHEN gate3_passed THEN 'pass' ELSE 'FAIL' END, 'Gate 4 (entropy): ' || CASE WHEN gate4_passed THEN 'pass' ELSE 'FAIL' END, 'Gate 5 (learned detector): pass',
        'Columns ' || total_columns || ', safe ' || safe_columns || ', transformed ' || transformed_columns) AS certificate FROM t""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return certify.certificate_text(certify.certify(_certified_table(spark, sf)), "2026-01-01T00:00:00")


@query("certificate_advice")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return certify.advice(certify.certify(table(spark, sf, "orders")))


@query("guarded_release")
def _(spark: SparkSession, sf: str) -> DataFrame:
    """The table lands under certified/ or quarantine/; its stored certificate is read back."""
    c = table(spark, sf, "customer").select("c_nationkey", "c_mktsegment")
    place = certify.release(c, certify.certify(c), durable_dir(spark, "release"), "2026-01-01T00:00:00")
    return spark.read.json(f"{place}/certificate").select("certification_level", "certified", "schema_hash")


# --- audit ---------------------------------------------------------------------------------------------


def audit_events(spark: SparkSession, sf: str) -> DataFrame:
    """events as audit events: one session per user."""
    kinds = F.element_at(F.array(*[F.lit(k) for k in audit.EVENT_TYPES]), (F.col("event_id") % 12 + 1).cast("int"))
    e = table(spark, sf, "events").select(
        F.concat(F.lit("S"), F.col("user_id").cast("string")).alias("session_id"), "event_id",
        kinds.alias("event_type"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), F.lit("system").alias("actor"),
        F.concat(F.lit("dataset-"), (F.col("event_id") % 9).cast("string")).alias("resource"), F.col("event_type").alias("action"), F.col("props").alias("details"),
    )
    return audit.number_within_session(e, "event_id").drop("event_id")


_AUD = """a AS (SELECT 'S' || user_id AS session_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS seq,
  ['pii_scan_started','pii_scan_completed','pii_detected','transformation_started','transformation_completed','certification_requested','certification_granted','certification_denied','data_access','data_export','configuration_change','error'][(event_id % 12 + 1)::INT] AS event_type,
  strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, 'system' AS actor, 'dataset-' || (event_id % 9) AS resource, event_type AS action, props AS details FROM events),
b AS (SELECT *, session_id || '-' || lpad(seq::VARCHAR, 5, '0') AS event_id FROM a),
c AS (SELECT *, to_json([event_id, event_type, ts, actor, resource, action, details])::VARCHAR AS body FROM b),
h AS (SELECT session_id, seq, NULL::VARCHAR AS previous_hash, substr(sha256(body || '|None'), 1, 16) AS event_hash FROM c WHERE seq = 1
  UNION ALL SELECT c.session_id, c.seq, h.event_hash, substr(sha256(c.body || '|' || h.event_hash), 1, 16) FROM h JOIN c ON c.session_id = h.session_id AND c.seq = h.seq + 1)"""


@query("audit_chain", f"WITH RECURSIVE {_AUD} SELECT session_id, seq, previous_hash, event_hash FROM h")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return audit.link(audit_events(spark, sf)).select("session_id", "seq", "previous_hash", "event_hash")


@query(
    "audit_verify",
    f"""WITH {_AUD.split('h AS (')[0].rstrip().rstrip(',')}
    SELECT event_id, 'hash mismatch' AS issue FROM c WHERE seq % 50 = 0
    UNION ALL SELECT event_id, 'chain broken' FROM c WHERE seq % 70 = 2 AND seq > 2""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    """After linking, some actions are edited and some events lose their predecessor."""
    linked = audit.link(audit_events(spark, sf)).where(~((F.col("seq") % 70 == 1) & (F.col("seq") > 1)))
    edited = F.when(F.col("seq") % 50 == 0, F.lit("edited")).otherwise(F.col("action"))
    return audit.verify(linked.withColumn("action", edited)).select("event_id", "issue")


@query("audit_counts", f"WITH {_AUD.split('h AS (')[0].rstrip().rstrip(',')} SELECT event_type, count(*) AS n FROM c GROUP BY 1")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return audit.counts_by_type(audit_events(spark, sf))


@query("audit_filter", f"WITH {_AUD.split('h AS (')[0].rstrip().rstrip(',')} SELECT session_id, seq, action FROM c WHERE event_type = 'data_export' AND resource = 'dataset-3'")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return audit.events_on(audit.events_of_type(audit_events(spark, sf), "data_export"), "dataset-3").select("session_id", "seq", "action")


@query(
    "audit_report",
    f"""WITH {_AUD.split('h AS (')[0].rstrip().rstrip(',')}
      SELECT 0 AS part, '' AS k1, 0::BIGINT AS k2, 'Audit chain integrity: VERIFIED' AS line
      UNION ALL SELECT 1, event_type, 0, event_type || ': ' || count(*) || ' events' FROM c GROUP BY event_type
      UNION ALL SELECT 2, session_id, seq, concat_ws(' | ', ts, event_type, resource, action, actor) FROM c""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return audit.compliance_lines(audit.link(audit_events(spark, sf)))
