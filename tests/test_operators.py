"""Operator behaviour on small hand-made tables."""

import hashlib
import hmac
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerveil.functions import binning, hashing, masking, noise, scoring, vectors
from ledgerveil.operators import (
    alerts, audit, central, certify, evaluate, explain, forest, ledger, library, mining, models, privacy, profile, reports, retrieval, robust, split,
    transform, validate,
)
from ledgerveil.sources import fraud, tables, uploads

AS_OF = "2026-01-01 00:00:00"


def when():
    return F.lit(AS_OF).cast("timestamp")


@pytest.fixture(scope="module")
def people(spark):
    rows = [("Ada Byron", "ada@example.org", "555-123-4567", 36, 120.5, False), ("Alan T", "alan@example.org", "555-987-6543", 41, 80.0, True),
            ("Grace H", "grace@example.org", "555-222-3333", 79, 42.0, False)]
    return spark.createDataFrame(rows, "customer_name string, email string, phone_number string, customer_age bigint, amount double, is_fraud boolean")


# --- detection, transformation, certification ----------------------------------------------------


def test_detects_contact_columns(people):
    got = {r["column_name"]: r["pii_type"] for r in profile.detect(people).collect()}
    assert got["customer_name"] == "name" and got["email"] == "email" and got["phone_number"] == "phone" and got["customer_age"] == "age"
    assert not profile.detection_summary(people, profile.detect(people)).first()["passed"]


def test_safe_table_has_no_severe_match(spark):
    df = spark.createDataFrame([("a1", 1.0, 3, True), ("b2", 2.0, 4, False)], "transaction_id_hash string, amount double, velocity_24h bigint, is_fraud boolean")
    assert profile.detect(df).where("sensitivity in ('critical', 'high')").count() == 0
    assert profile.detection_summary(df, profile.detect(df)).first()["passed"]


def test_noised_release_is_the_certified_copy(spark, tmp_path):
    """Noise is drawn once: what is written is what was certified, whatever is done to the lazy table in between."""
    df = spark.range(500).select((F.col("id") % 9).alias("group"), (F.col("id") % 50).cast("double").alias("income"))
    noised, _ = transform.apply_plan(df, {"income": ("income", "noise")}, "k")
    place, certificate, copy = certify.release_certified(noised.repartition(3), str(tmp_path), "2026-01-01T00:00:00")
    released = sorted(map(tuple, spark.read.parquet(f"{place}/data").collect()))
    assert released == sorted(map(tuple, copy.collect())) and len(released) == 500
    assert certificate.first() == certify.certify(copy).first()
    clean, _, _ = certify.sanitise(df, "k", overrides={"income": "noise"})
    assert sorted(map(tuple, clean.collect())) == sorted(map(tuple, clean.repartition(3).collect()))


def test_every_audit_constructor(spark):
    one = spark.createDataFrame([("analyst", "review", "s3", "parquet", 5, "t", "io", "disk full")], "accessor string, purpose string, destination string, format string, n_rows long, resource string, error_type string, message string")
    events = audit.chained([audit.failed(one), audit.exported(one, "t"), audit.accessed(one, "t")], "S", "2026-01-01")
    rows = events.orderBy("seq").collect()
    assert [r["event_type"] for r in rows] == ["data_access", "data_export", "error"] and audit.verify(events).count() == 0
    more = audit.chained([audit.accessed(one, "t")], "S", "2026-01-02", heads=audit.latest_heads(events))
    assert more.first()["previous_hash"] == rows[-1]["event_hash"]


def test_report_lists_are_detail_rows(spark):
    rows = spark.range(300).select(F.col("id").cast("string").alias("alert_id"), (F.col("id") % 7 / 7).alias("weight"))
    got = reports.details("R", {2: (rows, [-F.col("weight"), F.col("alert_id")]), 5: (rows.limit(0), [F.col("alert_id")])}).orderBy("position").collect()
    want = sorted(((-(i % 7) / 7, str(i)) for i in range(300)))
    assert [(r["ord"], r["position"], json.loads(r["data"])["alert_id"]) for r in got] == [(2, k + 1, a) for k, (_, a) in enumerate(want)]


def test_forest_does_not_follow_partitions(spark):
    df = spark.range(2000).select("id", F.sin("id").alias("a"), F.cos(F.col("id") * 3).alias("b"))
    one, many = (sorted(map(str, forest.fit(df.repartition(n), ["a", "b"], trees=5, key=["id"]).collect())) for n in (1, 13))
    assert one == many and len(one) == 5


def test_private_step_does_not_tell_the_sample_size(spark):
    """The same sum over samples of different size gives the same step; an empty sample still takes a noisy one."""
    step = lambda df: privacy.private_step(df, ["x"], "y", [0.2], 1.0, 0.5, 0.1, np.random.default_rng(3), 10.0)
    one = spark.createDataFrame([(1.0, 1.0)], "x double, y double")
    padded = one.unionByName(spark.createDataFrame([(0.0, 1.0)] * 40, "x double, y double"))  # rows of no gradient
    assert step(one) == pytest.approx(step(padded))
    assert step(one.limit(0)) != [0.2]


def test_strict_words():
    assert profile.name_match("business_unit")[0] == "ssn"
    assert profile.name_match("business_unit", strict_words=True) is None
    assert profile.name_match("customer_email", strict_words=True)[0] == "email"


def test_value_marks_lose_nothing(spark):
    from ledgerveil.functions import pii
    import re

    texts = ["ada@example.org", "call 555-123-4567", "00:1A:2B:3C:4D:5E", "fe80:0:0:0:1:2:3:abcd", "K1A 0B1", "no marks here", "12.5, 45.1", "ABCDE1234F", None, ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in profile.value_profile(df).collect():
        want = sum(1 for t in texts if t and re.search(pii.value_pattern_list()[r["ord"]][2], t))
        assert (r["n_match"], r["n_values"]) == (want, 9), r


def test_plan_and_transform(people):
    clean, log, matches = certify.sanitise(people, "k")
    row = clean.orderBy("amount").first()
    assert len(row["customer_name"]) == 16 and len(row["email"]) == 16 and "*" in row["phone_number"]
    assert row["customer_age"] == "65+"
    assert {r["column_name"] for r in log.collect()} == {r["column_name"] for r in matches.collect()}
    assert all(r["success"] for r in log.collect())


def test_failing_treatment_is_closed(people):
    clean, log = transform.apply_plan(people, {"email": ("age", "generalize")}, "k")
    assert {r[0] for r in clean.select("email").collect()} == {masking.REDACTED}
    assert not log.first()["success"]


def test_noise_is_per_row(spark):
    df = spark.range(4000).select((F.col("id") % 100).cast("double").alias("v"))
    out, _ = transform.apply_plan(df, {"v": ("income", "noise")}, "k", seed=3)
    pairs = [r[0] for r in out.select("v").collect()]
    gaps = np.array([p - round(p) for p in pairs])
    assert len(set(np.round(pairs, 9))) > 3900 and np.abs(gaps).max() > 0


def test_end_to_end_certificate(spark):
    rows = [("Ada", "ada@example.org", "555-123-4567", "123-45-6789", 30 + i % 3, 50000 + i, 9.5, i % 2 == 0) for i in range(30)]
    df = spark.createDataFrame(rows, "customer_name string, email string, phone string, ssn string, age bigint, income bigint, transaction_amount double, is_fraud boolean")
    assert not profile.detection_summary(df, profile.detect(df)).first()["passed"]
    clean, cert, events = certify.full_run(df, "d", "k", "2026-01-01T00:00:00")
    assert cert.first()["certification_score"] > 0
    assert audit.verify(events).count() == 0
    kinds = [r["event_type"] for r in events.orderBy("seq").collect()]
    assert kinds[:2] == ["pii_scan_started", "pii_scan_completed"] and kinds[-3:-1] == ["transformation_completed", "certification_requested"]
    assert kinds[2:-4] == ["pii_detected"] * profile.detect(df).count() and kinds[-4] == "transformation_started" and kinds[-1].startswith("certification_")
    assert clean.columns == df.columns


def test_certificate_levels_and_release(spark, tmp_path):
    good = spark.createDataFrame([("aaaa", 1)] * 10, "kind_hash string, n int")
    cert = certify.certify(good)
    assert cert.first()["certification_level"] == "gold"
    assert certify.release(good, cert, str(tmp_path), "t").endswith("certified")
    certify.assert_certified(cert)
    bad = spark.createDataFrame([(f"user{i}@example.org {i:09d} qwertyuiopasdfghjklzxcvbnm", i) for i in range(50)], "email string, ssn int")
    failed = certify.certify(bad)
    assert failed.first()["certification_level"] == "failed"
    assert certify.release(bad, failed, str(tmp_path), "t").endswith("quarantine")
    with pytest.raises(certify.NotCertified):
        certify.assert_certified(failed)
    assert certify.advice(failed).where("kind = 'warning'").count() >= 2
    assert "Certificate " in certify.certificate_text(cert, "2026").first()["certificate"]


def test_hmac_equals_python(spark):
    vals = ["abc", "naïve Grüße", "x" * 200, "", None]
    df = spark.createDataFrame([(v,) for v in vals], "v string")
    for key in ("secret", "k" * 100):
        got = [r[0] for r in df.select(hashing.keyed_hash("v", key)).collect()]
        want = [hmac.new(key.encode(), v.encode(), hashlib.sha256).hexdigest()[:16] if v else None for v in vals]
        assert got == want


def test_masks_bins_and_dates(spark):
    df = spark.createDataFrame([("1234567", 18, "1990-05-01", "40.71,-74.06", "12345"), ("123", 25, "31/12/1980", "x,y", "12"), (None, 99, "soon", "1,2,3", None)],
                               "s string, a int, d string, g string, z string")
    out = df.select(masking.mask_middle("s"), binning.age_band("a"), binning.birth_decade("d", 2026), binning.coarse_coordinates("g"), binning.zip_prefix("z"), masking.truncate_half("s")).collect()
    assert [tuple(r) for r in out] == [
        ("12***67", "<18", "30s", "40.7,-74.1", "123XX", "123..."), ("***", "18-24", "40s", None, "12", "123"), (None, "65+", "unknown", None, None, None),
    ]


def test_tokens_keep_the_format(spark):
    df = spark.createDataFrame([("Ab-12 é",), ("Ab-12 é",), (None,)], "v string")
    a, b, c = [r[0] for r in df.select(masking.tokenize("v", "k")).collect()]
    assert a == b and c is None and len(a) == 7
    assert a[0].isupper() and a[2] == "-" and a[3:5].isdigit() and a[5] == " " and a[6].isupper()


def test_approximate_uniqueness(spark):
    df = spark.range(20000).select(F.col("id"), (F.col("id") % 50).cast("string").alias("g"), F.when(F.col("id") % 2 == 0, "x").alias("h"))
    got = {r["column_name"]: r for r in profile.uniqueness(df, approximate=True).collect()}
    assert abs(got["id"]["unique_count"] - 20000) < 1000 and abs(got["g"]["unique_count"] - 50) <= 1 and got["h"]["unique_count"] == 2
    assert got["g"]["k_anonymity_estimate"] >= 390


def test_k_anonymity_edges(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), (None, 2)], "k string, v int")
    assert tuple(profile.k_anonymity(df, ["k"], 2).first()) == (False, 1)
    assert tuple(profile.k_anonymity(df, ["missing"], 2).first()) == (True, 3)
    u = profile.uniqueness(df).where("column_name = 'k'").first()
    assert (u["unique_count"], u["total_count"], u["k_anonymity_estimate"]) == (2, 3, 1)


# --- splitting --------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def labelled(spark):
    return spark.range(1000).select(F.col("id"), (F.col("id") < 100).alias("is_fraud"))


def test_split_keeps_rows_and_ratio(labelled):
    out = split.stratified_split(labelled, "is_fraud", ["id"])
    rows = {r["split"]: r for r in split.split_summary(out, "is_fraud").collect()}
    assert {k: v["n_rows"] for k, v in rows.items()} == {"train": 700, "val": 150, "test": 150}
    assert all(abs(r["fraud_ratio"] - 0.1) < 1e-9 for r in rows.values())
    with pytest.raises(ValueError):
        split.stratified_split(labelled, "is_fraud", ["id"], 0.5, 0.1, 0.1)


def test_partitions_cover_all_rows(labelled):
    for out in (split.iid_partition(labelled, ["id"], 3), split.dirichlet_partition(labelled, "is_fraud", ["id"], 3)):
        assert out.count() == 1000 and out.select("id").distinct().count() == 1000
        assert {r[0] for r in out.select("client_id").distinct().collect()} <= {0, 1, 2}


def test_shuffle_is_reproducible(labelled):
    a, b = ([r["id"] for r in split.shuffled(labelled.repartition(n), ["id"], 3).collect()] for n in (2, 5))
    assert a == b and sorted(a) == list(range(1000)) and a != sorted(a)


def test_undersample_and_weights(labelled):
    out = split.undersample(labelled, "is_fraud", ["id"], 2.0)
    assert out.where("is_fraud").count() == 100 and out.where("not is_fraud").count() == 200
    assert split.undersample(labelled, "is_fraud", ["id"], 20.0).count() == 1000
    w = {r["is_fraud"]: r["weight"] for r in split.class_weights(labelled, "is_fraud").collect()}
    assert w[True] == 5.0 and abs(w[False] - 1000 / 1800) < 1e-12
    assert split.sample_fraction(labelled, ["id"], 1.5).count() == 1000
    assert abs(split.sample_fraction(labelled, ["id"], 0.3).count() - 300) < 60


# --- evaluation --------------------------------------------------------------------------------------


def test_perfect_and_constant_scores(spark):
    df = spark.createDataFrame([(True, 0.9), (True, 0.8), (False, 0.1), (False, 0.2)], "y boolean, s double")
    m = evaluate.ranking_metrics(df, "y", "s").first()
    assert m["roc_auc"] == 1.0 and m["average_precision"] == 1.0 and m["best_threshold"] == 0.8
    c = evaluate.confusion(df, "y", "s").first()
    assert c["tp"] + c["fp"] + c["tn"] + c["fn"] == 4 and c["f1"] == 1.0
    flat = evaluate.ranking_metrics(df.withColumn("s", F.lit(0.5)), "y", "s").first()
    assert flat["roc_auc"] == 0.5
    one = evaluate.ranking_metrics(df.where("y"), "y", "s").first()
    assert one["roc_auc"] == 0.0
    empty = evaluate.ranking_metrics(df.where("s > 2"), "y", "s").first()
    assert empty["best_threshold"] == 0.5 and empty["roc_auc"] == 0.0


def test_areas_equal_brute_force(spark):
    rng = np.random.default_rng(0)
    y, s = rng.random(400) < 0.2, np.round(rng.random(400), 2)
    m = evaluate.ranking_metrics(spark.createDataFrame([(bool(a), float(b)) for a, b in zip(y, s)], "y boolean, s double"), "y", "s").first()
    pos, neg = s[y], s[~y]
    auc = ((pos[:, None] > neg[None]).sum() + 0.5 * (pos[:, None] == neg[None]).sum()) / (len(pos) * len(neg))
    ap, last = 0.0, 0.0
    for t in sorted(set(s), reverse=True):
        tp, fp = (pos >= t).sum(), (neg >= t).sum()
        ap += (tp / len(pos) - last) * tp / (tp + fp)
        last = tp / len(pos)
    assert abs(m["roc_auc"] - auc) < 1e-12 and abs(m["average_precision"] - ap) < 1e-12


# --- privacy ------------------------------------------------------------------------------------------


def test_clip_bounds(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.5, 0.5],), ([0.0, 0.0],)], "g array<double>")
    a = [r[0] for r in df.select(vectors.clip_l2(F.col("g"), 1.0)).collect()]
    assert np.allclose(a, [[0.6, 0.8], [0.5, 0.5], [0, 0]])
    b = [np.linalg.norm(r[0]) for r in df.select(vectors.clip_l2_smooth(F.col("g"), 1.0)).collect()]
    assert max(b) <= 1.0 + 1e-9


def test_noise_moments(spark):
    r = spark.range(200_000).select(noise.laplace(2.0, 5).alias("l"), noise.gaussian(3.0, 6).alias("g"), noise.gumbel(7).alias("u")).agg(
        F.avg("l"), F.stddev("l"), F.avg("g"), F.stddev("g"), F.avg("u")
    ).first()
    assert abs(r[0]) < 0.05 and abs(r[1] - 2.0 * math.sqrt(2)) < 0.05 and abs(r[2]) < 0.05 and abs(r[3] - 3.0) < 0.05 and abs(r[4] - 0.5772) < 0.02


def test_release_is_near_the_truth(spark, labelled):
    got = privacy.release(labelled, "count", 1.0, by=["is_fraud"], seed=1).collect()
    assert all(abs(r["value"] - (100 if r["is_fraud"] else 900)) < 25 for r in got)
    with pytest.raises(ValueError):
        privacy.sensitivity("sum")


def test_choice_prefers_high_utility(spark):
    df = spark.range(3000).select((F.col("id") % 1000).alias("g"), F.when(F.col("id") < 1000, "a").when(F.col("id") < 2000, "b").otherwise("c").alias("o"),
                                  F.when(F.col("id") < 1000, 4.0).otherwise(0.0).alias("u"))
    share = privacy.choose(df, "o", "u", 2.0, ["g"], seed=2).where("o = 'a'").count() / 1000
    want = math.exp(4) / (math.exp(4) + 2)
    assert abs(share - want) < 0.03


def _ledger(spark, n, sigma):
    return spark.createDataFrame([("a", i, sigma, 1.0, 1.0, 1) for i in range(n)], "account string, seq bigint, sigma double, sensitivity double, sampling_rate double, n_steps int")


def test_budget(spark):
    s = ledger.summary(_ledger(spark, 100, 0.5), 0.1).first()
    assert s["budget_exhausted"] and s["remaining_epsilon"] == 0
    few, many = (ledger.spent(_ledger(spark, n, 1.0)).first()["spent_epsilon"] for n in (1, 5))
    assert many > few > 0
    more_noise = ledger.spent(_ledger(spark, 5, 4.0)).first()["spent_epsilon"]
    assert more_noise < many
    assert ledger.can_spend(_ledger(spark, 0, 1.0), "a", 1.0, 1.0)
    with pytest.raises(ledger.BudgetExhausted):
        ledger.query_with_debit(spark.range(5), _ledger(spark, 100, 0.5), "a", 0.1, "count", 0.5)


def test_user_and_native_gradients_agree(spark):
    rng = np.random.default_rng(4)
    rows = [(float(a), float(b), bool(c)) for a, b, c in zip(rng.normal(size=300), rng.normal(size=300), rng.random(300) < 0.4)]
    df = spark.createDataFrame(rows, "x double, z double, y boolean")
    native = privacy.clipped_gradient_sum(df, ["x", "z"], "y", [0.3, -0.2], 0.5).first()
    user = privacy.user_gradient_sum(df, ["x", "z"], "y", [0.3, -0.2], lambda w, x, y: (1 / (1 + np.exp(-x @ w)) - y)[:, None] * x, 0.5).orderBy("coord").collect()
    assert abs(native["g0"] - user[0]["value"]) < 1e-9 and abs(native["g1"] - user[1]["value"]) < 1e-9 and user[0]["n"] == 300


# --- robust aggregation -----------------------------------------------------------------------------------


def _vectors(spark, rows):
    return spark.createDataFrame([(1, i, 100, [float(x) for x in v]) for i, v in enumerate(rows)], "round int, client_id int, num_samples int, weights array<double>")


def _result(df):
    return [r["value"] for r in df.orderBy("coord").collect()]


def test_aggregators(spark):
    assert _result(robust.fedavg(_vectors(spark, [[1, 1, 1], [2, 2, 2], [3, 3, 3]]))) == [2, 2, 2]
    k = _vectors(spark, [[1, 1], [1.1, 1], [0.9, 1], [1, 1.1], [100, 100]])
    assert max(_result(robust.multi_krum(k, 1))) < 2
    assert sorted(r[1] for r in robust.krum_select(k, 1).collect()) != [0, 1, 2, 3, 4]
    assert abs(_result(robust.trimmed_mean(_vectors(spark, [[0], [1], [1], [1], [100]]), 0.2))[0] - 1) < 1e-12
    assert _result(robust.coordinate_median(_vectors(spark, [[1, 100], [2, 2], [3, 3]]))) == [2, 3]
    assert _result(robust.trimmed_mean(_vectors(spark, [[1], [3]]), 0.2)) == [2]  # too few clients
    b = _vectors(spark, [[1 + i / 100] for i in range(12)] + [[50]])
    assert _result(robust.bulyan(b, 1))[0] < 2
    for alias in ("krum", "Multi-Krum", "median", "coordinate_median"):
        robust.robust_aggregate(k, alias)
    with pytest.raises(ValueError):
        robust.robust_aggregate(k, "magic")


def test_attacks_and_layers(spark):
    df = _vectors(spark, [[3, 4, 0, 2]] * 3)
    hit = robust.inject_outliers(df, "sign_flip", F.col("client_id") == 0).orderBy("client_id").collect()
    assert hit[0]["weights"] == [-3, -4, 0, -2] and hit[1]["weights"] == [3, 4, 0, 2]
    for a in robust.ATTACKS:
        robust.inject_outliers(df, a, F.col("client_id") == 0).collect()
    layers = robust.clip_layers(df, [2, 2], 1.0).first()["weights"]
    assert np.allclose(layers, [0.6, 0.8, 0, 1])
    assert robust.pack(robust.dp_fedavg(df, 1.0, 0.0)).first()["weights"] == pytest.approx([3 / math.sqrt(29), 4 / math.sqrt(29), 0, 2 / math.sqrt(29)])


# --- knowledge ------------------------------------------------------------------------------------------


IMP = "round int, bank_id string, feature string, importance double"
MET = "round int, bank_id string, fraud_rate double, accuracy double, loss double, num_samples bigint, num_fraud bigint"


def _met(spark, rates, rnd=1):
    return spark.createDataFrame([(rnd, f"b{i}", float(r), 0.9, 0.1, 1000, int(r * 1000)) for i, r in enumerate(rates)], MET)


def test_spike_needs_two_and_a_half_deviations(spark):
    got = alerts.fraud_rate_spikes(_met(spark, [0.01] * 7 + [0.95])).collect()
    assert len(got) == 1 and got[0]["severity"] == "critical"
    assert alerts.fraud_rate_spikes(_met(spark, [0.01] * 6 + [0.95])).count() == 0


def test_feature_shift(spark):
    rows = [(1, f"b{i}", "amount", 0.1) for i in range(3)] + [(2, f"b{i}", "amount", 0.5) for i in range(3)] + [(2, "b0", "fresh", 0.3)]
    got = {r["feature"]: r for r in alerts.feature_shifts(spark.createDataFrame(rows, IMP)).collect()}
    assert got["amount"]["alert_type"] == "zero_day" and got["amount"]["severity"] == "critical" and "fresh" in got


def test_combined_indicator(spark):
    rows = [(1, b, f, v) for b, f, v in (("b0", "s", 0.6), ("b1", "s", 0.5), ("b2", "s", 0.05), ("b0", "n", 0.1), ("b1", "n", 0.1), ("b2", "n", 0.1))]
    got = mining.combined_indicators(spark.createDataFrame(rows, IMP), _met(spark, [0.12, 0.10, 0.01])).collect()
    assert [(r["feature"], r["source_bank_count"]) for r in got] == [("s", 1)]


def test_promotion_and_upsert(spark):
    base = spark.createDataFrame([("P1", "n", "emergent", "high", 0.8, 15, 3), ("P2", "m", "emergent", "low", 0.5, 15, 3)],
                                 "pattern_id string, name string, pattern_type string, severity string, confidence double, observation_count bigint, source_bank_count bigint")
    lib = library.as_entries(base, when())
    out = {r["pattern_id"]: r for r in library.promote(lib, when()).collect()}
    assert out["P1"]["pattern_type"] == "fact" and out["P1"]["status"] == "confirmed" and out["P1"]["version"] == 2 and out["P2"]["pattern_type"] == "emergent"
    newer = lib.where("pattern_id = 'P1'").withColumns({"observation_count": F.lit(3).cast("bigint"), "confidence": F.lit(0.9), "first_seen": F.lit("2027-01-01").cast("timestamp")})
    m = {r["pattern_id"]: r for r in library.upsert(lib, newer, when()).collect()}
    assert m["P1"]["version"] == 2 and m["P1"]["observation_count"] == 15 and m["P1"]["confidence"] == 0.9 and m["P1"]["first_seen"].year == 2026
    assert library.remove(lib, newer).count() == 1
    assert library.empty(spark).count() == 0
    assert library.search(lib.withColumn("name", F.lit("Mule account")), "MULE").count() == 2


def test_two_round_ingest_and_reports(spark):
    rows = [(r, f"b{b}", f, v * (1 + 0.4 * b)) for r, scale in ((1, 1.0), (2, 3.0)) for b in range(3) for f, v in (("amount", 0.2 * scale), ("velocity", 0.1))]
    imp = spark.createDataFrame(rows, IMP)
    met = _met(spark, [0.02, 0.03, 0.2], 1).unionByName(_met(spark, [0.02, 0.25, 0.2], 2))
    out = central.ingest(imp, met, library.empty(spark), when(), 0.0)
    assert out["library"].count() > 3 and out["profiles"].count() == 3 and out["alerts"].count() > 0
    p = {r["bank_id"]: r for r in out["profiles"].collect()}
    assert abs(p["b0"]["avg_fraud_rate"] - (0.7 * 0.3 * 0.02 + 0.3 * 0.02)) < 1e-12 and p["b0"]["rounds_participated"] == 2
    rounds = central.round_history(met)
    stats = central.global_statistics(out["profiles"], rounds)
    rep = reports.global_report(stats, central.trend(rounds), central.feature_ranking(imp), out["library"], out["alerts"], central.risk_scores(out["profiles"]), when())
    assert [r["ord"] for r in rep.orderBy("ord").collect()] == [1, 2, 3, 4, 5, 6]
    assert reports.bank_report("nobody", out["profiles"], out["library"], out["alerts"], when()).count() == 0
    assert central.snapshot(3, AS_OF, library.statistics(out["library"]), stats, central.feature_ranking(imp), rounds).first()["version"] == 3


def test_ema_matches_recursion_with_missing_rounds(spark):
    rows = [(i, "b0", x, 0.9, 0.1, 10, 1) for i, x in enumerate([0.1, None, 0.4, 0.2, None, 0.9])]
    r = 0.0
    for x in (0.1, 0.4, 0.2, 0.9):
        r = 0.7 * r + 0.3 * x
    got = central.bank_profiles(spark.createDataFrame(rows, MET)).first()
    assert abs(got["avg_fraud_rate"] - r) < 1e-12 and got["rounds_participated"] == 6


# --- explanation, retrieval ---------------------------------------------------------------------------------


def test_explanations(spark):
    rows = [("t1", 0.85, {"amount_zscore": 3.5, "velocity_1h": 5.0, "distance_from_home": 150.0, "is_night": 1.0}, {"amount_zscore": 0.5, "velocity_1h": -0.9}), ("t2", 0.15, {"amt": 1.0}, {})]
    df = spark.createDataFrame(rows, "id string, p double, v map<string,double>, s map<string,double>")
    a, b = explain.explain(df, "id", "p", "v", "s").orderBy("transaction_id").collect()
    assert a["risk_level"] == "high" and len(a["patterns"]) == 4 and a["top_features"][0]["feature_name"] == "velocity_1h" and a["top_features"][0]["direction"] == "decreases"
    assert "Verify customer location" in a["actions"] and a["brief"].startswith("High risk (85.0% probability) due to unusually high")
    assert b["risk_level"] == "low" and b["patterns"] == ["No clear fraud pattern detected"] and b["summary"] == "transaction amount (1.00) increases risk"
    levels = spark.createDataFrame([(x,) for x in (0.1, 0.55, 0.75, 0.95)], "p double").select(scoring.risk_level(F.col("p"))).collect()
    assert [r[0] for r in levels] == ["low", "medium", "high", "critical"]


def test_documents(spark):
    seed = retrieval.seed_documents(spark)
    new = spark.createDataFrame([("mule", "changed", {"category": "x"})], seed.schema)
    out = retrieval.upsert_documents(seed, new)
    assert out.count() == 11 and out.where("content = 'changed'").count() == 1
    m = retrieval.text_model(256, "content").fit(seed)
    docs = retrieval.embed(seed, m, as_array=True)
    q = retrieval.embed(spark.createDataFrame([("a mule account forwards the deposits",)], "content string"), m, as_array=True).select(F.lit(1).alias("query_id"), F.col("embedding").alias("vector"))
    hits = retrieval.nearest(docs, q, "doc_id", "embedding", 2)
    assert hits.where("rank = 1").first()["doc_id"] == "mule"
    assert retrieval.context(hits, seed, "doc_id", "content").first()["context"].startswith("[Source 1]: A mule")


# --- models --------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def matrix(spark):
    rng = np.random.default_rng(42)
    x = rng.normal(size=(1000, 5))
    y = np.zeros(1000, dtype=bool)
    y[:40] = True
    x[:40] += 3.0
    return spark.createDataFrame([(int(i), *map(float, r), bool(t)) for i, (r, t) in enumerate(zip(x, y))], "id int, a double, b double, c double, d double, e double, is_fraud boolean")


def test_models_separate_the_classes(matrix):
    feats = ["a", "b", "c", "d", "e"]
    ready = models.prepare(matrix, "is_fraud", feats, keep=["id"])
    for est in (models.logistic(feats), models.boosted(feats, rounds=5, depth=3)):
        m = models.train(ready, est)
        s = models.score(ready, m).select((F.col("label") == 1).alias("y"), "score")
        assert evaluate.ranking_metrics(s, "y", "score").first()["roc_auc"] > 0.95
        assert len(models.importance(m, feats)) == 5


def test_isolation_forest_finds_the_shifted_rows(matrix):
    feats = ["a", "b", "c", "d", "e"]
    s = forest.scaled(forest.anomaly_scores(matrix, forest.fit(matrix, feats, trees=60), feats))
    r = s.agg(F.min("score"), F.max("score")).first()
    assert r[0] == 0.0 and r[1] == 1.0
    assert evaluate.ranking_metrics(s, "is_fraud", "score").first()["roc_auc"] > 0.9


def test_weight_grid_and_ensemble(matrix):
    grid = models.weight_grid(3, 0.25)
    assert all(abs(sum(w) - 1) < 1e-9 and min(w) >= 0.01 for w in grid) and len(grid) == 15
    df = matrix.select("is_fraud", F.col("is_fraud").cast("double").alias("good"), (F.pmod(F.hash("id"), F.lit(100)) / 100).alias("bad"))
    best = models.best_weights(df, "is_fraud", ["good", "bad"], 0.5).first()
    assert best["average_precision"] == 1.0
    v = df.select(models.weighted_average(["good", "bad"], [3, 1]).alias("m")).agg(F.max("m")).first()[0]
    assert v <= 1.0


# --- sources -----------------------------------------------------------------------------------------------------


def test_loaders_tolerate_absence(spark, tmp_path):
    with pytest.raises(fraud.DatasetMissing):
        fraud.load_bank_applications(spark, str(tmp_path))
    spark.range(5).select(F.lit(1.5).alias("Time"), F.lit(2.5).alias("Amount"), F.lit(0).alias("Class")).write.option("header", True).csv(str(tmp_path / "creditcard.csv"))
    got = fraud.load_all(spark, {"credit_card_fraud": str(tmp_path), "paysim": str(tmp_path)})
    assert list(got) == ["credit_card_fraud"] and got["credit_card_fraud"].count() == 5
    assert dict(got["credit_card_fraud"].dtypes)["is_fraud"] == "boolean"
    s = fraud.dataset_stats(got["credit_card_fraud"], "credit_card_fraud").first()
    assert s["imbalance_ratio"] == float("inf")
    assert fraud.column_catalog(spark).count() == 45
    u = fraud.unify(got["credit_card_fraud"], "credit_card_fraud")
    assert u.columns == fraud.UNIFIED_COLUMNS


def test_sinks(spark, tmp_path, people):
    for fmt in ("parquet", "csv", "json"):
        tables.save(people, str(tmp_path), f"p_{fmt}", fmt)
    assert spark.read.parquet(str(tmp_path / "p_parquet")).count() == 3
    with pytest.raises(ValueError):
        tables.save(people, str(tmp_path), "x", "xml")
    assert uploads.label_column(["a", "Class", "label"]) == "Class"
    up = uploads.process_upload(people.withColumn("bank_id", F.lit("b"))).first()
    assert (up["n_rows"], up["n_fraud"]) == (3, 1)
    assert tables.preview(people, 500).count() == 3


def test_relaxed_union_types(spark):
    a = spark.createDataFrame([(1, 2, "x")], "k int, v bigint, s string")
    b = spark.createDataFrame([(1.5, True)], "v double, z boolean")
    out = fraud.relaxed_union(a, b)
    assert dict(out.dtypes) == {"k": "int", "v": "double", "s": "string", "z": "boolean"} and out.count() == 2
    assert fraud.common_type(T.IntegerType(), T.StringType()) == "string"


def test_validation(spark):
    df = spark.createDataFrame([(5.0, "a"), (-1.0, "b"), (None, None)], "amount double, kind string")
    rules = [validate.Rule("amount", minimum=0, required=True), validate.Rule("kind", allowed=("a",))]
    assert [r["n_violations"] for r in validate.violations(df, rules).collect()] == [2, 1]
    good, bad = validate.quarantine(df, rules)
    assert good.count() == 1 and bad.count() == 2
    filled = validate.impute(df, ["amount", "kind"]).collect()
    assert filled[2]["amount"] == 2.0 and filled[2]["kind"] == "a"
    empty = validate.fill_values(df.where("false"), ["amount", "kind"]).first()
    assert empty["amount"] == 0.0 and empty["kind"] == "UNKNOWN"
