"""Streams over several files: incremental results, late rows, batch equality."""

import pandas as pd
from pyspark.sql import functions as F

from ledgerveil.operators import models
from ledgerveil.streaming import jobs, monitoring, rules, state

SCHEMA = "ts timestamp, actor string, kind string"


def _write(spark, folder, name, rows):
    spark.createDataFrame([(pd.Timestamp(t).to_pydatetime(), a, k) for t, a, k in rows], SCHEMA).coalesce(1).write.parquet(f"{folder}/{name}")


def _stream(spark, folder):
    return jobs.read_parquet_stream(spark, f"{folder}/*", SCHEMA, files_per_trigger=1)


def test_rule_over_two_files_equals_batch(spark, tmp_path):
    src, out, cp = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")
    first = [(f"2024-01-01 00:0{i % 5}:{i:02d}", "a", "login_failure") for i in range(8)] + [("2024-01-01 00:03:00", "b", "login_failure")]
    _write(spark, src, "f1", first)
    rule = jobs.threshold_rule(_stream(spark, src), "ts", "actor", F.col("kind") == "login_failure", "5 minutes", "1 minute", 5, "10 minutes")
    jobs.to_parquet(rule, out, cp).awaitTermination()
    assert spark.read.schema(rule.schema).parquet(out).count() == 0  # the watermark has not passed yet
    _write(spark, src, "f2", [("2024-01-01 02:00:00", "c", "login_failure")])
    rule = jobs.threshold_rule(_stream(spark, src), "ts", "actor", F.col("kind") == "login_failure", "5 minutes", "1 minute", 5, "10 minutes")
    jobs.to_parquet(rule, out, cp).awaitTermination()
    got = sorted(map(tuple, spark.read.schema(rule.schema).parquet(out).collect()))
    batch = jobs.threshold_rule(spark.read.schema(SCHEMA).parquet(f"{src}/*"), "ts", "actor", F.col("kind") == "login_failure", "5 minutes", "1 minute", 5)
    assert got == sorted(map(tuple, batch.collect())) and len(got) >= 1
    # a row later than the watermark changes nothing
    _write(spark, src, "f3", [("2024-01-01 00:04:30", "b", "login_failure")] * 9 + [("2024-01-01 03:00:00", "c", "login_failure")])
    rule = jobs.threshold_rule(_stream(spark, src), "ts", "actor", F.col("kind") == "login_failure", "5 minutes", "1 minute", 5, "10 minutes")
    jobs.to_parquet(rule, out, cp).awaitTermination()
    assert sorted(map(tuple, spark.read.schema(rule.schema).parquet(out).collect())) == got


def test_batches_are_written_once(spark, tmp_path):
    src, out, cp = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")
    work = jobs.batch_writer(lambda b: b.groupBy("actor").agg(F.count(F.lit(1)).alias("n")), out)
    _write(spark, src, "f1", [("2024-01-01", "a", "x")] * 3)
    jobs.each_batch(_stream(spark, src), work, cp).awaitTermination()
    _write(spark, src, "f2", [("2024-01-02", "a", "x")] * 2)
    jobs.each_batch(_stream(spark, src), work, cp).awaitTermination()
    jobs.each_batch(_stream(spark, src), work, cp).awaitTermination()
    assert spark.read.parquet(out).groupBy("actor").agg(F.sum("n")).first()[1] == 5


def test_compliance_alerts(spark):
    ledger = spark.createDataFrame([("a", 0.5), ("b", 0.1), ("c", 0.0)], "account string, remaining_epsilon double")
    chain = spark.createDataFrame([("s1", True), ("s2", False)], "session_id string, broken boolean")
    got = {(r["rule"], r["subject"]) for r in jobs.compliance_alerts(ledger, None, chain).collect()}
    assert got == {("privacy_budget_low", "b"), ("privacy_budget_exhausted", "c"), ("audit_integrity_failure", "s1")}


def _file(spark, folder, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)


UPLOADS = "bank_id string, n_rows long, n_fraud long"


def test_running_totals_over_triggers_and_restarts(spark, tmp_path):
    src, out, cp = (str(tmp_path / x) for x in ("in", "out", "cp"))
    files = [[("a", 1, 1)] * 500 + [("b", 1, 0)], [("a", 1, 0)] * 30 + [(None, 1, 1)], [("b", 1, 1), ("c", 1, 0), (None, 1, 0)]]

    def run():
        stream = jobs.read_parquet_stream(spark, src, UPLOADS, files_per_trigger=1)
        jobs.each_batch(state.running_totals(stream, "bank_id", ["n_rows", "n_fraud"]), jobs.batch_writer(lambda b: b, out), cp, "update").awaitTermination()

    for rows in files[:2]:
        _file(spark, src, rows, UPLOADS)
    run()
    _file(spark, src, files[2], UPLOADS)
    run()
    run()  # nothing new
    got = state.latest_totals(spark.read.parquet(out), "bank_id", ["n_rows", "n_fraud"]).collect()
    assert {r.bank_id: (r.n_rows, r.n_fraud) for r in got} == {"a": (530, 500), "b": (2, 1), "c": (1, 0), None: (2, 1)}


def test_partial_sums_hand_on_few_rows(spark):
    rows = spark.range(200_000).select((F.col("id") % 3).alias("bank_id"), F.lit(1).alias("n")).repartition(4)
    got = state.partial_sums(rows, ["bank_id"], ["n"])
    assert got.count() <= 12 and got.agg(F.sum("n")).first()[0] == 200_000


REPORTS = "round long, bank_id string, num_samples long, num_fraud long, n_expected long, event_time timestamp"


def _reports(*rows):
    return [(r, b, n, f, e, pd.Timestamp(t).to_pydatetime()) for r, b, n, f, e, t in rows]


def test_rounds_are_tested_once_whole_or_late(spark, tmp_path):
    src, out, cp = (str(tmp_path / x) for x in ("in", "out", "cp"))
    files = [
        _reports((1, "a", 10, 1, 3, "2024-01-01 00:00"), (1, "b", 10, 2, 3, "2024-01-01 00:01"), (2, "a", 10, 1, 3, "2024-01-01 00:10")),
        _reports((1, "a", 30, 3, 3, "2024-01-01 00:02"), (2, "b", 10, 9, 3, "2024-01-01 00:12")),
        _reports((1, "a", 99, 99, 3, "2024-01-01 00:30"), (3, "a", 5, 0, 2, "2024-01-01 05:00")),  # round 1 was handed on; round 2 is left by the watermark
        _reports((3, "b", 5, 5, 2, "2024-01-01 05:01")),
    ]
    for rows in files:
        _file(spark, src, rows, REPORTS)
    whole = state.whole_rounds(jobs.read_parquet_stream(spark, src, REPORTS, files_per_trigger=1), delay="1 hour")
    jobs.each_batch(whole, jobs.batch_writer(lambda b: b, out), cp).awaitTermination()
    got = spark.read.parquet(out).collect()
    assert sorted((r["round"], r.bank_id, r.num_samples, r.num_fraud, r.complete) for r in got) == [
        (1, "a", 40, 4, True), (1, "b", 10, 2, True), (2, "a", 10, 1, False), (2, "b", 10, 9, False), (3, "a", 5, 0, True), (3, "b", 5, 5, True),
    ]
    assert len({(r["round"], r.batch) for r in got}) == 3  # a round's institutions come in one batch


EVENTS = "t timestamp, actor string, event string, weight long"


def test_all_documented_rules_in_one_plan(spark):
    at = pd.Timestamp("2024-01-01 10:00:00")
    rows = [((at + pd.Timedelta(seconds=10 * i)).to_pydatetime(), "a", "login_failure", 1) for i in range(6)]
    rows += [((at + pd.Timedelta(seconds=70 * i)).to_pydatetime(), "b", "login_failure", 1) for i in range(6)]  # six in 350 seconds
    rows += [((at + pd.Timedelta(milliseconds=50 * i)).to_pydatetime(), "c", "request", 1) for i in range(1001)]
    rows += [(at.to_pydatetime(), "d", "export_request", 11), (at.to_pydatetime(), "d", "access_denied", 3), (at.to_pydatetime(), "e", "access_denied", 4), (at.to_pydatetime(), "e", "other", 9999)]
    events = spark.createDataFrame(rows, EVENTS)
    got = rules.rule_alerts(events, rules.rule_table(spark), "t", "actor", "event", "weight").collect()
    assert {(r.rule, r.actor) for r in got} == {("brute_force", "a"), ("api_abuse", "c"), ("data_exfiltration", "d"), ("privilege_escalation", "e")}
    for name, (event, length, slide, more) in jobs.RULES.items():  # as each rule alone
        alone = jobs.threshold_rule(events.select("*", F.explode(F.expr("sequence(1L, weight)")).alias("_i")), "t", "actor", F.col("event") == event, length, slide, more).collect()
        assert sorted((r.actor, r.window_start, r.window_end, r.n) for r in got if r.rule == name) == sorted((r.actor, r.window_start, r.window_end, r.n) for r in alone)


ALERTS = "rule string, subject string, event_time timestamp"


def test_replayed_alerts_appear_once(spark, tmp_path):
    src, out, cp = (str(tmp_path / x) for x in ("in", "out", "cp"))
    t = pd.Timestamp("2024-01-01").to_pydatetime()
    for rows in ([("r", "x", t), ("r", "y", t)], [("r", "x", t), ("q", "x", t)], [("r", "y", t)] * 3):
        _file(spark, src, rows, ALERTS)
    jobs.to_parquet(rules.once(jobs.read_parquet_stream(spark, src, ALERTS, files_per_trigger=1)), out, cp).awaitTermination()
    assert sorted((r.rule, r.subject) for r in spark.read.parquet(out).collect()) == [("q", "x"), ("r", "x"), ("r", "y")]


def test_replayed_batch_changes_nothing(spark, tmp_path):
    """A batch that fails after its work was done is run again; rows and rounds stay as a batch job gives them."""
    from pyspark.errors import StreamingQueryException

    src, root, cp = (str(tmp_path / x) for x in ("in", "out", "cp"))
    rows = spark.range(300).select("id", (F.col("id") % 5).alias("bank"), (F.col("id") % 3).alias("round"), (F.col("id") % 7 / 7).alias("x"), (F.col("id") % 7 > 3).alias("y"))
    model = models.train(models.prepare(rows, "y", ["x"]), models.logistic(["x"]))
    models.save_model(model, str(tmp_path / "registry"), "m", "logistic", "2024-01-01", {}, ["x"], spark)
    for i in range(6):
        rows.where(F.col("id") % 6 == i).coalesce(1).write.mode("append").parquet(src)
    work, scored, rounds = monitoring.monitor(spark, root, models.load_model(str(tmp_path / "registry"), "m"), ["x"], "id", "bank", "round")
    calls = []

    def counted(batch, batch_id):
        calls.append(batch_id)
        work(batch, batch_id)

    flaky = monitoring.interrupted(counted, 1)
    for _ in range(2):
        try:
            jobs.each_batch(jobs.read_parquet_stream(spark, src, rows.schema, files_per_trigger=2), flaky, cp).awaitTermination()
        except StreamingQueryException:
            continue
    assert calls == [0, 1, 1, 2]
    batch = {r.id: (round(r.score, 9), r.score_label) for r in models.score(models.prepare(rows, "y", ["x"], keep=["id"]), model).collect()}
    streamed = scored.read().collect()
    assert len(streamed) == 300 and {r.id: (round(r.score, 9), r.flagged) for r in streamed} == batch
    assert {(r["round"], r.bank_id): r.n_rows for r in monitoring.merged_rounds(rounds).collect()} == {(i % 3, i % 5): 20 for i in range(15)}
