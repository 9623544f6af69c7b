"""Headline queries, timed end to end; prints one JSON line.

Each query's rows are counted through a no-op write, so that every column is computed.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "value_profile_documents", "column_uniqueness", "character_entropy", "k_anonymity", "apply_plan", "certify_customers", "audit_chain",
    "load_mobile_payments", "dataset_statistics", "stratified_split", "account_velocity", "card_features", "temporal_split",
    "confusion_matrix", "ranking_metrics", "ranking_metrics_continuous", "model_comparison",
    "fedavg", "multi_krum", "trimmed_mean", "coordinate_median", "bulyan", "ledger_running_epsilon", "clipped_gradient_sum",
    "mining_run", "alert_summary", "bank_profiles", "explain_predictions", "feature_ranks", "nearest_documents",
    "batch_scoring", "isolation_forest", "train_boosted", "stacked_scores", "anomalies_after_ingest", "text_retrieval",
    "rule_windows_stream", "velocity_stream", "indexed_documents", "train_leafwise", "rule_alerts_stream", "sketched_uniqueness",
]


def main() -> None:
    from ledgerveil.catalog import QUERIES
    from ledgerveil.session import build_session

    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__ui__enabled="false", spark__driver__memory="12g",
        spark__sql__parquet__compression__codec="zstd",
    )
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["label_counts"](spark, sf).collect()  # start the executor and the reader
    times: dict[str, float] = {}
    for name in HEADLINE:
        t = time.time()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t, 3)
        print(f"{name} {times[name]}", file=sys.stderr)
    spark.stop()
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
