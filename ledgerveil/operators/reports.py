"""Reports as tables of sections (report_id, ord, title, content, data, severity)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerveil.operators import alerts as al
from ledgerveil.operators import library as lib
from ledgerveil.plans.ranking import with_totals
from ledgerveil.plans.selection import ordered_rank

COLUMNS = ["report_id", "report_type", "generated_for", "ord", "title", "content", "data", "severity"]


def _section(df: DataFrame, kind: str, target: str, order: int, title: str, content: Column, data: Column, severity: Column) -> DataFrame:
    return df.select(
        F.lit(f"{kind.upper()}-{target}").alias("report_id"),
        F.lit(kind).alias("report_type"),
        F.lit(target).alias("generated_for"),
        F.lit(order).alias("ord"),
        F.lit(title).alias("title"),
        content.alias("content"),
        data.alias("data"),
        severity.alias("severity"),
    )


def _stack(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _counted(df: DataFrame, order: Column, top: int | None) -> DataFrame:
    """(n, data): how many rows a list has, and the first ``top`` of them in falling order as a JSON array if the caller asks for them.

    The whole list is a table of its own, see ``details``; no list is collected.
    """
    n = df.agg(F.count(F.lit(1)).alias("n"))
    if top is None:
        return n.withColumn("data", F.to_json(F.struct(F.col("n").alias("rows"))))
    cols = df.columns
    first = df.withColumn("_o", order).orderBy(F.desc("_o"), *cols).limit(top)
    rows = F.sort_array(F.collect_list(F.struct("_o", *cols)), asc=False)
    return with_totals(n, first.agg(F.to_json(F.transform(rows, lambda r: F.struct(*[r[c].alias(c) for c in cols]))).alias("data")), [])


def details(report_id: str, lists: dict[int, tuple[DataFrame, list[Column]]]) -> DataFrame:
    """(report_id, ord, position, data): every row of a report's lists as JSON, numbered from 1 in its section.

    ``lists``: section number to rows and what they are ordered by. Rows are numbered by ranges, however long a list is.
    """
    parts = []
    for ord_, (df, order) in lists.items():
        keyed = df.select(F.lit(ord_).alias("ord"), *[o.alias(f"_o{i}") for i, o in enumerate(order)], F.to_json(F.struct(*df.columns)).alias("data"))
        ranked = ordered_rank(keyed, ["ord"], [*[f"_o{i}" for i in range(len(order))], "data"], "position")
        parts.append(ranked.select(F.lit(report_id).alias("report_id"), "ord", F.col("position").cast("long").alias("position"), "data"))
    return _stack(parts)


def global_details(ranking: DataFrame, store: DataFrame, alert_rows: DataFrame, risks: DataFrame, as_of: Column) -> DataFrame:
    """The lists of the global report: attack vectors, emergent threats, active alerts, institutions by risk."""
    fresh = lib.emergent(store, as_of).select("pattern_id", "name", "severity", "novelty")
    return details("GLOBAL-all", {
        3: (ranking, [-F.col("mean_importance")]), 4: (fresh, [-F.col("novelty"), F.col("pattern_id")]),
        5: (alert_rows.select("alert_id", "alert_type", "severity", "title"), [F.col("alert_id")]), 6: (risks, [-F.col("risk_score")]),
    })


def bank_details(bank_id: object, profiles: DataFrame, store: DataFrame, alert_rows: DataFrame, as_of: Column) -> DataFrame:
    """The lists of an institution's report: confirmed threats, emerging threats, network alerts; none for an unknown institution."""
    fresh = lib.emergent(store, as_of).select("name", "description", "severity", "confidence", "first_seen", "novelty")
    facts = lib.fact_based(store).select("pattern_id", "name", "severity", "confidence")
    wide = al.relevant_to_banks(alert_rows).select("alert_id", "alert_type", "severity", "title")
    rows = details(f"BANK-{bank_id}", {2: (facts, [-F.col("confidence"), F.col("pattern_id")]), 3: (fresh, [-F.col("novelty"), F.col("name")]), 4: (wide, [F.col("alert_id")])})
    known = profiles.where(F.col("bank_id") == F.lit(bank_id)).select(F.lit(f"BANK-{bank_id}").alias("report_id"))
    return rows.join(F.broadcast(known), "report_id", "left_semi")  # one row


def emergent_details(store: DataFrame, alert_rows: DataFrame) -> DataFrame:
    """The lists of the briefing: zero-day patterns, critical alerts."""
    zero = store.where(F.col("pattern_type") == "zero_day").select("pattern_id", "name", "severity", "confidence")
    hot = alert_rows.where(F.col("severity") == "critical").select("alert_id", "alert_type", "title")
    return details("EMERGENT-all", {1: (zero, [-F.col("confidence"), F.col("pattern_id")]), 2: (hot, [F.col("alert_id")])})


def global_report(
    stats: DataFrame, trends: DataFrame, ranking: DataFrame, store: DataFrame, alert_rows: DataFrame, risks: DataFrame, as_of: Column,
    top: int | None = None,
) -> DataFrame:
    """Six sections over all institutions; ``top`` puts the first rows of their lists into them."""
    fresh = lib.emergent(store, as_of).select("pattern_id", "name", "severity", "novelty")
    facts = lib.fact_based(store).agg(F.count(F.lit(1)).alias("facts"))
    threat = with_totals(_counted(fresh, F.col("novelty"), top), facts, [])
    t = "all"
    parts = [
        _section(
            with_totals(stats, store.agg(F.count(F.lit(1)).alias("patterns")), []), "global", t, 1, "Executive summary",
            F.format_string("%d institutions, %d transactions, %d known patterns.", "total_banks", "total_transactions", "patterns"),
            F.to_json(F.struct(*[F.col(c) for c in stats.columns])), F.lit("info"),
        ),
        _section(
            trends, "global", t, 2, "Performance trends",
            F.when(F.col("rounds_analyzed") < 2, F.col("message")).otherwise(
                F.format_string("Accuracy %s at %.4f, loss %s at %.4f.", "accuracy_direction", "accuracy_current", "loss_direction", "loss_current")
            ),
            F.to_json(F.struct(*[F.col(c) for c in trends.columns])), F.lit("info"),
        ),
        _section(
            _counted(ranking, F.col("mean_importance"), top), "global", t, 3, "Top attack vectors",
            F.format_string("%d features ranked over all institutions.", "n"), F.col("data"), F.lit("info"),
        ),
        _section(
            threat, "global", t, 4, "Emergent threats",
            F.format_string("%d emergent patterns await validation; %d are confirmed.", "n", "facts"), F.col("data"),
            F.when(F.col("n") > 5, "critical").when(F.col("n") > 0, "warning").otherwise("info"),
        ),
        _section(
            _counted(alert_rows.select("alert_id", "alert_type", "severity", "title"), F.col("alert_id"), top),
            "global", t, 5, "Active alerts", F.format_string("%d alerts are active.", "n"), F.col("data"),
            F.when(F.col("n") > 0, "critical").otherwise("info"),
        ),
        _section(
            _counted(risks, F.col("risk_score"), top), "global", t, 6, "Institution risk",
            F.format_string("Risk scores of %d institutions.", "n"), F.col("data"), F.lit("info"),
        ),
    ]
    return _stack(parts)


def bank_report(bank_id: object, profiles: DataFrame, store: DataFrame, alert_rows: DataFrame, as_of: Column, top: int | None = None) -> DataFrame:
    """Sections for one institution; empty if it is unknown. ``top`` puts the first rows of their lists into them."""
    t = str(bank_id)
    own = profiles.where(F.col("bank_id") == F.lit(bank_id))
    fresh = lib.emergent(store, as_of).select("name", "description", "severity", "confidence", "first_seen", "novelty")
    facts = lib.fact_based(store).select("pattern_id", "name", "severity", "confidence")
    known, new = _counted(facts, F.col("confidence"), top), _counted(fresh, F.col("novelty"), top)
    wide = al.relevant_to_banks(alert_rows).select("alert_id", "alert_type", "severity", "title")
    network = _counted(wide, F.col("alert_id"), top)
    tips = with_totals(
        with_totals(own, known.select(F.col("n").alias("k")), []), new.select(F.col("n").alias("e")), []
    )
    advice = F.concat_ws(
        " ",
        F.when(F.col("avg_fraud_rate") > 0.05, F.lit("Tighten monitoring: the fraud rate is above five percent.")),
        F.when(F.col("model_accuracy") < 0.9, F.lit("Contribute more rounds: model accuracy is below 90 percent.")),
        F.when(F.col("k") > 0, F.format_string("Check defences against %d confirmed patterns.", "k")),
        F.when(F.col("e") > 0, F.format_string("Watch %d emergent patterns.", "e")),
        F.when((F.col("k") == 0) & (F.col("e") == 0), F.lit("Keep the current monitoring.")),
    )
    parts = [
        _section(
            own, "bank", t, 1, "Overview",
            F.format_string("%d rounds, %d transactions, average fraud rate %.4f.", "rounds_participated", "total_transactions", "avg_fraud_rate"),
            F.to_json(F.struct(*[F.col(c) for c in profiles.columns])), F.lit("info"),
        ),
        _section(
            known, "bank", t, 2, "Confirmed threats", F.format_string("%d confirmed patterns.", "n"), F.col("data"),
            F.when(F.col("n") > 0, "warning").otherwise("info"),
        ),
        _section(
            new, "bank", t, 3, "Emerging threats", F.format_string("%d emergent patterns.", "n"), F.col("data"),
            F.when(F.col("n") > 0, "warning").otherwise("info"),
        ),
        _section(
            network.where(F.col("n") > 0), "bank", t, 4, "Network alerts",
            F.format_string("%d alerts concern several institutions.", "n"), F.col("data"), F.lit("critical"),
        ),
        _section(tips, "bank", t, 5, "Recommended actions", advice, F.lit("{}"), F.lit("info")),
    ]
    known_bank = own.select(F.lit(f"BANK-{t}").alias("report_id"))
    return _stack(parts).join(known_bank, "report_id", "left_semi").select(*COLUMNS)


def emergent_briefing(store: DataFrame, alert_rows: DataFrame, top: int | None = None) -> DataFrame:
    """Zero-day patterns and critical alerts, sections only when there is something to say. ``top`` puts the first rows of the lists into them."""
    zero = store.where(F.col("pattern_type") == "zero_day").select("pattern_id", "name", "severity", "confidence")
    hot = alert_rows.where(F.col("severity") == "critical").select("alert_id", "alert_type", "title")
    return _stack(
        [
            _section(
                _counted(zero, F.col("confidence"), top).where(F.col("n") > 0), "emergent", "all", 1, "Zero-day indicators",
                F.format_string("%d patterns show characteristics not seen before.", "n"), F.col("data"), F.lit("critical"),
            ),
            _section(
                _counted(hot, F.col("alert_id"), top).where(F.col("n") > 0), "emergent", "all", 2, "Critical alerts",
                F.format_string("%d critical alerts need attention.", "n"), F.col("data"), F.lit("critical"),
            ),
        ]
    )


def compliance_report(stats: DataFrame, store: DataFrame, epsilon: float = 1.0, delta: float = 1e-5, target: str = "all") -> DataFrame:
    counts = lib.statistics(store)
    return _stack(
        [
            _section(
                stats, "compliance", target, 1, "Data privacy",
                F.format_string("%d rounds exchanged noised statistics only; no raw rows were shared.", "total_rounds"),
                F.to_json(F.struct(F.lit("Gaussian").alias("mechanism"), F.lit(epsilon).alias("epsilon"), F.lit(delta).alias("delta"), F.col("total_rounds"))),
                F.lit("info"),
            ),
            _section(
                counts, "compliance", target, 2, "Pattern library audit",
                F.format_string("%d patterns, all derived from aggregated statistics.", "total"),
                F.to_json(F.struct(*[F.col(c) for c in counts.columns])), F.lit("info"),
            ),
        ]
    )


def latest(reports: DataFrame, report_type: str | None = None, target: str | None = None, limit: int = 20) -> DataFrame:
    """Newest reports first; ``reports`` has report_id, report_type, generated_for, generated_at."""
    out = reports
    if report_type:
        out = out.where(F.col("report_type") == report_type)
    if target:
        out = out.where(F.col("generated_for").isin(target, "all"))
    return out.orderBy(F.col("generated_at").desc(), "report_id").limit(limit)


# --- compliance indicators ---------------------------------------------------------------------


def compliance_indicators(
    budget: DataFrame, classes: DataFrame, matches: DataFrame, consents: DataFrame, events: DataFrame, as_of: Column
) -> DataFrame:
    """(indicator, value) from the ledger summary, class sizes, detections, consents and audit events."""
    valid = F.col("consent_given") & (
        F.timestamp_seconds(F.unix_timestamp("consent_timestamp") + F.col("retention_period_days") * 86400) > as_of
    )
    direct = F.col("sensitivity").isin("critical", "high")
    parts = [
        budget.agg(F.min("remaining_epsilon").alias("v")).select(F.lit("remaining_epsilon").alias("indicator"), "v"),
        classes.agg(F.min("group_size").cast("double").alias("v")).select(F.lit("min_class_size").alias("indicator"), "v"),
        matches.agg(F.count_if(direct).cast("double").alias("v")).select(F.lit("pii_blocks_direct").alias("indicator"), "v"),
        matches.agg(F.count_if(~direct).cast("double").alias("v")).select(F.lit("pii_blocks_quasi").alias("indicator"), "v"),
        consents.agg((F.count_if(valid) * 100.0 / F.count(F.lit(1))).alias("v")).select(F.lit("consent_coverage_pct").alias("indicator"), "v"),
        events.agg(F.count(F.lit(1)).cast("double").alias("v")).select(F.lit("audit_entries").alias("indicator"), "v"),
    ]
    return _stack(parts).select("indicator", F.col("v").alias("value"))


def suspicious_transactions(df: DataFrame, thresholds: DataFrame, bank: str, score: str, amount: str, time: str) -> DataFrame:
    """Monthly count and amount of transactions at or above their institution's threshold."""
    j = with_totals(df, thresholds.select(bank, "threshold"), [bank])
    return (
        j.where(F.col(score) >= F.col("threshold"))
        .groupBy(bank, F.date_format(time, "yyyy-MM").alias("month"))
        .agg(F.count(F.lit(1)).alias("n_reported"), F.round(F.sum(amount), 2).alias("amount"))
    )
