"""Rule streams: many windowed rules in one plan, and compliance alerts that appear once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerveil.plans.sizing import join_small
from ledgerveil.streaming.jobs import RULES, event_time

RULE_COLUMNS = "rule string, event string, length_seconds long, slide_seconds long, more_than long"


def _seconds(length: str) -> int:
    n, of = length.split()
    return int(n) * {"second": 1, "minute": 60, "hour": 3600, "day": 86400}[of.rstrip("s")]


def rule_table(spark: SparkSession, rules: dict[str, tuple[str, str, str, int]] = RULES) -> DataFrame:
    """The documented rules as a table; a deployment may keep its own in the same columns."""
    return spark.createDataFrame([(name, event, _seconds(length), _seconds(slide), more) for name, (event, length, slide, more) in rules.items()], RULE_COLUMNS)


def rule_alerts(events: DataFrame, rules: DataFrame, time: str, actor: str, event: str, weight: str | None = None, delay: str = "0 seconds") -> DataFrame:
    """(rule, actor, window_start, window_end, n): windows in which an actor exceeds a rule, for all rules in one plan.

    Rules are joined to the events by their kind, so windows of every length go through one aggregate. On a stream the
    ends of windows are the event time: a window is handed on once the watermark, ``delay`` and the longest window behind
    the latest end, has passed it. ``weight`` is a column of counts, for logs that hold several events in a row.
    """
    longest = rules.agg(F.max("length_seconds")).first()[0] or 0
    some = event_time(events, time).select(F.unix_micros(F.col(time)).alias("t"), F.col(actor).alias("actor"), F.col(event).alias("event"), (F.col(weight) if weight else F.lit(1)).cast("long").alias("weight"))
    met = join_small(some, rules, ["event"])
    length, slide = F.col("length_seconds") * 1_000_000, F.col("slide_seconds") * 1_000_000
    starts = F.transform(F.sequence(F.lit(0).cast("long"), F.expr("(length_seconds - 1) div slide_seconds")), lambda k: F.col("t") - F.pmod(F.col("t"), slide) - k * slide)
    each = met.withColumn("start", F.explode(F.filter(starts, lambda s: s + length > F.col("t")))).withColumn("window_end", F.timestamp_micros(F.col("start") + length))
    if events.isStreaming:
        each = each.withWatermark("window_end", f"{_seconds(delay) + longest} seconds")
    counted = each.groupBy("window_end", "rule", "actor", "length_seconds", "more_than").agg(F.sum("weight").alias("n")).where(F.col("n") > F.col("more_than"))
    start = F.timestamp_micros(F.unix_micros("window_end") - length)
    return counted.select("rule", "actor", start.alias("window_start"), "window_end", "n")


def once(alerts: DataFrame, time: str = "event_time", keys: tuple[str, ...] = ("rule", "subject"), within: str = "1 day") -> DataFrame:
    """Alerts with each key once: on a stream repeats within the watermark are dropped, in a batch all repeats."""
    if alerts.isStreaming:
        return alerts.withWatermark(time, within).dropDuplicatesWithinWatermark(list(keys))
    return alerts.dropDuplicates(list(keys))
