"""Stateful streaming operators: running totals of institutions, rounds tested once they are whole."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def partial_sums(df: DataFrame, keys: Sequence[str], sums: Sequence[str], latest: str | None = None) -> DataFrame:
    """Sums (and the latest time) of each key within a partition, before anything is shuffled.

    A key with a third of all rows then reaches its state as a few rows a task. Works on streams: it keeps no state itself.
    """
    wanted = [*keys, *sums, *([latest] if latest else [])]
    some = df.select(*keys, *[F.col(s).cast("long").alias(s) for s in sums], *([F.col(latest).cast("timestamp").alias(latest)] if latest else []))

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, rows = [], 0
        how = {s: "sum" for s in sums} | ({latest: "max"} if latest else {})
        for pdf in batches:
            held.append(pdf.groupby(list(keys), dropna=False, sort=False).agg(how).reset_index())
            rows += len(held[-1])
            if rows > 100_000:  # fold again; a partition holds each key once
                held = [pd.concat(held).groupby(list(keys), dropna=False, sort=False).agg(how).reset_index()]
                rows = len(held[0])
                if rows > 50_000:
                    yield held[0][wanted]
                    held, rows = [], 0
        if held:
            yield pd.concat(held).groupby(list(keys), dropna=False, sort=False).agg(how).reset_index()[wanted]

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in some.select(*wanted).schema.fields)
    return some.select(*wanted).mapInPandas(fold, schema)


def running_totals(df: DataFrame, key: str, sums: Sequence[str]) -> DataFrame:
    """(key, sums..., version): a key's totals over the whole stream so far, each time they change.

    The greatest version of a key (how many rows it has had) is its present total; ``latest_totals`` reads it from a sink.
    Rows are summed within a partition before the shuffle.
    """
    totals = [F.coalesce(F.sum(F.col(s).cast("long")), F.lit(0).cast("long")).alias(s) for s in sums]
    return df.groupBy(key).agg(*totals, F.count(F.lit(1)).alias("version"))


def latest_totals(written: DataFrame, key: str, sums: Sequence[str]) -> DataFrame:
    """The present totals from all that ``running_totals`` wrote."""
    newest = F.max_by(F.struct(*sums), "version").alias("t")
    return written.groupBy(key).agg(newest).select(key, "t.*")


def whole_rounds(reports: DataFrame, time: str = "event_time", delay: str = "1 hour", grace_ms: int = 0) -> DataFrame:
    """(round, bank_id, num_samples, num_fraud, fraud_rate, complete): each round's institutions, all at once.

    ``reports``: round, bank_id, num_samples, num_fraud (partial sums of an institution; there may be several), n_expected
    (how many reports the round will have) and an event time. A round is handed on once all its reports are in, or once
    the watermark has passed its latest report by ``grace_ms``, then with complete false. Later reports of a round that was
    handed on are left out, until the watermark has passed and its state is let go.
    """
    marked = reports.select("round", F.col("bank_id").cast("string").alias("bank_id"), "num_samples", "num_fraud", F.lit(1).alias("parts"), "n_expected", F.col(time).cast("timestamp").alias(time))
    marked = marked.withWatermark(time, delay)
    out = "round long, bank_id string, num_samples long, num_fraud long, fraud_rate double, complete boolean"
    held = "banks array<string>, samples array<long>, fraud array<long>, parts long, expected long, until long, done boolean"

    def emitted(name: int, sums: dict, complete: bool) -> pd.DataFrame:
        rows = [(name, b, n, f, f / n if n else 0.0, complete) for b, (n, f) in sorted(sums.items())]
        return pd.DataFrame(rows, columns=["round", "bank_id", "num_samples", "num_fraud", "fraud_rate", "complete"])

    def collect(name: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        banks, samples, fraud, parts, expected, until, done = state.get if state.exists else ([], [], [], 0, 0, 0, False)
        sums = {b: (int(n), int(f)) for b, n, f in zip(banks, samples, fraud, strict=True)}
        if state.hasTimedOut:
            state.remove()
            if not done:
                yield emitted(name[0], sums, False)
            return
        for pdf in batches:
            until = max(until, int(pdf[time].max().timestamp() * 1000))
            if done:
                continue
            expected = max(expected, int(pdf["n_expected"].max()))
            parts += int(pdf["parts"].sum())
            for b, n, f in pdf.groupby("bank_id", dropna=False)[["num_samples", "num_fraud"]].sum().itertuples():
                old = sums.get(b, (0, 0))
                sums[b] = (old[0] + int(n), old[1] + int(f))
        if not done and parts >= expected:
            yield emitted(name[0], sums, True)
            sums, done = {}, True
        state.update((list(sums), [n for n, _ in sums.values()], [f for _, f in sums.values()], parts, expected, until, done))
        state.setTimeoutTimestamp(max(until + grace_ms, state.getCurrentWatermarkMs()) + 1)

    keyed = marked.withColumn("round", F.col("round").cast("long"))
    return keyed.groupBy("round").applyInPandasWithState(collect, out, held, "append", GroupStateTimeout.EventTimeTimeout)
