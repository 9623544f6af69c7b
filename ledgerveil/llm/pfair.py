"""Mixing sources to target weights by Pfair scheduling.

Every source is cut into blocks. In a fluid mix every source is read at its target's pace; when one ends, the targets
of the rest are scaled up. A block may start at the slot before which the fluid mix begins it and has to be done by the
slot in which the fluid mix ends it; earliest-deadline-first over these windows keeps every source within one block of
its target at every slot. Weights are taken as they are.

The slots are cut into chunks. A chunk's own blocks follow from the sources' sizes and weights. Blocks handed on from
one chunk to the next are at all times few (about one a source), and which they are follows from each chunk's latest
deadlines alone, so chunks are worked out by tasks of their own and only what is handed on is carried along.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerveil.llm.text import map_arrow, written


BLOCK_ROWS = 16
CHUNK_SLOTS = 1 << 18
RUN_ROWS = 4096
NULL = "\x00null"  # stands for the null source in weights


def shares(weights: dict[str, float], resolution: int) -> dict[str, int]:
    """Whole shares that sum to ``resolution``, at least 1 each (largest remainders)."""
    total = sum(weights.values())
    exact = {s: w / total * resolution for s, w in weights.items()}
    out = {s: max(1, int(x)) for s, x in exact.items()}
    order = sorted(exact, key=lambda s: (out[s] - exact[s], s))
    while (gap := resolution - sum(out.values())) != 0:
        for s in order if gap > 0 else reversed(order):
            if gap and (gap > 0 or out[s] > 1):
                out[s] += 1 if gap > 0 else -1
                gap += -1 if gap > 0 else 1
    return out


def period(units: dict[str, int]) -> list[tuple[str, int]]:
    """(source, block from 1) by slot for one period of whole shares."""
    n, names = sum(units.values()), sorted(units)
    jobs = sorted((k * n // units[s], -(-(k + 1) * n // units[s]), i, k) for i, s in enumerate(names) for k in range(units[s]))
    return [(names[i], k + 1) for _, (_, i, k) in earliest(jobs, 0, n)[0]]


def earliest(jobs: Iterable[tuple[int, int, int, int]], start: int, stop: int) -> tuple[list, list]:
    """Earliest deadline first over slots from ``start`` to ``stop``: ([(slot, block)], blocks left over).

    ``jobs`` are (release, deadline, source, number) in order of release; a block is (deadline, source, number).
    """
    jobs, at, ready, out = list(jobs), 0, [], []
    for slot in range(start, stop):
        while at < len(jobs) and jobs[at][0] <= slot:
            heapq.heappush(ready, jobs[at][1:])
            at += 1
        if ready:
            out.append((slot, heapq.heappop(ready)))
    return out, sorted(ready + [j[1:] for j in jobs[at:]])


class Fluid:
    """The fluid mix of sources with ``blocks`` and ``weights`` (arrays): who has been read how far at which slot."""

    def __init__(self, blocks: np.ndarray, weights: np.ndarray) -> None:
        self.blocks, self.total = blocks, int(blocks.sum())
        self.weights = weights / weights.max()
        order = np.argsort(blocks / self.weights, kind="stable")
        self.ends = (blocks / self.weights)[order]
        w = self.weights[order]
        self.done = np.concatenate([[0.0], np.cumsum(blocks[order])])  # blocks of the sources that have ended
        self.rate = np.concatenate([np.cumsum(w[::-1])[::-1], [0.0]])  # weights of those that have not
        self.slots = self.done[:-1] + self.ends * self.rate[:-1]

    def slot(self, time: np.ndarray) -> np.ndarray:
        """Slots (fractions) passed at times; at time t a running source has been read t * weight blocks."""
        i = np.searchsorted(self.ends, time)
        return self.done[i] + time * self.rate[i]

    def first(self, slot: int) -> np.ndarray:
        """Per source, the first block that the fluid mix has not begun before ``slot``."""
        if slot >= self.total:
            return self.blocks
        i = int(np.searchsorted(self.slots, slot))
        time = (slot - self.done[i]) / self.rate[i]
        return np.minimum(self.blocks, np.ceil(self.weights * time - 1e-9 - time * 1e-15)).astype(np.int64)

    def jobs(self, start: int, stop: int) -> list[tuple[int, int, int, int]]:
        """(release, deadline, source, number) of the blocks released from ``start`` to before ``stop``, by release."""
        low, n = self.first(start), self.first(stop)
        n = n - low
        s = np.repeat(np.arange(len(n)), n)
        k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + low[s]
        begin, end = self.slot(k / self.weights[s]), self.slot((k + 1) / self.weights[s])
        # whole numbers that floats miss by a hair
        release = np.clip(np.floor(begin + 1e-7 + begin * 1e-15), start, stop - 1).astype(np.int64)
        deadline = np.ceil(end - 1e-7 - end * 1e-15).astype(np.int64)
        order = np.lexsort((k, s, deadline, release))
        return list(zip(*(x[order].tolist() for x in (release, deadline, s, k))))


def slots(docs: DataFrame, names: list[str], fluid: Fluid, shift: int, chunk_slots: int) -> DataFrame:
    """(source, block, slot): the slot of every block, from ``shift`` on."""
    spark = docs.sparkSession
    size = max(chunk_slots, 64 * len(names))  # what is handed on is then a small part of all blocks
    chunks = -(-fluid.total // size)
    shared = spark.sparkContext.broadcast((names, fluid))
    at = spark.range(0, chunks, 1, min(chunks, 4096)).withColumnRenamed("id", "chunk")
    most = 2 * len(names) + 2

    def ends(batches: Iterator[dict]) -> Iterator[dict]:
        fluid = shared.value[1]
        for x in batches:
            for c in x["chunk"]:
                start, stop = c * size, min((c + 1) * size, fluid.total)
                made, left = earliest(fluid.jobs(start, stop), start, stop)
                last = heapq.nlargest(most, (j for _, j in made))
                yield {"chunk": [c], "free": [stop - start - len(made)], "last": [list(map(list, last))], "over": [list(map(list, left))]}

    carried: list[np.ndarray] = []
    carry: list[tuple] = []
    if chunks > 1:
        found = written(map_arrow(at, ends, "chunk long, free long, last array<array<long>>, over array<array<long>>"), "mix-chunks")
        for r in found.orderBy("chunk").toLocalIterator():
            carried.append(np.array(carry, np.int64).reshape(-1, 3))
            # a block handed on may take any slot of the chunk, so the latest of both are those that stay over
            over = max(0, len(carry) - r.free)
            if over > len(r["last"]) and len(r["last"]) == most:
                raise AssertionError("more blocks handed on than sources allow")
            both = sorted([*carry, *map(tuple, r["last"])])
            carry = (both[len(both) - over :] if over else []) + list(map(tuple, r["over"]))
    else:
        carried.append(np.zeros((0, 3), np.int64))
    sent = spark.sparkContext.broadcast(carried)

    def rows(batches: Iterator[dict]) -> Iterator[dict]:
        names, fluid = shared.value
        for x in batches:
            for c in x["chunk"]:
                start, stop = c * size, min((c + 1) * size, fluid.total)
                held = [(start, *j) for j in sent.value[c].tolist()]
                made, _ = earliest(held + fluid.jobs(start, stop), start, stop)
                for i in range(0, len(made), 1 << 16):
                    part = made[i : i + (1 << 16)]
                    yield {"source": [names[j[1]] for _, j in part], "block": [j[2] for _, j in part], "slot": [t + shift for t, _ in part]}

    return map_arrow(at, rows, "source string, block long, slot long")


def numbered(docs: DataFrame, group: str, key: Column) -> DataFrame:
    """``docs`` with _rank: place from 0 within ``group`` in hash order of ``key``, equal rows in any order.

    A group is cut at its leading hash digits into runs of about ``RUN_ROWS`` rows, so that no task sorts a whole group.
    """
    docs = docs.withColumn("_h", F.xxhash64(key, F.lit("mix")))
    size = docs.groupBy(group).agg(F.count("*").alias("_n"))
    # leading hash digits, as many as the group is large; the row count of a group only sets how finely it is cut
    cut = docs.join(size, group).withColumn("_run", F.floor((F.col("_h") / F.lit(2.0**64) + 0.5) * F.ceil(F.col("_n") / F.lit(RUN_ROWS))))
    cut = written(cut.drop("_n"), "mix-runs")
    runs = cut.groupBy(group, "_run").agg(F.count("*").alias("_n"))
    before = runs.withColumn("_before", F.sum("_n").over(Window.partitionBy(group).orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)))
    place = F.row_number().over(Window.partitionBy(group, "_run").orderBy("_h", key))
    return cut.withColumn("_place", place).join(before.drop("_n"), [group, "_run"]).withColumn("_rank", F.col("_place") - 1 + F.coalesce("_before", F.lit(0))).drop("_place", "_before", "_run", "_h")


def tempered(docs: DataFrame, source: str = "source", power: float = 0.5) -> dict[str, float]:
    """Targets in proportion to a power of each source's rows; one number a source comes to the driver."""
    name = F.coalesce(F.col(source).cast("string"), F.lit(NULL)).alias("source")
    return {r.source: r["count"] ** power for r in docs.groupBy(name).count().toLocalIterator()}


def mix(docs: DataFrame, weights: dict[str, float] | None = None, *, key: str = "doc_id", source: str = "source",
        block_rows: int = BLOCK_ROWS, resolution: int | None = None, chunk_slots: int = CHUNK_SLOTS) -> DataFrame:
    """Per row of ``docs``: ``key``, ``source``, block (from 0 within the source), slot, position.

    ``weights`` gives targets by source (default: equal); ``resolution`` rounds them to whole shares first, if given.
    Sources without a positive target come last, by natural share. A null source is a source of its own. All rows are
    kept, repeated rows included; a null key is placed like any other. An empty table gives no rows. Positions order
    the whole table; they have gaps where a last block is short. The driver holds a few numbers a source and, for each
    chunk of slots, about one block a source. ``chunk_slots`` does not change the result.
    """
    name = NULL
    few = docs.select(F.col(key).alias("key"), F.coalesce(F.col(source).cast("string"), F.lit(name)).alias("source"))
    ranked = numbered(few, "source", F.col("key"))
    block = ranked.select("key", "source", F.floor(F.col("_rank") / block_rows).alias("block"), (F.col("_rank") % block_rows).alias("inner"))
    blocks = {r.source: -(-r.n // block_rows) for r in few.groupBy("source").agg(F.count("*").alias("n")).toLocalIterator()}
    aim = {s: 1.0 if weights is None else float(weights.get(s, 0.0)) for s in blocks}
    main = sorted(s for s in blocks if aim[s] > 0)
    rest = sorted(s for s in blocks if not aim[s] > 0)
    if resolution is not None and main:
        aim = shares({s: aim[s] for s in main}, max(resolution, len(main)))
    plan, shift = None, 0
    for names, pace in ((main, aim), (rest, blocks)):
        if names:
            fluid = Fluid(np.array([blocks[s] for s in names], np.int64), np.array([pace[s] for s in names], np.float64))
            part = slots(docs, names, fluid, shift, chunk_slots)
            plan = part if plan is None else plan.unionAll(part)
            shift += fluid.total
    if plan is None:
        plan = docs.sparkSession.createDataFrame([], "source string, block long, slot long")
    out = block.join(plan.hint("shuffle_hash"), ["source", "block"])
    return out.select(
        F.col("key").alias(key), F.nullif("source", F.lit(name)).alias(source), "block", "slot", (F.col("slot") * block_rows + F.col("inner")).alias("position")
    )
