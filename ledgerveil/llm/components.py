"""Distributed union-find over a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerveil.session import materialize


def components(links: DataFrame, purpose: str = "links") -> DataFrame:
    """(node, root) for every node of ``links`` (a, b: hash-like longs); nodes reachable from each other share a root.

    Every round hooks each node to its smallest neighbour and contracts the links to the hooks' targets. Ids are
    hashes, so in any graph, chains and stars included, a constant share of the nodes is gone after a round. Each
    round is written and read back; minima are combined before the shuffle, so a node of many links is no hot key.
    Self-links and repeated links are harmless; without links there are no rows.
    """
    links = materialize(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), purpose)
    labels = None
    while True:
        ends = links.select(F.col("a").alias("node"), F.col("b").alias("other")).unionAll(links.select("b", "a"))
        hook = materialize(ends.groupBy("node").agg(F.min("other").alias("other")).select("node", F.least("node", "other").alias("up")), purpose)
        if labels is None:
            labels = hook.select("node", F.col("up").alias("root"))
        else:
            up = hook.select(F.col("node").alias("root"), "up")
            labels = materialize(labels.join(up, "root", "left").select("node", F.coalesce("up", "root").alias("root")), purpose)
        left, right = hook.select(F.col("node").alias("a"), F.col("up").alias("x")), hook.select(F.col("node").alias("b"), F.col("up").alias("y"))
        moved = links.join(left, "a").join(right, "b").where("x <> y")
        links = materialize(moved.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), purpose)
        if links.isEmpty():
            return labels
