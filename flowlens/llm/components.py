"""Connected components of an edge table by iterated joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.operators.common import drop_stored, materialize

MAX_ROUNDS = 60


def connected_components(edges: DataFrame, name: str = "components") -> DataFrame:
    """``edges(a, b)`` of long ids -> ``(node, label)``: the smallest id
    reachable, for every id in an edge.

    Each round gives a node the smallest label among its neighbours and then
    the label of its label (pointer jumping), so the rounds grow with the
    logarithm of a component's diameter. Minima are pre-aggregated before the
    shuffle, so a hub's edges do not meet in one task; the label table is
    unique by node, so Spark may split a hub's rows in the joins. Each round
    is written to the shared checkpoint folder. NULL ids are ignored.
    """
    spark = edges.sparkSession
    e = edges.where("a is not null and b is not null and a <> b")
    both = materialize(
        e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))),
        f"{name}-edges")
    labels = materialize(
        both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"))
        .select("node", F.least("node", "m").alias("label")), f"{name}-labels")
    stored = labels
    for _ in range(MAX_ROUNDS):
        seen = both.join(labels.select(F.col("node").alias("b"), "label"), "b") \
            .groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        lower = labels.join(seen, "node") \
            .select("node", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        lower = materialize(lower, f"{name}-lower")
        jump = lower.select(F.col("node").alias("label"), F.col("label").alias("root"))
        new = materialize(
            lower.join(jump, "label", "left")
            .select("node", "was", F.least("label", "root").alias("label")), f"{name}-labels")
        drop_stored(lower)
        drop_stored(stored)
        stored, labels = new, new.select("node", "label")
        if new.where("label <> was").isEmpty():
            drop_stored(both)
            return labels
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
