"""Connected components by repeated contraction of the edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wikispark.llm.common import materialise


def components(edges: DataFrame) -> DataFrame:
    """(a, b) → (node, root): the smallest node reachable from each node that has an edge.

    Every round each node hooks to the smallest of its neighbours and itself, the hooks are followed one step further,
    and edges are rewritten between what the nodes hook to. Edges inside one component vanish, so the table shrinks by
    at least about half a round; only the number of edges left comes to the driver. Self-loops and repeats are allowed.
    """
    left = materialise(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "edges")
    labels = materialise(left.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("root", F.col("node")), "labels")
    while left.limit(1).count():
        both = left.select("a", "b").unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = materialise(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("x"), F.least("a", "m").alias("p")), "hooks")
        up = hooks.select(F.col("x").alias("p"), F.col("p").alias("pp"))
        hooks = materialise(hooks.join(up, "p", "left").select("x", F.coalesce("pp", "p").alias("p")), "hooks")
        labels = materialise(labels.join(hooks, labels["root"] == hooks["x"], "left").select("node", F.coalesce("p", "root").alias("root")), "labels")
        to_a, to_b = hooks.select(F.col("x").alias("a"), F.col("p").alias("pa")), hooks.select(F.col("x").alias("b"), F.col("p").alias("pb"))
        moved = left.join(to_a, "a").join(to_b, "b").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b"))
        left = materialise(moved.where("a < b").distinct(), "edges")
    return labels
