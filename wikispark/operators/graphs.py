"""Loops of joins over edge tables: components, roots, strongly connected edges. Each round is materialised by a reliable
checkpoint and one small count decides whether to go on."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def own_folder(spark: SparkSession) -> str:
    """A temporary folder for a session on one machine; on a cluster, whose machines would each write their own, an error."""
    if not spark.conf.get("spark.master", "").split("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"file://{tempfile.mkdtemp(prefix='spark-wikispark-')}"


def settle(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a checkpoint in the folder that spark.checkpoint.dir names."""
    spark: SparkSession = df.sparkSession
    if not (spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getCheckpointDir()):
        spark.sparkContext.setCheckpointDir(own_folder(spark))
    return df.checkpoint()


def numbered(df: DataFrame, order: list[str], name: str = "no") -> DataFrame:
    """+ name: row numbers from 0 in the given order over all rows, without bringing them into one task.

    Rows are sorted by ranges and numbered within each range; ranges are then offset by the sizes of those before them.
    Numbers are long.
    """
    ranged = settle(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_n"))  # one row for each partition
    before = F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    own = F.row_number().over(W.partitionBy("_part").orderBy(*order)) - 1
    return ranged.withColumn("_own", own).join(sizes.select("_part", before.alias("_before")), "_part").withColumn(name, F.col("_own") + F.col("_before")).drop("_part", "_own", "_before")


def connected(edges: DataFrame) -> DataFrame:
    """(a, b) → (node, root): the smallest node of each component, by contraction of edges."""
    left = settle(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct())
    labels = settle(left.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("root", F.col("node")))
    while left.limit(1).count():
        both = left.select("a", "b").unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("x"), F.least("a", "m").alias("p"))
        hooks = settle(hooks)
        labels = settle(labels.join(hooks, labels["root"] == hooks["x"], "left").select("node", F.coalesce("p", "root").alias("root")))
        to_a, to_b = hooks.select(F.col("x").alias("a"), F.col("p").alias("pa")), hooks.select(F.col("x").alias("b"), F.col("p").alias("pb"))
        left = settle(left.join(to_a, "a").join(to_b, "b").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).where("a < b").distinct())
    return labels


def _follow(edges: DataFrame, on: DataFrame) -> DataFrame:
    """edges(a, b), on(a, b, x, y: the only edge that follows) → (a, b, x, y) with (x, y) the last edge of the chain of each.

    Pointers double: a chain of any length is followed in a logarithm of it. What still has a next edge after that lies on
    a ring, all of whose nodes have one edge in and one out; its edges get null.
    """
    state = settle(on)
    for _ in range(max(1, edges.count()).bit_length() + 1):
        ahead = state.select(F.col("a").alias("ka"), F.col("b").alias("kb"), F.col("x").alias("fx"), F.col("y").alias("fy"))
        joined = state.join(ahead, (F.col("x") == F.col("ka")) & (F.col("y") == F.col("kb")), "left")
        state = settle(joined.select("a", "b", F.coalesce("fx", "x").alias("x"), F.coalesce("fy", "y").alias("y"), F.col("fx").isNotNull().alias("moved")))
        if not state.where("moved").limit(1).count():
            return edges.join(state.select("a", "b", "x", "y"), ["a", "b"], "left").select("a", "b", F.coalesce("x", "a").alias("x"), F.coalesce("y", "b").alias("y"))
    ring = state.select("a", "b", F.when(~F.col("moved"), F.col("x")).alias("x"), F.when(~F.col("moved"), F.col("y")).alias("y"), F.lit(True).alias("chained"))
    return edges.join(ring, ["a", "b"], "left").select("a", "b", F.when(F.col("chained"), F.col("x")).otherwise(F.col("a")).alias("x"), F.when(F.col("chained"), F.col("y")).otherwise(F.col("b")).alias("y"))


def _contract(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct edges (a, b) without loops → (chains(a, b, from_a, to_b), dead ends left out), one step of rake and compress.

    Edges at nodes without predecessors or successors go: none of them lies on a cycle. Of the rest, runs of edges through
    nodes with one edge in and one out become one edge from the first node to the last; rings get null ends.
    """
    tails, heads = edges.select(F.col("a").alias("b")).distinct(), edges.select(F.col("b").alias("a")).distinct()
    edges = settle(edges.join(tails, "b", "left_semi").join(heads, "a", "left_semi").select("a", "b"))
    out = edges.groupBy(F.col("a").alias("v")).agg(F.count("*").alias("outs"), F.first("b").alias("next"))
    into = edges.groupBy(F.col("b").alias("w")).agg(F.count("*").alias("ins"))
    inner = out.join(into, out["v"] == into["w"]).where("outs = 1 AND ins = 1").select("v", "next")
    inner = settle(inner)
    on = edges.join(inner, edges["b"] == inner["v"]).select("a", "b", F.col("b").alias("x"), F.col("next").alias("y"))
    if not inner.limit(1).count():
        return edges.select("a", "b", F.col("a").alias("from_a"), F.col("b").alias("to_b")), edges
    last = settle(_follow(edges, on))
    start = last.join(inner, last["a"] == inner["v"], "left_anti").select(F.col("a").alias("from_a"), "x", "y")
    chains = last.join(start, ["x", "y"], "left").select("a", "b", "from_a", F.when(F.col("from_a").isNotNull(), F.col("y")).alias("to_b"))
    return settle(chains), edges


def _spread(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """labels(node, color): each node takes the smallest color among itself and what reaches it along edges(a → b), to a fixpoint."""
    while True:
        via = edges.join(labels, edges["a"] == labels["node"]).groupBy(F.col("b").alias("n")).agg(F.min("color").alias("c"))
        new = settle(labels.join(via, labels["node"] == via["n"], "left").select("node", F.least("color", "c").alias("color"), (F.col("c") < F.col("color")).alias("moved")))
        labels = new.select("node", "color")
        if not new.where("moved").limit(1).count():
            return labels


def _core_cycles(edges: DataFrame) -> DataFrame:
    """Cycle edges of a graph that contraction leaves as it is.

    Colors spread forward from many pivots at once (the smallest node that reaches each node), and backward within a color
    from its namesake: what both reach is one component. What is left between and beside them goes on.
    """
    nodes = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    color = _spread(nodes.withColumn("color", F.col("node")), edges)
    ca, cb = color.select(F.col("node").alias("a"), F.col("color").alias("ca")), color.select(F.col("node").alias("b"), F.col("color").alias("cb"))
    inside = settle(edges.join(ca, "a").join(cb, "b").where("ca = cb"))
    back = _spread(color.withColumn("color", F.when(F.col("node") == F.col("color"), 0).otherwise(1)), inside.select(F.col("b").alias("a"), F.col("a").alias("b")))
    core = settle(back.where("color = 0").select("node"))
    found = inside.join(core, inside["a"] == core["node"], "left_semi").join(core, inside["b"] == core["node"], "left_semi").select("a", "b")
    rest = settle(inside.join(core, inside["a"] == core["node"], "left_anti").join(core, inside["b"] == core["node"], "left_anti").select("a", "b"))
    return settle(found.unionByName(cycle_edges(rest))) if rest.limit(1).count() else settle(found)


def cycle_edges(edges: DataFrame) -> DataFrame:
    """Edges (a, b) of a directed graph with both ends in one strongly connected component, self-loops included.

    Dead ends go and chains become one edge, again and again, so that long paths and rings cost a logarithm of their length
    (`_contract`); chains that close are cycles. Colors spread over the core that stays, and what is found there is carried
    back to the edges that chains stand for.
    """
    edges = settle(edges.select("a", "b").distinct())
    n, steps = edges.count(), []
    loops = [edges.where("a = b")]
    rest = edges.where("a <> b")
    while True:
        chains, kept = _contract(rest)
        m = kept.count()
        if not m:
            break
        steps.append(chains)
        rest = settle(chains.where("from_a <> to_b").select(F.col("from_a").alias("a"), F.col("to_b").alias("b")).distinct())
        left = rest.count()
        settled, n = left > 0.9 * n, left  # little was left to contract
        if settled or not left:
            break
    found = _core_cycles(rest) if steps and n else edges.where("false")
    for chains in reversed(steps):  # a chain is on a cycle if its ends are one node, if it is a ring, or if its edge is
        up = found.select(F.col("a").alias("from_a"), F.col("b").alias("to_b"), F.lit(True).alias("on"))
        found = settle(chains.join(up, ["from_a", "to_b"], "left").where("`on` OR from_a IS NULL OR from_a = to_b").select("a", "b"))
    return loops[0].unionByName(found).distinct()


def top_ancestors(parents: DataFrame) -> DataFrame:
    """(slug, parent) → (slug, top): the top-most id reachable by parents, even if it has no row; pointer jumping.

    After log2(n) + 1 rounds only what leads into a cycle of parents still has a parent: its top is the cycle's smallest id.
    """
    top = settle(parents.where(F.col("parent").isNotNull()).groupBy("slug").agg(F.min("parent").alias("top")).withColumn("low", F.col("top")))
    for _ in range(top.count().bit_length() + 1):
        up = top.select(F.col("slug").alias("u"), F.col("top").alias("t"), F.col("low").alias("l"))
        new = settle(top.join(up, top["top"] == up["u"], "left").select("slug", F.coalesce("t", "top").alias("top"), F.least("low", "l").alias("low"), F.col("t").isNotNull().alias("moved")))
        top = new.select("slug", "top", "low")
        if not new.where("moved").limit(1).count():
            return top.select("slug", "top")
    cycle = top.select(F.col("slug").alias("u"), F.col("low").alias("least"))
    return top.join(cycle, top["top"] == cycle["u"], "left").select("slug", F.coalesce("least", "top").alias("top"))
