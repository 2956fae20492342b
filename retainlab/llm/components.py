"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retainlab.llm.runtime import cut


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """One contraction: every node hands its neighbours to its least neighbour.

    large: both directions, the greater neighbours move; small: only edges to lesser
    nodes count, and the node itself moves with them.
    """
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v")
    if not small:
        down = down.unionByName(down.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = down.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
    moved = down.join(least, "u")
    if small:
        rest = moved.select(F.col("v").alias("a"), F.col("m").alias("b"))
        return rest.unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).where("a != b").distinct()
    return moved.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a != b")


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root): the least node each node of ``edges`` (a, b) reaches.  Nodes without edges have no row.

    Every round halves the tree heights at least, so the number of rounds is logarithmic in
    the longest path; a round aggregates before it shuffles, so hubs are no hot task.
    """
    now, was = cut(edges.select("a", "b").where("a != b").distinct()), None
    for _ in range(max_rounds):
        now = cut(_star(_star(now, small=False), small=True))
        # a fixed point is a set of stars: equal checksums of the edge sets
        state = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b") % (1 << 40))).first())
        if state == was:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
                now.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
        was = state
    raise RuntimeError(f"no fixed point after {max_rounds} rounds")
