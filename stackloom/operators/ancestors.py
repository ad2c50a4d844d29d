"""Sums along the path from each tree node up to the root."""

from pyspark.sql import DataFrame, functions as F

from stackloom.session import cut_lineage


def sum_over_ancestors(nodes: DataFrame) -> DataFrame:
    """Per node, ``total`` = its weight plus that of all ancestors below the root.

    ``nodes``: node_id, parent_id, depth (1 = child of the root), weight. A node
    is left out if any of its ancestors is missing.

    Each round doubles the distance covered, so a tree of height h takes log2(h)
    joins of the node table with itself. Nodes that have reached the root drop
    out of the join: no round gathers all nodes at the few ids near the root.
    """
    state = cut_lineage(nodes.select("node_id", F.col("parent_id").alias("above"), "depth", F.col("weight").alias("total")))
    height = state.agg(F.max("depth")).first()[0] or 0
    hops = 1
    while hops < height:
        reached = state.select(F.col("node_id").alias("above"), F.col("above").alias("further"), F.col("total").alias("more"))
        moved = state.where(F.col("depth") > hops).join(reached, "above").select(
            "node_id", F.col("further").alias("above"), "depth", (F.col("total") + F.col("more")).alias("total"))
        state = cut_lineage(state.where(F.col("depth") <= hops).unionByName(moved))
        hops *= 2
    return state.select("node_id", "total")
