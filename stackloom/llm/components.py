"""Connected components of an edge table, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stackloom.llm.common import cut_lineage


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for each node of ``edges`` (a, b): label is the same within a component and differs between them.

    Each round maps every node to its least neighbour or itself, follows these steps down to where they end (doubling the
    number of steps at a time), and carries the edges over, until none is left. At least half of the nodes that still
    have edges go each round, so both loops grow as the logarithm of the size. Rounds are checkpointed.
    """
    edges = cut_lineage(edges.select("a", "b").filter("a <> b").distinct())
    labels = None
    while not edges.isEmpty():
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = cut_lineage(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"))
                            .select("node", F.least("node", "m").alias("to")))
        while True:  # every target is a node
            ahead = least.select(F.col("node").alias("to"), F.col("to").alias("next"))
            ahead = cut_lineage(least.join(ahead, "to").select("node", "to", "next"))
            least = ahead.select("node", F.col("next").alias("to"))
            if ahead.filter("next <> to").isEmpty():
                break
        left = least.select(F.col("node").alias("a"), F.col("to").alias("x"))
        right = least.select(F.col("node").alias("b"), F.col("to").alias("y"))
        edges = cut_lineage(edges.join(left, "a").join(right, "b").filter("x <> y")
                            .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
        step = least.select(F.col("node").alias("label"), "to")
        labels = cut_lineage(least.select("node", F.col("to").alias("label")) if labels is None else
                             labels.join(step, "label", "left").select("node", F.coalesce("to", "label").alias("label")))
    if labels is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return labels
