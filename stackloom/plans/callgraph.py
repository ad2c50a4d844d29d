"""Call graph: one row per function and one per caller-callee pair, and pruning of unimportant nodes."""

from pyspark.sql import Column, DataFrame, functions as F

from stackloom.functions.scalar import record
from stackloom.operators.aggregate import merge_items
from stackloom.operators.frames import frames
from stackloom.plans.listing import _adjacent
from stackloom.session import cut_lineage


KEY_FIELDS = ("symbolized", "name", "mapping_build_id", "address", "location")


def _node_key(f: Column) -> Column:
    location = F.concat(F.coalesce(f["mapping_build_id"], F.lit("")), F.lit("/0x"), F.lower(F.hex(f["address"])))
    return F.when(f["symbolized"], F.coalesce(f["name"], F.lit(""))).otherwise(location)


def _traversal(stack: str, outermost_first: bool) -> Column:
    """Frames leaf first; optionally with the lines of each location outermost first."""
    if not outermost_first:
        return frames(stack, KEY_FIELDS)
    return F.array_sort(frames(stack, (*KEY_FIELDS, "position")), lambda a, b: F.when(
        a["location"] != b["location"], a["location"] - b["location"]).otherwise(b["position"] - a["position"]))


def nodes(profile: DataFrame) -> DataFrame:
    """Per function or unsymbolised location: cumulative (per occurrence) and flat.

    Every line of the leaf location counts as flat. Largest cumulative first.
    """
    item = F.transform(frames("stacktrace", KEY_FIELDS), lambda f: record(
        node=_node_key(f), leaf=f["location"] == 0))
    return (
        merge_items(profile, item).select("value", F.inline("items")).groupBy("node")
        .agg(F.sum("value").alias("cumulative"), F.sum(F.when(F.col("leaf"), F.col("value")).otherwise(0)).alias("flat"))
        .orderBy(F.desc("cumulative"), "node")
    )


def edges(profile: DataFrame, outermost_first: bool = False) -> DataFrame:
    """Value that flows from each caller to each callee.

    ``outermost_first`` walks the lines of one location outermost first while
    walking locations leaf first, which links inlined lines the other way round.
    """
    merged = merge_items(profile, F.transform(_traversal("stacktrace", outermost_first), _node_key))
    return (
        merged.select("value", F.inline(_adjacent(F.col("items"))))
        .groupBy(F.col("caller").alias("source"), F.col("callee").alias("target"))
        .agg(F.sum("value").alias("cumulative"))
    )


def removable(nodes_: DataFrame, edges_: DataFrame, total: Column, fraction: float) -> DataFrame:
    """Small nodes with exactly one incoming and at least one outgoing edge, with that incoming edge."""
    small = nodes_.where(F.col("cumulative").cast("double") < total.cast("double") * F.lit(fraction).cast("float").cast("double"))
    incoming = edges_.groupBy("target").agg(F.count("*").alias("ins"), F.min("source").alias("parent"),
                                            F.sum("cumulative").alias("weight")).where("ins = 1")
    outgoing = edges_.select(F.col("source").alias("node")).distinct()
    return (
        small.select("node").join(incoming.withColumnRenamed("target", "node"), "node")
        .join(outgoing, "node", "left_semi").select("node", "parent", "weight")
    )


def prune(nodes_: DataFrame, edges_: DataFrame, total: Column, fraction: float = 0.005) -> tuple[DataFrame, DataFrame]:
    """Remove unimportant inner nodes and bridge the gaps.

    A removed node's edges to kept nodes become one collapsed edge from its
    nearest kept ancestor, weighing the incoming edges along the way. Ancestors
    are found by pointer jumping: each round doubles the hops, so a chain of
    length n takes log2(n) rounds, each a join on the small removable set.
    Nodes that only hang on a cycle of removable nodes have no kept ancestor
    and stay.
    """
    nodes_, edges_ = cut_lineage(nodes_), cut_lineage(edges_)
    chain = cut_lineage(removable(nodes_, edges_, total, fraction))
    # a chain node is open while its current ancestor is itself removable
    state = chain.select("node", F.col("parent").alias("anchor"), F.col("weight").alias("above"))
    limit = max(1, chain.count())
    hops = 1
    while hops < 2 * limit:
        n = state.select(F.col("node").alias("anchor"), F.col("anchor").alias("next"), F.col("above").alias("more"))
        state = cut_lineage(state.join(n, "anchor", "left").select(
            "node", F.coalesce("next", "anchor").alias("anchor"),
            F.try_add("above", F.coalesce("more", F.lit(0).cast("long"))).alias("above"), F.col("next").isNotNull().alias("open")))
        if state.where("open").isEmpty():
            break
        state = state.drop("open")
        hops *= 2
    members = chain.select(F.col("node").alias("anchor"))
    gone = state.select("node", "anchor", "above").join(members, "anchor", "left_anti")
    kept_nodes = nodes_.join(gone, "node", "left_anti")
    ids = gone.select("node")
    kept_edges = (
        edges_.join(ids.withColumnRenamed("node", "source"), "source", "left_anti")
        .join(ids.withColumnRenamed("node", "target"), "target", "left_anti")
        .select("source", "target", "cumulative", F.lit(False).alias("is_collapsed"))
    )
    bridged = (
        edges_.select(F.col("source").alias("node"), "target").join(gone, "node")
        .join(ids.withColumnRenamed("node", "target"), "target", "left_anti")
        .select(F.col("anchor").alias("source"), "target", F.col("above").alias("cumulative"),
                F.lit(True).alias("is_collapsed"))
    )
    return kept_nodes, kept_edges.unionByName(bridged)
