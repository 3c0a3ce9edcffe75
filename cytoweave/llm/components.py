"""Connected components of a link table by hooking and contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) of each node in ``links`` (columns a, b); component: smallest node.

    Each round every node is hooked to its smallest neighbour, whether that is
    smaller than itself or not; hooks form trees whose top is a pair of nodes
    hooked to each other, the smaller of which is the smallest of its tree.
    Pointer jumping brings all nodes of a tree to it, and trees are contracted to
    single nodes.  A tree has two nodes at least, so rounds are at most the
    logarithm of the nodes, and so are a round's jumps, whatever the links' shape.
    Each step is written to the shared folder; nothing but whether there is more
    comes to the driver.  A hub's neighbours are aggregated where they are before
    they are shuffled.
    """
    edges = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a is not null and b is not null").distinct()
    rounds = []
    while True:
        edges = materialise(edges, "edges")
        if rounds and edges.isEmpty():
            break
        rounds.append(_tops(edges))
        # each root is looked up by nodes of the edges' ends; inside a tree nothing is left
        a, b = rounds[-1].toDF("a", "top_a"), rounds[-1].toDF("b", "top_b")
        edges = edges.filter("a <> b").join(a, "a").join(b, "b").filter("top_a <> top_b").select(F.col("top_a").alias("a"), F.col("top_b").alias("b")).distinct()
    found = rounds.pop()
    while rounds:
        above = found.toDF("top", "component")
        found = materialise(rounds.pop().join(above, "top", "left").select("node", F.coalesce("component", "top").alias("top")), "components")
    return found.toDF("node", "component")


def _tops(edges: DataFrame) -> DataFrame:
    """(node, top) of each node: the smallest node of the tree that its hook leads to."""
    hooks = edges.groupBy("a").agg(F.coalesce(F.min(F.when(F.col("a") != F.col("b"), F.col("b"))), F.col("a")).alias("top")).withColumnRenamed("a", "node")
    hooks, first = materialise(hooks, "hooks"), True
    while True:
        ahead = hooks.toDF("_node", "_top")
        next_ = F.when(F.col("_top") == F.col("node"), F.least("node", "top")).otherwise(F.col("_top")) if first else F.col("_top")
        moved = materialise(hooks.join(ahead, F.col("top") == F.col("_node")).select("node", F.col("top").alias("old"), next_.alias("top")), "hooks")
        hooks, first = moved.select("node", "top"), False
        if moved.filter("old <> top").isEmpty():
            return hooks
