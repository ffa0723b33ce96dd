"""Connected components of a graph of links, in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickloom.session import materialize


def components(edges: DataFrame) -> DataFrame | None:
    """(node, root) of every node with an edge (u, v); nodes with the same root are connected. None without edges.

    Each round hooks every node to its least neighbour, follows the hooks one step further, and contracts the edges. Nodes
    are hashes, so their order is random and each round leaves a fraction of them. Rounds cut their lineage by a written
    table; nothing is collected.
    """
    edges = materialize(edges.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "edges")
    labels = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        hook = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("p"))
        hook = materialize(hook, "hooks")
        further = hook.select(F.col("u").alias("p"), F.col("p").alias("pp"))
        hook = materialize(hook.join(further, "p").select("u", F.col("pp").alias("p")), "hooks")
        if labels is None:
            labels = hook.withColumnsRenamed({"u": "node", "p": "root"})
        else:
            step = hook.withColumnsRenamed({"u": "root"})
            labels = labels.join(step, "root", "left").select("node", F.coalesce("p", "root").alias("root"))
        labels = materialize(labels, "labels")
        a, b = hook.select("u", F.col("p").alias("a")), hook.select(F.col("u").alias("v"), F.col("p").alias("b"))
        moved = edges.join(a, "u").join(b, "v").where("a <> b")
        edges = materialize(moved.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct(), "edges")
    return labels
