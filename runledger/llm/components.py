"""Connected components of an edge table, in rounds of hooking, pointer doubling and contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runledger.session import cut_to_table


def components(edges: DataFrame) -> DataFrame:
    """Rows (node, root) of all nodes of the edges (a, b) (64-bit numbers); root is a node of the component.

    In a round every node hooks to its smallest smaller neighbour, chains are doubled until they end
    at roots, and the edges between roots go to the next round. At least half of the roots vanish in
    each round. Hooking is an aggregate; no component is gathered in one place.
    """
    low, high = F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
    edges = cut_to_table(edges.where("a <> b").select(low, high).distinct())
    found = cut_to_table(edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct().withColumn("root", F.col("node")))
    while edges.head(1):
        hook = cut_to_table(edges.groupBy(F.col("b").alias("child")).agg(F.min("a").alias("parent")))
        while True:
            up = hook.select(F.col("child").alias("mid"), F.col("parent").alias("above"))
            step = cut_to_table(hook.join(up, hook.parent == up.mid, "left").select("child", "parent", F.coalesce("above", "parent").alias("next")))
            hook = step.select("child", F.col("next").alias("parent"))
            if not step.where("next <> parent").head(1):
                break
        root = lambda k: hook.select(F.col("child").alias(f"{k}_child"), F.col("parent").alias(f"{k}_root"))
        edges = cut_to_table(
            edges.join(root("a"), F.col("a") == F.col("a_child"), "left").join(root("b"), F.col("b") == F.col("b_child"), "left")
            .select(F.coalesce("a_root", "a").alias("x"), F.coalesce("b_root", "b").alias("y")).where("x <> y")
            .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
        found = cut_to_table(found.join(hook, found.root == hook.child, "left").select("node", F.coalesce("parent", "root").alias("root")))
    return found
