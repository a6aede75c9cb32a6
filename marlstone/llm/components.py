"""Connected components of a distributed graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .shared import stash


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label): the smallest node that each node of an undirected edge list reaches.

    Every round takes the least label of all neighbours (a partial aggregation, so a node with very many
    neighbours does not gather them) and then follows labels to their own labels, twice, which quarters the length
    of chains; the rounds grow with the logarithm of the longest. Each round's table is written to the shared
    folder, so lineage stays short and joins of two read tables can be split where one node is frequent.
    """
    both = edges.select(F.col(a).alias("a"), F.col(b).alias("b"))
    both = stash(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct(), "edges")
    labels = stash(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")), "labels")
    while True:
        near = both.join(labels, both["a"] == labels["node"]).groupBy(F.col("b").alias("node")).agg(F.min("label").alias("m"))
        lower = labels.join(near, "node").select("node", F.col("label").alias("was"), F.least("label", "m").alias("label"))
        lower = stash(lower, "labels")
        roots = lower.select(F.col("node").alias("label"), F.col("label").alias("root"))
        once = lower.join(roots, "label").select("node", "was", F.col("root").alias("label"))
        after = stash(once.join(roots, "label").select("node", F.col("root").alias("label"), (F.col("root") != F.col("was")).alias("moved")), "labels")
        moved = not after.filter("moved").isEmpty()
        labels = after.select("node", "label")
        if not moved:
            return labels
