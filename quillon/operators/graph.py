"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.core.scratch import stored


def connected_components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(a, b) edges of comparable ids -> (node, root): each node's component, named by its least node.

    Large-star and small-star steps by turns: every node links its greater neighbours to its least one, then its
    smaller neighbours and itself to the least of them, until nothing changes. The rounds grow with the logarithm
    of the nodes; each round's edges are written, so that plans stay short.
    """
    ordered = edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    now = stored(ordered.distinct(), name)
    while True:
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        # a table of its own, so that Spark may split the side of a node with very many neighbours
        least = stored(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), f"{name}-least")
        large = both.join(least, "u").where("v > u").select(F.col("m").alias("a"), F.col("v").alias("b")).distinct()
        lowest = large.groupBy(F.col("b").alias("u")).agg(F.min("a").alias("m"))
        moved = large.join(lowest, F.col("b") == F.col("u")).where("m < a").select(F.col("m").alias("a"), F.col("a").alias("b"))
        after = stored(moved.unionAll(lowest.select(F.col("m").alias("a"), F.col("u").alias("b"))).distinct(), name)
        new, old = after.join(now, ["a", "b"], "left_anti"), now.join(after, ["a", "b"], "left_anti")
        now = after
        if new.isEmpty() and old.isEmpty():
            break
    roots = now.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct()
    return now.select(F.col("b").alias("node"), F.col("a").alias("root")).unionAll(roots)
