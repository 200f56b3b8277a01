"""Connected components of a pair table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wareweave.llm.common import checkpoint


def _least_neighbour(edges: DataFrame) -> DataFrame:
    """(u, v, m): each edge with the least of u and its neighbours.

    A node with very many neighbours is pre-aggregated for m; the join back is a plain
    inner join, which adaptive execution splits where one node's edges fill a task.
    """
    least = edges.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return edges.join(least, "u")


def components(pairs: DataFrame) -> DataFrame:
    """(node, root) for every node of the two-column pair table, roots included.

    root is the least node of the component. Each round cuts the lineage with a
    reliable checkpoint, and the rounds end when one leaves the set of edges as it was.
    """
    a, b = pairs.columns
    edges = checkpoint(
        pairs.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct()
    )
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _least_neighbour(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = _least_neighbour(large.filter("u <> v").distinct())
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            small.select("u", F.col("m").alias("v"))
        )
        before, edges = edges, checkpoint(small.filter("u <> v").distinct())
        # both are sets, so equal sizes and no new edge mean the same edges
        if before.count() == edges.count() and edges.join(before, ["u", "v"], "left_anti").isEmpty():
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
