"""Connected components of a pair table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wareweave.session import checkpoint


def _towards_least(edges: DataFrame, larger_only: bool) -> DataFrame:
    """Each node's neighbours, and for the small star itself, tied to the least of them all."""
    least = edges.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    tied = edges.join(least, "u")
    if larger_only:
        return tied.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return tied.select(F.explode(F.array("v", "u")).alias("u"), F.col("m").alias("v"))


def components(pairs: DataFrame) -> DataFrame:
    """(node, root) for every node of a two-column table of pairs; root is the component's least node.

    The rounds end when one leaves the set of edges as it was; each is checkpointed.
    """
    a, b = pairs.columns
    links = lambda df: checkpoint(df.filter("u <> v").distinct())
    edges = links(pairs.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")))
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _towards_least(both, True).filter("u <> v").distinct()
        before, edges = edges, links(_towards_least(large, False))
        if before.count() == edges.count() and edges.join(before, ["u", "v"], "left_anti").isEmpty():
            break
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
