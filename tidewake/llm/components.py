"""Connected components of a link table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewake.llm.workspace import Workspace


def _point_to_least(edges: DataFrame, larger_only: bool) -> DataFrame:
    """Every node tells its neighbours (the larger, or the smaller and itself) its least neighbour.

    Only a minimum per node is gathered, never a list of neighbours, so hubs combine map-side.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if larger_only else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
    told = both.join(least, both["a"] == least["u"])
    if larger_only:
        found = told.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        found = told.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return found.filter(F.col("a") != F.col("b")).distinct()


def connected_components(edges: DataFrame, work: Workspace, name: str = "components") -> DataFrame:
    """(a, b) integer links -> (node, component): each linked node with the least node it reaches.

    Nulls are not links, repeated links and loops count once; an empty table gives an empty one.
    Each round is written to the shared folder; rounds grow with the logarithm of the nodes.
    """
    now = work.save(edges.select("a", "b").filter("a != b").distinct(), f"{name}-0")
    before, k = None, 0
    while True:
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % (1 << 31))).collect()[0]
        if seen == before:
            break
        before, k = seen, k + 1
        starred = _point_to_least(now, larger_only=True)
        now = work.save(_point_to_least(starred, larger_only=False), f"{name}-{k}")
        work.drop(f"{name}-{k - 1}")
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots).distinct()
