"""Connected components of a graph given by its edges, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import written


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One contraction: neighbours are linked to the smallest node of their star instead of its centre."""
    if large:
        out = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    else:
        out = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = out.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("_u"), F.least("u", "m").alias("m"))
    joined = out.join(least, F.col("u") == F.col("_u"))
    if large:
        linked = joined.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        linked = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select(F.col("_u").alias("a"), F.col("m").alias("b")))
    return linked.where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges`` (a, b); the root is the component's smallest node.

    Every round halves the distances at least, is written to the shared folder
    and compared with the round before by count and checksum.
    """
    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    current = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "components")
    before = state(current)
    while before[0]:
        current = written(_stars(_stars(current, True), False), "components")
        after = state(current)
        if after == before:
            break
        before = after
    # Now every edge leads from a node to its component's smallest.
    return current.select(F.col("a").alias("node"), F.col("b").alias("root")).union(current.select(F.col("b"), F.col("b"))).distinct()
