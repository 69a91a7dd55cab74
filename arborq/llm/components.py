"""Connected components of a link table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stage


def _to_smallest(edges: DataFrame, own: bool) -> DataFrame:
    """edges (u, v): each v, and u itself where ``own``, linked to the smallest of u and all its v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = edges.join(least, "u")
    out = joined.select(F.col("v").alias("u"), F.col("m").alias("v"))
    if own:
        out = out.unionByName(least.select("u", F.col("m").alias("v")))
    return out.filter("u != v").distinct()


def components(links: DataFrame, stage: Stage) -> DataFrame:
    """(node, label): the smallest node that each linked node reaches. ``links`` has u and v, in any order, repeats allowed.

    The rounds stop when no edge changes; their number grows with the logarithm of the longest chain.
    Only sums of hashes come to the driver. Nodes without a link have no row.
    """
    mark = lambda e: e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    edges = stage.table(links.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    was, now = None, mark(edges)
    while now != was and now[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        after = stage.table(_to_smallest(large, own=True))
        stage.drop(edges)
        edges, was, now = after, now, mark(after)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
