"""Connected components of a graph too large for one machine: alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """node and comp (the least node reachable) for each node of edges (u, v: long), as a table; single nodes have no edges.

    Each step ends as a table in the shared folder. A node's neighbours are only ever reduced to their minimum, before
    the shuffle as well as after; a node with very many of them is split by AQE where it is joined.
    """
    e = edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    table = cut(e, "edges")
    before = None
    while (now := _mark(table)) != before:
        before, e = now, table
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        # Large star: greater neighbours go to the least of the neighbourhood.
        e = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        # Small star: lesser neighbours, and the node itself, go to the least.
        least = e.groupBy("u").agg(F.min("v").alias("m"))
        joined = e.join(least, "u")
        e = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        last, table = table, cut(e.filter("u <> v").distinct(), "edges")
        drop(last)
    roots = table.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct()
    found = cut(table.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(roots), "components")
    drop(table)
    return found
