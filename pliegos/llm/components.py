"""Connected components of an edge table, by alternating large-star and small-star steps.

Each step moves edges towards the smallest neighbour. Hubs are met by map-side minima and
by joins whose skewed partitions Spark splits: for that the minima are written first, so that
both sides of a join are plain shuffles. Every round is written to the shared folder.

Defined results: edges from a node to itself and repeated edges change nothing; edges with a null end are left out; no edges give no rows;
ids are compared as they are, so that ties cannot occur; columns besides a and b are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import staged


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = staged(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("least")), "least")
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("least").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    least = staged(edges.groupBy("u").agg(F.min("v").alias("least")), "least")
    moved = edges.join(least, "u").where("v <> least").select(F.col("v").alias("u"), F.col("least").alias("v"))
    return moved.union(least.select("u", F.col("least").alias("v")))


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first())


def components(pairs: DataFrame) -> DataFrame:
    """From pairs (a, b) of comparable node ids to (node, root); the root is the smallest node and has no row."""
    edges = staged(
        pairs.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges"
    )
    before = _signature(edges)
    while before[0]:
        edges = staged(_small_star(_large_star(edges)).distinct(), "edges")
        after = _signature(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
