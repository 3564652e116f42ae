"""Connected components of an edge list by alternating large-star and small-star steps.

Every step is a minimum per node with map-side partial minima and a join back, so a
hub costs no task more than its share (the join's sides are plain exchanges, which
adaptive execution splits). Each step's edges are cut into the shared folder: the
lineage stays short and a lost executor costs one step.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociweave.llm.common import cut


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum((F.xxhash64("u", "v") % F.lit(1 << 40)).cast("decimal(38,0)"))).first()
    return row[0], row[1]


def _large(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = cut(both.groupBy(F.col("u").alias("w")).agg(F.least(F.min("v"), F.first("u")).alias("m")))
    return cut(both.filter("v > u").join(least, F.col("u") == F.col("w")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())


def _small(edges: DataFrame) -> DataFrame:
    least = cut(edges.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("m")))
    moved = edges.join(least, F.col("u") == F.col("w")).filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return cut(moved.union(least.select(F.col("w").alias("u"), F.col("m").alias("v"))).distinct())


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) of every node on an edge but the roots themselves; a root is its component's least node."""
    e = cut(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u != v").distinct())
    mark = _mark(e)
    while mark[0]:
        e = _small(_large(e))
        now = _mark(e)
        if now == mark:
            break
        mark = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
