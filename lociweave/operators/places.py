"""Places in a long order, and overlapping windows along it, without one task that sees all of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def placed(rows: DataFrame, by: list[str], at: str, place: str = "place", width: int = 100_000) -> DataFrame:
    """``rows`` with ``place``: 0, 1, ... in each group in the order of the whole number ``at``, which is different in all rows of a group.

    Rows are ranked in stretches of ``width`` numbers, and a running sum over the stretches'
    counts gives each its first place: a task holds a stretch, and a group's stretches are a
    short list however long the group is.
    """
    cut = rows.withColumn("_stretch", F.floor(F.col(at) / width))
    sizes = cut.groupBy(*by, "_stretch").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*by).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    first = sizes.select(*by, "_stretch", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    own = F.row_number().over(Window.partitionBy(*by, "_stretch").orderBy(at)) - 1
    return cut.withColumn("_own", own).join(first, [*by, "_stretch"]).withColumn(place, (F.col("_first") + F.col("_own")).cast("bigint")).drop("_stretch", "_first", "_own")


def windows_of(place: Column, size: int, step: int) -> Column:
    """The windows that hold a place: window w covers the places from ``w * step``, ``size`` of them."""
    last = F.floor(place / step)
    first = F.greatest(F.ceil((place - size + 1) / step), F.lit(0))
    return F.when(first <= last, F.sequence(first.cast("bigint"), last.cast("bigint"))).otherwise(F.array().cast("array<bigint>"))
