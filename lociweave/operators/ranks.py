"""Running sums, ranks and rank tests over groups of any size: no task holds a group.

Equal values are counted together before anything is shuffled by group. The distinct
values of a group are cut into ranges at the bounds of a quantile sketch; a running sum
over the ranges' sums gives each range its start, and a window runs within one range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lociweave.functions import expr

#: Ranges that the distinct values of a group are cut into.
RANGES = 64


def _number(rows: DataFrame, at: str) -> Column:
    """A number in the order of ``at``, for the ranges alone: text gives its first seven bytes, anything else itself."""
    if dict(rows.dtypes)[at] != "string":
        return F.col(at)
    return F.conv(F.rpad(F.hex(F.substring(F.encode(F.col(at), "UTF-8"), 1, 7)), 14, "0"), 16, 10).cast("bigint")


def running(rows: DataFrame, by: list[str], at: str, sums: list[str], ranges: int = RANGES) -> DataFrame:
    """``rows``, one for each value ``at`` of a group, with ``before_x`` and ``all_x`` for each column x of ``sums``: what smaller values sum to, and all of the group.

    Nulls come first; a group or value may be null. An empty table stays empty.
    """
    place = _number(rows, at)
    bounds = rows.groupBy(*by).agg(F.percentile_approx(place, [k / ranges for k in range(1, ranges)], 10 * ranges).alias("_bounds"))
    same = lambda a, b, keys: [a[c].eqNullSafe(b[f"_{c}"]) for c in keys]
    named = lambda t, keys: t.withColumnsRenamed({c: f"_{c}" for c in keys})
    kept = named(bounds, by)
    # a row a group, which is broadcast where all are small; beyond that a hot group is split as a skewed join
    held = rows.join(kept, same(rows, kept, by)).drop(*[f"_{c}" for c in by])
    below = F.size(F.filter("_bounds", lambda b: b <= place))
    held = held.withColumn("_range", F.when(F.col(at).isNull(), -1).otherwise(F.coalesce(below, F.lit(0)))).drop("_bounds")
    part = held.groupBy(*by, "_range").agg(*[F.sum(c).alias(f"_s_{c}") for c in sums])
    up = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(*by)
    starts = part.select(*by, "_range", *[F.coalesce(F.sum(f"_s_{c}").over(up), F.lit(0)).alias(f"_b_{c}") for c in sums], *[F.sum(f"_s_{c}").over(every).alias(f"all_{c}") for c in sums])
    starts = named(starts, [*by, "_range"])
    # before the join, so that the window's sort serves one range and its key is what the join needs
    within = Window.partitionBy(*by, "_range").orderBy(F.col(at).asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    held = held.select("*", *[F.coalesce(F.sum(c).over(within), F.lit(0)).alias(f"_w_{c}") for c in sums])
    # "_range" was renamed to "__range"
    met = held.join(starts, [*same(held, starts, by), held["_range"] == starts["__range"]])
    return met.select(*rows.columns, *[(F.col(f"_b_{c}") + F.col(f"_w_{c}")).alias(f"before_{c}") for c in sums], *[f"all_{c}" for c in sums])


def mean_ranks(counts: DataFrame, by: list[str], at: str, n: str = "n") -> DataFrame:
    """``counts`` of each value with ``rank``, from 1, the mean over equal values, and ``all_n``."""
    return running(counts, by, at, [n]).withColumn("rank", F.col(f"before_{n}") + (F.col(n) + 1) / 2.0).drop(f"before_{n}")


def rank_correlation(rows: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    """(by, rho, n): Spearman's correlation with mean ranks for ties, from the counts of equal pairs.

    Nulls rank first. A group in which one side does not vary has a null ``rho``.
    """
    cells = rows.groupBy(*by, F.col(x).alias("_x"), F.col(y).alias("_y")).agg(F.count(F.lit(1)).alias("_n"))
    both = cells
    for v in ("_x", "_y"):
        counts = cells.groupBy(*by, v).agg(F.sum("_n").alias("n"))
        told = mean_ranks(counts, by, v).select(*[F.col(c).alias(f"_k_{c}") for c in by], F.col(v).alias("_v"), F.col("rank").alias(f"_r{v}"), F.col("all_n").alias(f"_a{v}"))
        both = both.join(told, [*[F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in by], F.col(v).eqNullSafe(F.col("_v"))]).drop(*[f"_k_{c}" for c in by], "_v")
    # ranks have a known mean, so their products lose no digits
    dx, dy = (F.col(f"_r{v}") - (F.col(f"_a{v}") + 1) / 2.0 for v in ("_x", "_y"))
    sums = both.groupBy(*by).agg(F.sum(F.col("_n") * dx * dy).alias("_xy"), F.sum(F.col("_n") * dx * dx).alias("_xx"), F.sum(F.col("_n") * dy * dy).alias("_yy"), F.sum("_n").alias("n"))
    return sums.select(*by, F.try_divide(F.col("_xy"), F.sqrt(F.col("_xx") * F.col("_yy"))).alias("rho"), "n")


def rank_sum_tests(rows: DataFrame, group: str, value: str, by: list[str]) -> DataFrame:
    """(by, group_1, group_2, u, pvalue): the rank-sum test of every two groups, by the normal law with tie and continuity corrections.

    A value's counts meet those of the other groups of its stratum, so rows grow with the
    groups, which are few, and not with pairs of values. Null values take no part.
    """
    counts = rows.filter(F.col(value).isNotNull() & F.col(group).isNotNull()).groupBy(*by, F.col(group).alias("_g"), F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    names = counts.groupBy(*[F.col(c).alias(f"_k_{c}") for c in by]).agg(F.collect_set("_g").alias("_all"))
    each = counts.join(names, [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in by]).drop(*[f"_k_{c}" for c in by])
    each = each.withColumn("_other", F.explode("_all")).filter(F.col("_other") != F.col("_g"))
    first = F.col("_g") < F.col("_other")
    cells = each.groupBy(*by, F.least("_g", "_other").alias("group_1"), F.greatest("_g", "_other").alias("group_2"), "_v").agg(F.sum(F.when(first, F.col("_n")).otherwise(0)).alias("n1"), F.sum(F.when(first, 0).otherwise(F.col("_n"))).alias("n2"))
    keys = [*by, "group_1", "group_2"]
    placed = running(cells, keys, "_v", ["n1", "n2"])
    ties = F.col("n1").cast("double") + F.col("n2")
    sums = placed.groupBy(*keys).agg(F.max("all_n1").cast("double").alias("_a"), F.max("all_n2").cast("double").alias("_b"), F.sum(F.col("n1") * (F.col("before_n2") + F.col("n2") / 2.0)).alias("u"), F.sum(ties * ties * ties - ties).alias("_t"))
    a, b = F.col("_a"), F.col("_b")
    spread = a * b / 12 * (a + b + 1 - F.col("_t") / F.greatest((a + b) * (a + b - 1), F.lit(1.0)))
    z = F.greatest(F.abs(F.col("u") - a * b / 2) - 0.5, F.lit(0.0)) / F.sqrt(spread)
    return sums.select(*keys, "u", F.when(spread <= 0, 1.0).otherwise(expr.two_sided(z)).alias("pvalue"))


def ks_distance(rows: DataFrame, a: Column, b: Column, value: str, by: list[str]) -> DataFrame:
    """(by, ks): the largest difference of two cumulative shares; ``a`` and ``b`` are a row's counts on either side, and a side without any gives null."""
    at = rows.groupBy(*by, F.col(value).alias("_v")).agg(F.sum(a).alias("na"), F.sum(b).alias("nb"))
    up = running(at, by, "_v", ["na", "nb"])
    share = lambda c: F.try_divide(F.col(f"before_{c}") + F.col(c), F.col(f"all_{c}"))
    return up.groupBy(*by).agg(F.max(F.abs(share("na") - share("nb"))).alias("ks"))


def accumulated(rows: DataFrame, by: str, at: str, value: str) -> DataFrame:
    """Running sum of ``value`` over the rows of a group in the order of ``at``, equal ones together."""
    summed = rows.groupBy(by, at).agg(F.sum(value).alias(value))
    return running(summed, [by], at, [value]).select(by, at, (F.col(f"before_{value}") + F.col(value)).alias(value))
