"""Gapless ranks within groups, where one group may hold a large part of all rows.

A group is cut into ranges of its order at bounds that a distributed quantile sketch
gives; where one value of the order fills several ranges, these are cut by the hash of
the ties. Rows are counted by (group, range) with map-side partial sums; a running sum
over those few counts gives each range its first rank, and a window ranks the rows
of one range. No task sees a whole group, nor all rows of one order value unless
their ties are equal too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lociweave.llm.common import checked, opened, written

#: Rows that one range may hold, about, and the most and least ranges there are.
RANGE_ROWS = 1_000_000
MOST_RANGES = 10_000
LEAST_RANGES = 256


def insertion(bounds: list, value: Column) -> Column:
    """How many of ``bounds`` (ascending) are at most ``value``, by halving."""
    if not bounds:
        return F.lit(0)
    held = F.array(*[F.lit(b) for b in bounds])
    span = lambda lo, hi: F.struct(lo.cast("int").alias("lo"), hi.cast("int").alias("hi"))

    def halve(s: Column, _: Column) -> Column:
        mid = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        return F.when(s["lo"] >= s["hi"], s).when(F.get(held, mid) <= value, span(mid + 1, s["hi"])).otherwise(span(s["lo"], mid))

    steps = F.sequence(F.lit(1), F.lit(len(bounds).bit_length()))
    return F.aggregate(steps, span(F.lit(0), F.lit(len(bounds))), halve, lambda s: s["lo"])


def _ranges(keys: DataFrame, uniform: bool) -> tuple[int, list]:
    """How many ranges, and the quantiles between them (none where the order is a hash)."""
    n = keys.count()
    parts = min(MOST_RANGES, max(LEAST_RANGES, n // RANGE_ROWS))
    if uniform:
        return parts, []
    shares = [k / parts for k in range(1, parts)]
    return parts, keys.agg(F.percentile_approx("_order", shares, 10 * parts).alias("q")).first()["q"] or []


def ranked(rows: DataFrame, group: str, order: str, rank: str, ties: list[Column] | None = None, uniform: bool = False) -> DataFrame:
    """``rows`` with ``rank``: 0, 1, ... within each ``group`` by ``order`` (a number), then by the hash of ``ties``, then by ``ties``.

    Null orders come first, null groups are a group, and equal rows get different
    ranks in any order. ``rows`` must give the same rows each time it is computed.
    ``uniform`` says that ``order`` is a 64-bit hash, whose ranges need no look at it.
    A column of ``rows`` called like ``rank`` is replaced; all other names are free.
    """
    tie = F.xxhash64(*ties) if ties else F.lit(0).cast("bigint")
    held = rows.select(F.struct("*").alias("_row"), F.col(group).alias("_group"), F.col(order).alias("_order"), tie.alias("_tie"), F.struct(*(ties or [F.lit(0)])).alias("_ties"))
    parts, quantiles = _ranges(held.select("_order"), uniform)
    hashed = lambda c, n: F.floor((c.cast("double") + float(1 << 63)) / float(1 << 64) * n).cast("int")
    bounds = sorted(set(quantiles))
    # a value that stands at several quantiles fills as many ranges; it comes first in its range, as its lower bound
    full = [(q, quantiles.count(q)) for q in bounds if quantiles.count(q) > 1]
    at = hashed(F.col("_order"), F.lit(parts)) if uniform else insertion(bounds, F.col("_order"))
    sub = F.lit(LEAST_RANGES)
    if full:
        place = insertion([q for q, _ in full], F.col("_order")) - 1
        same = F.get(F.array(*[F.lit(q) for q, _ in full]), place) == F.col("_order")
        sub = F.when(same, hashed(F.col("_tie"), F.least(F.get(F.array(*[F.lit(k) for _, k in full]), place), F.lit(LEAST_RANGES)))).otherwise(LEAST_RANGES)
    nulls = F.col("_order").isNull()
    placed = held.withColumn("_at", F.when(nulls, F.lit(-1)).otherwise(at).cast("int")).withColumn("_sub", F.when(nulls, hashed(F.col("_tie"), F.lit(LEAST_RANGES))).otherwise(sub).cast("int"))
    counts = placed.groupBy(F.col("_group").alias("_g"), F.col("_at").alias("_a"), F.col("_sub").alias("_s")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("_g").orderBy("_a", "_s").rowsBetween(Window.unboundedPreceding, -1)
    # a row for each range of a group: where their number allows it, the rows need no second shuffle to meet them
    first = checked(written(counts.select("_g", "_a", "_s", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first")), "ranges"))
    within = Window.partitionBy("_group", "_at", "_sub").orderBy(F.col("_order").asc_nulls_first(), "_tie", "_ties")
    out = placed.withColumn("_in", F.row_number().over(within) - 1)
    out = out.join(first, F.col("_group").eqNullSafe(F.col("_g")) & (F.col("_at") == F.col("_a")) & (F.col("_sub") == F.col("_s")), "left")
    return opened(out, rows.columns, {rank: (F.col("_first") + F.col("_in")).cast("bigint")})
