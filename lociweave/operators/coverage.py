"""Depth histograms, medians and usable-depth windows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lociweave.functions import expr

SITE = ("species", "contig", "pos")


def prevalent_sites(counts: DataFrame, least_depth: int = 3, share: float = 0.95, cohort: int | None = None) -> DataFrame:
    """Sites that at least ``share`` of the samples cover; ``cohort`` counts samples without a row as uncovered."""
    flag = F.when(F.col("depth") >= least_depth, 1.0).otherwise(0.0)
    passing = F.sum(flag) / F.lit(float(cohort)) if cohort else F.avg(flag)
    return counts.groupBy(*SITE).agg(passing.alias("prevalence")).filter(F.col("prevalence") >= share)


def depth_histogram(counts: DataFrame) -> DataFrame:
    return counts.groupBy("species", "sample", "depth").agg(F.count(F.lit(1)).alias("n"))


def filtered_depth_histogram(counts: DataFrame, least_depth: int = 3, share: float = 0.95, cohort: int | None = None) -> DataFrame:
    return depth_histogram(counts.join(prevalent_sites(counts, least_depth, share, cohort), list(SITE), "left_semi"))


def gene_coverage(annotated: DataFrame) -> DataFrame:
    return annotated.groupBy("species", "gene_id", "sample").agg(F.avg(F.col("depth").cast("double")).alias("mean_depth"), F.count(F.lit(1)).alias("n_sites"))


def histogram_quantile(hist: DataFrame, by: list[str], value: str, n: str, share: float = 0.5, strict: bool = False) -> DataFrame:
    """The lowest value whose cumulative share reaches (``strict``: passes) ``share``.

    The histogram of one group is small: its size is the number of distinct depths.
    """
    w = Window.partitionBy(*by).orderBy(value)
    cdf = F.sum(n).over(w) / F.sum(n).over(Window.partitionBy(*by))
    reached = F.col("_cdf") > share if strict else F.col("_cdf") >= share
    return hist.withColumn("_cdf", cdf).filter(reached).groupBy(*by).agg(F.min(value).alias("quantile"))


def nonzero_median(hist: DataFrame, by: list[str], value: str = "depth", n: str = "n", zeros: float = 0.8) -> DataFrame:
    """The median over values above zero; 0 if more than ``zeros`` of all are zero; a single bin is its own median."""
    stats = hist.groupBy(*by).agg(F.sum(n).alias("_all"), F.coalesce(F.sum(F.when(F.col(value) == 0, F.col(n))), F.lit(0)).alias("_zero"), F.count(F.lit(1)).alias("_bins"), F.max(value).alias("_only"))
    median = histogram_quantile(hist.filter(F.col(value) > 0), by, value, n)
    out = stats.join(median, by, "left")
    rule = F.when(F.col("_bins") == 1, F.col("_only")).when(F.col("_zero") > zeros * F.col("_all"), F.lit(0)).otherwise(F.coalesce("quantile", F.lit(0)))
    return out.select(*by, rule.alias("median"))


def depth_windows(counts: DataFrame, least: float = 5.0, low: float = 0.3, high: float = 3.0) -> DataFrame:
    """(species, sample, median, lower, upper)"""
    median = nonzero_median(depth_histogram(counts), ["species", "sample"])
    lower, upper = expr.depth_window(F.col("median"), least, low, high)
    return median.select("species", "sample", F.col("median").cast("double").alias("median"), lower.cast("double").alias("lower"), upper.cast("double").alias("upper"))


def absolute_windows(profile: DataFrame, mean_depth: float = 20.0, site_depth: float = 15.0) -> DataFrame:
    good = F.col("coverage") >= mean_depth
    return profile.select("species", "sample", F.when(good, F.lit(site_depth)).otherwise(F.lit(1e9 + 1)).alias("lower"))


def within_window(counts: DataFrame, windows: DataFrame) -> DataFrame:
    """Depth and alt, zeroed outside the sample's window; one row per sample on the other side."""
    ok = F.col("depth").between(F.col("lower"), F.col("upper"))
    joined = counts.join(windows.select("species", "sample", "lower", "upper"), ["species", "sample"])
    return joined.withColumn("alt", F.when(ok, F.col("alt")).otherwise(F.lit(0))).withColumn("depth", F.when(ok, F.col("depth")).otherwise(F.lit(0))).drop("lower", "upper")


def marker_totals(profile: DataFrame) -> DataFrame:
    """Every species row and a Total row per sample."""
    return profile.select("species", "sample", "coverage").unionByName(profile.groupBy("sample").agg(F.sum("coverage").alias("coverage")).select(F.lit("Total").alias("species"), "sample", "coverage"))


def species_by_total(profile: DataFrame) -> DataFrame:
    total = profile.groupBy("species").agg(F.sum("coverage").alias("total"))
    return total.withColumn("place", F.row_number().over(Window.orderBy(F.desc("total"), "species")))


def depth_quartiles(hist: DataFrame) -> DataFrame:
    by = ["species", "sample"]
    q1, q3 = (histogram_quantile(hist, by, "depth", "n", s).withColumnRenamed("quantile", c) for s, c in ((0.25, "q1"), (0.75, "q3")))
    return q1.join(q3, by).withColumn("iqr", F.col("q3") - F.col("q1"))


def median_capped(counts: DataFrame, reference: list[str], targets: list[str], seed: int = 43, least: int = 4) -> DataFrame:
    """Targets' reads drawn down to the median depth of the reference samples at each site.

    A draw without replacement with a seed from the site and sample, so a retry
    gives the same reads; a median below ``least`` zeroes the targets.
    """
    per_site = counts.filter(F.col("sample").isin(reference)).groupBy(*SITE).agg(F.floor(F.percentile("depth", 0.5)).alias("_cap"))

    @F.pandas_udf("long")
    def drawn(alt: pd.Series, depth: pd.Series, cap: pd.Series, key: pd.Series) -> pd.Series:
        return pd.Series([int(np.random.default_rng([seed, int(k) & 0x7FFFFFFFFFFFFFFF]).hypergeometric(a, d - a, c)) if 0 < c < d else (a if c >= d else 0) for a, d, c, k in zip(alt, depth, cap, key, strict=True)], dtype="int64")

    joined = counts.join(per_site, list(SITE), "left").withColumn("_cap", F.coalesce("_cap", F.lit(0)))
    target = F.col("sample").isin(targets)
    cap = F.when(F.col("_cap") < least, F.lit(0)).otherwise(F.least("_cap", "depth")).cast("bigint")
    alt = drawn(F.col("alt"), F.col("depth"), cap, F.xxhash64(*SITE, "sample"))
    return joined.withColumn("_alt", F.when(target, alt).otherwise(F.col("alt"))).withColumn("depth", F.when(target, cap).otherwise(F.col("depth"))).withColumn("alt", F.col("_alt")).drop("_alt", "_cap")
