"""Abundance, diversity of communities, and comparisons between places and times."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lociweave.operators import ranks


def relative_abundance(profile: DataFrame) -> DataFrame:
    share = F.try_divide(F.col("coverage"), F.sum("coverage").over(Window.partitionBy("sample")))
    return profile.withColumn("abundance", share)


def shannon(profile: DataFrame) -> DataFrame:
    p = F.col("abundance")
    return relative_abundance(profile).filter(p > 0).groupBy("sample").agg((-F.sum(p * F.log(p))).alias("shannon"), F.count(F.lit(1)).alias("richness"))


def bray_curtis(profile: DataFrame, value: str = "coverage") -> DataFrame:
    """Dissimilarity of every two samples.

    Sum of minima over species that both have, from one grouping by species; the
    totals come from the samples' own sums, so absent species need no rows.
    """
    by = profile.filter(F.col(value) > 0).groupBy("species").agg(F.array_sort(F.collect_list(F.struct("sample", F.col(value).alias("v")))).alias("s"))
    one = by.select("s", F.posexplode("s").alias("i", "a"))
    two = one.select("a", F.explode(F.slice("s", F.col("i") + 2, F.size("s"))).alias("b"))
    low = two.groupBy(F.col("a.sample").alias("sample_1"), F.col("b.sample").alias("sample_2")).agg(F.sum(F.least("a.v", "b.v")).alias("low"))
    total = profile.groupBy("sample").agg(F.sum(value).alias("t"))
    t1, t2 = (total.select(F.col("sample").alias(f"sample_{k}"), F.col("t").alias(f"t{k}")) for k in (1, 2))
    grid = t1.join(t2, F.col("sample_1") < F.col("sample_2"))
    return grid.join(low, ["sample_1", "sample_2"], "left").select("sample_1", "sample_2", (1 - F.try_divide(2 * F.coalesce("low", F.lit(0.0)), F.col("t1") + F.col("t2"))).alias("bray_curtis"))


def rank_abundance(profile: DataFrame) -> DataFrame:
    w = Window.partitionBy("sample").orderBy(F.desc("abundance"), "species")
    ranked = relative_abundance(profile).filter("abundance > 0").withColumn("place", F.row_number().over(w))
    return ranked.withColumn("remaining", 1 - F.sum("abundance").over(w)).select("sample", "species", "place", "abundance", "remaining")


def clr(profile: DataFrame, per: tuple[str, ...] = ("sample",)) -> DataFrame:
    """Centred log ratio of the positive shares in each group."""
    p = relative_abundance(profile).filter("abundance > 0")
    return p.select("sample", "species", (F.log("abundance") - F.avg(F.log("abundance")).over(Window.partitionBy(*per))).alias("clr"))


def abundant(profile: DataFrame, least: float = 0.001) -> DataFrame:
    """Rows of species that exceed ``least`` in some sample."""
    rel = relative_abundance(profile)
    return rel.join(rel.groupBy("species").agg(F.max("abundance").alias("_m")).filter(F.col("_m") > least), "species", "left_semi")


def nested_variance(rows: DataFrame, value: str, inner: str, outer: str) -> DataFrame:
    """Variance within inner groups (mean), between inner groups of an outer one (mean), and between outer groups."""
    one = rows.groupBy("species", outer, inner).agg(F.avg(value).alias("m"), F.var_samp(value).alias("v"))
    two = one.groupBy("species", outer).agg(F.avg("m").alias("m"), F.var_samp("m").alias("vb"), F.sum("v").alias("v"), F.count("v").alias("n"))
    return two.groupBy("species").agg(F.try_divide(F.sum("v"), F.sum("n")).alias("within_inner"), F.avg("vb").alias("between_inner"), F.var_samp("m").alias("between_outer"))


def timepoints(rows: DataFrame) -> DataFrame:
    """Dense number of each subject's dates, from 1."""
    return rows.withColumn("timepoint", F.dense_rank().over(Window.partitionBy("subject_id").orderBy("date")))


def consecutive_change(rows: DataFrame) -> DataFrame:
    """Mean frequency by species, subject and date, with the change since the subject's date before."""
    daily = rows.groupBy("species", "subject_id", "date").agg((F.sum(F.col("freq") * F.col("n")) / F.sum("n")).alias("freq"))
    w = Window.partitionBy("species", "subject_id").orderBy("date")
    return daily.withColumn("days", F.datediff("date", F.lag("date").over(w))).withColumn("delta", F.col("freq") - F.lag("freq").over(w)).filter("delta is not null")


def first_and_last(rows: DataFrame) -> DataFrame:
    daily = rows.groupBy("species", "subject_id", "date").agg((F.sum(F.col("freq") * F.col("n")) / F.sum("n")).alias("freq"))
    return daily.groupBy("species", "subject_id").agg(F.min_by("freq", "date").alias("first_freq"), F.max_by("freq", "date").alias("last_freq"), F.countDistinct("date").alias("n_dates"))


def region_pairs(rows: DataFrame) -> DataFrame:
    """Median absolute difference between two regions of a host on one day."""
    by = rows.groupBy("species", "subject_id", "date").agg(F.array_sort(F.collect_list(F.struct("region", "freq"))).alias("s"))
    one = by.select("s", F.posexplode("s").alias("i", "a"))
    two = one.select("a", F.explode(F.slice("s", F.col("i") + 2, F.size("s"))).alias("b"))
    return two.groupBy(F.col("a.region").alias("region_1"), F.col("b.region").alias("region_2")).agg(F.percentile(F.abs(F.col("a.freq") - F.col("b.freq")), 0.5).alias("median_delta"), F.count(F.lit(1)).alias("n"))


def quartiles(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    q = F.percentile(value, [0.25, 0.5, 0.75])
    return rows.groupBy(*by).agg(q.alias("_q")).select(*by, *[F.get("_q", F.lit(k)).alias(n) for k, n in enumerate(("q1", "median", "q3"))])


def log_fold(rows: DataFrame, group: str, low: str, high: str, by: list[str], value: str) -> DataFrame:
    """log2 of one more than the mean in ``high`` less that in ``low``."""
    mean = lambda g: F.avg(F.when(F.col(group) == g, F.col(value)))
    return rows.groupBy(*by).agg((F.log2(mean(high) + 1) - F.log2(mean(low) + 1)).alias("log2_fold"))


def linear_fit(rows: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    return rows.groupBy(*by).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"))


def pooled_rates(changes: DataFrame, opportunities: DataFrame, labels: DataFrame) -> DataFrame:
    """Changes over opportunities by pair label, pairs without a change counted as none."""
    by = ["species", "sample_1", "sample_2"]
    both = opportunities.join(changes, by, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return both.join(labels, ["sample_1", "sample_2"]).groupBy("host", "cage").agg(F.sum("n").alias("n_changes"), F.sum("n_sites").alias("n_opportunities"), F.try_divide(F.sum("n"), F.sum("n_sites")).alias("rate"))


def normalised_sample(rows: DataFrame, sample: str, value: str) -> DataFrame:
    """The values of one sample as shares of their sum; the others stay."""
    total = rows.filter(F.col("sample") == sample).agg(F.sum(value).alias("_t"))
    return rows.join(F.broadcast(total), F.lit(True)).withColumn(value, F.when(F.col("sample") == sample, F.try_divide(value, "_t")).otherwise(F.col(value))).drop("_t")


def ks_distance(rows: DataFrame, group: str, a: str, b: str, value: str, by: list[str]) -> DataFrame:
    """Largest difference of the two groups' cumulative shares; 1e6 where one of them has no rows."""
    side = lambda g: F.when(F.col(group) == g, 1).otherwise(0)
    got = ranks.ks_distance(rows.filter(F.col(group).isin(a, b)), side(a), side(b), value, by)
    return got.select(*by, F.coalesce("ks", F.lit(1e6)).alias("ks"))
