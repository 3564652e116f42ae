"""SNP prevalence, calls, polarisation, spectra and lineage purity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lociweave.functions import expr
from lociweave.operators.coverage import histogram_quantile

SITE = ("species", "contig", "pos")


def prevalence(counts: DataFrame) -> DataFrame:
    """Share of covered samples with the alternate allele at half or more, and, folded on it, with a call."""
    covered = counts.filter(F.col("depth") > 0)
    major = F.avg(F.when(2 * F.col("alt") >= F.col("depth"), 1.0).otherwise(0.0))
    rows = covered.withColumn("_p", major.over(Window.partitionBy(*SITE)))
    minor = F.when(F.col("_p") > 0.5, F.col("depth") - F.col("alt")).otherwise(F.col("alt"))
    call = F.when(minor >= F.ceil(F.col("depth") * 0.1) + 0.5, 1.0).otherwise(0.0)
    return rows.groupBy(*SITE).agg(F.first("_p").alias("alt_freq"), F.avg(call).alias("snp_freq"), F.count(F.lit(1)).alias("n_covered"))


def polarised(counts: DataFrame, population: DataFrame) -> DataFrame:
    """Alternate reads counted as those of the population's rarer allele."""
    joined = counts.join(population.select(*SITE, "alt_freq"), list(SITE), "left")
    flip = F.coalesce(F.col("alt_freq") > 0.5, F.lit(False))
    return joined.withColumn("alt", F.when(flip, F.col("depth") - F.col("alt")).otherwise(F.col("alt"))).withColumn("polarization", F.when(flip, F.lit("R")).otherwise(F.lit("A"))).drop("alt_freq")


def called_sites(counts: DataFrame) -> DataFrame:
    """Sites with more alternate reads than errors explain in some sample."""
    hit = (F.col("alt") > expr.snp_threshold(F.col("depth"))) & (F.col("depth") > 0)
    return counts.groupBy(*SITE).agg(F.sum(F.when(hit, 1).otherwise(0)).alias("n_called"), F.count(F.lit(1)).alias("n_samples")).filter("n_called > 0")


def prevalent_only(counts: DataFrame, least_samples: int = 4, share: float = 0.5) -> DataFrame:
    """Sites that pass in at least ``min(least_samples / n, share)`` of the samples."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*SITE))
    passing = F.avg(F.when(F.col("depth") > 0, 1.0).otherwise(0.0)).over(Window.partitionBy(*SITE))
    return counts.withColumn("_n", n).withColumn("_p", passing).filter(F.col("_p") >= F.least(F.lit(float(least_samples)) / F.col("_n"), F.lit(share))).drop("_n", "_p")


def preexisting(counts: DataFrame, least: float = 0.1) -> DataFrame:
    """Sites where some sample exceeds ``least``, with the share of covered samples that do."""
    covered = counts.filter(F.col("depth") > 0).withColumn("f", expr.freq(F.col("alt"), F.col("depth")))
    return covered.groupBy(*SITE).agg(F.avg(F.when(F.col("f") > least, 1.0).otherwise(0.0)).alias("prevalence")).filter("prevalence > 0")


def private_snvs(counts: DataFrame, samples: DataFrame, least_hosts: int = 4) -> DataFrame:
    """Sites derived in exactly one host among at least ``least_hosts`` confident ones."""
    g = expr.consensus(expr.freq(F.col("alt"), F.col("depth")))
    rows = counts.filter(F.col("depth") > 0).withColumn("g", g).filter(F.col("g").isNotNull()).join(samples.select("sample", "subject_id"), "sample")
    hosts = rows.groupBy(*SITE, "subject_id").agg(F.max("g").alias("g"))
    sites = hosts.groupBy(*SITE).agg(F.count(F.lit(1)).alias("n_hosts"), F.sum("g").alias("_d"), F.max(F.when(F.col("g") == 1, F.col("subject_id"))).alias("host"))
    return sites.filter((F.col("n_hosts") >= least_hosts) & (F.col("_d") == 1)).drop("_d")


def spectrum(sites: DataFrame, types: tuple[str, ...] = ("1D", "2D", "3D", "4D")) -> DataFrame:
    """Number of sites by sample, variant type, depth and alternate reads."""
    rows = sites.filter(F.col("variant_type").isin(*types) & (F.col("depth") > 0))
    return rows.groupBy("species", "sample", "variant_type", "depth", "alt").agg(F.count(F.lit(1)).alias("n"))


def _snapped(alt: Column, depth: Column, least: float = 0.05) -> Column:
    f = expr.freq(alt, depth)
    return F.when(f < least + 1e-9, F.lit(0)).when(f > 1 - least - 1e-9, depth).otherwise(alt)


def spectrum_pi(sfs: DataFrame) -> DataFrame:
    """Diversity of each sample's spectrum, frequencies near 0 or 1 counted as fixed."""
    a, d = _snapped(F.col("alt"), F.col("depth")).cast("double"), F.col("depth").cast("double")
    weight = F.try_divide(2 * a * (d - a), d * (d - 1)) * F.col("n")
    return sfs.filter("depth > 1").groupBy("species", "sample").agg((F.sum(weight) / F.sum("n")).alias("pi"), F.sum("n").alias("n_sites"))


def spectrum_rates(sfs: DataFrame, lower: float = expr.LOWER, upper: float = expr.UPPER) -> DataFrame:
    """Sites at intermediate frequency (within), at high frequency (between), and all."""
    f, n = expr.freq(F.col("alt"), F.col("depth")), F.col("n")
    within = F.sum(F.when((f > lower) & (f < upper), n).otherwise(0))
    return sfs.groupBy("species", "sample").agg(within.alias("within"), F.sum(F.when(f >= upper, n).otherwise(0)).alias("between"), F.sum(n).alias("total"))


def ploidy(sfs: DataFrame, share: float = 0.1) -> DataFrame:
    """Whether one lineage dominates: few sites within for those between."""
    rates = spectrum_rates(sfs.filter(F.col("variant_type") == "4D"))
    return rates.withColumn("haploid", F.col("within") <= share * F.col("between"))


def binned_spectrum(sfs: DataFrame, bins: int = 10) -> DataFrame:
    """Minor-frequency histogram on equal bins of (0, 0.5]."""
    f = expr.folded(expr.freq(F.col("alt"), F.col("depth")))
    at = F.least(F.floor(f * 2 * bins), F.lit(bins - 1)).cast("bigint")
    return sfs.withColumn("bin", at).filter(f > 0).groupBy("species", "sample", "bin").agg(F.sum("n").alias("n"))


def naive_spectrum(counts: DataFrame, target: int = 10) -> DataFrame:
    f = expr.freq(F.col("alt"), F.col("depth"))
    return counts.filter("depth > 0").withColumn("k", F.floor(f * target + 0.5).cast("bigint")).groupBy("species", "sample", "k").agg(F.count(F.lit(1)).alias("n"))


def folded_spectrum(sfs: DataFrame, k: str = "k", n: str = "n", top: int = 10) -> DataFrame:
    return sfs.groupBy("species", "sample", F.least(F.col(k), top - F.col(k)).alias(k)).agg(F.sum(n).alias(n))


def projected_spectrum(counts: DataFrame, target: int = 10) -> DataFrame:
    """Expected counts in ``target`` reads drawn without replacement."""
    rows = counts.filter(F.col("depth") >= target).groupBy("species", "sample", "depth", "alt").agg(F.count(F.lit(1)).alias("n"))
    spread = rows.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(target))))
    ok = (F.col("k") <= F.col("alt")) & (target - F.col("k") <= F.col("depth") - F.col("alt"))
    a, d, k = F.col("alt"), F.col("depth"), F.col("k")
    p = F.exp(expr.log_choose(a, k) + expr.log_choose(d - a, target - k) - expr.log_choose(d, F.lit(target)))
    return spread.filter(ok).groupBy("species", "sample", "k").agg(F.sum(p * F.col("n")).alias("expected"))


def depth_distribution(sfs: DataFrame) -> DataFrame:
    return sfs.groupBy("species", "sample", "depth").agg(F.sum("n").alias("n"))


def spectrum_median_depth(sfs: DataFrame) -> DataFrame:
    """Median depth of a spectrum, with the strict convention that spectra use."""
    return histogram_quantile(depth_distribution(sfs), ["species", "sample"], "depth", "n", 0.5, strict=True).withColumnRenamed("quantile", "median_depth")


def high_coverage(medians: DataFrame, least: float = 20.0) -> DataFrame:
    return medians.filter(F.col("median") >= least).select("species", "sample", "median")
