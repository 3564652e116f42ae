"""The annotated-SNP chain: from the tables of one species' sites to called, polarised and supported counts, in one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lociweave.functions import expr
from lociweave.functions import kernels as K
from lociweave.operators import coverage

SITE = ("species", "contig", "pos")
TYPES = ("1D", "2D", "3D", "4D")


def usable_samples(counts: DataFrame, least_median: float, low: float, high: float, least_samples: int) -> DataFrame:
    """(species, sample, lower, upper, least_share): the samples with a usable depth window, and the share of them that a site needs.

    One row a sample: where few, Catalyst broadcasts it.
    """
    windows = coverage.depth_windows(counts, least_median, low, high)
    every = windows.groupBy("species").agg(F.least(F.lit(float(least_samples)) / F.count(F.lit(1)), F.lit(0.5)).alias("least_share"))
    return windows.filter(F.col("lower") < 1e9).select("species", "sample", "lower", "upper").join(every, "species")


def site_pvalues(counts: DataFrame) -> DataFrame:
    """(site, pvalue): the least chance, over a site's covered samples, that errors alone gave its minor reads, times their number.

    Each distinct (alt, depth) is computed once.
    """
    covered = counts.filter("depth > 0")
    minor = F.least("alt", F.col("depth") - F.col("alt"))
    chances = covered.select(minor.alias("_k"), "depth").distinct().withColumn("_p", expr.binomial_tail(F.col("_k"), F.col("depth"), K.ERROR))
    each = covered.withColumn("_k", minor).join(chances, ["_k", "depth"])
    return each.groupBy(*SITE).agg(F.least(F.min("_p") * F.count(F.lit(1)), F.lit(1.0)).alias("pvalue"))


def annotated_sites(counts: DataFrame, info: DataFrame, population: DataFrame, pvalues: DataFrame, least_median: float = 5.0, low: float = 0.3, high: float = 3.0, least_samples: int = 1, types: tuple[str, ...] = TYPES, share: float = 0.05, level: float = 0.05) -> DataFrame:
    """(site, gene_id, variant_type, polarization, pvalue, sample, depth, alt, called, supported), a row for each usable sample.

    ``counts`` has a row for every sample of a site, covered or not; ``info`` has the gene
    and variant type of (contig, pos), ``population`` the ``alt_freq`` of sites known
    elsewhere, ``pvalues`` a p-value a site (none: 1). In this order: sites of other
    ``types`` go; samples whose nonzero median depth is below ``least_median`` go; counts
    outside a sample's depth window become 0; sites go that are inside it in too small a
    share of the usable samples; alternate reads become those of the population's rarer
    allele (polarization A, else R); a site is called where its p-value is below ``level``
    and some sample has more alternate reads than ``share`` explains; a count is
    supported where both alleles have more than one read, or one of them has none.

    All that a site is judged by comes from windows over one partitioning by site.
    """
    by = Window.partitionBy(*SITE)
    rows = counts.join(info.filter(F.col("variant_type").isin(*types)).select("contig", "pos", "gene_id", "variant_type"), ["contig", "pos"])
    rows = rows.join(usable_samples(counts, least_median, low, high, least_samples), ["species", "sample"])
    inside = F.col("depth").between(F.col("lower"), F.col("upper"))
    rows = rows.withColumn("_in", inside).withColumn("_share", F.avg(F.when(F.col("_in"), 1.0).otherwise(0.0)).over(by)).filter(F.col("_share") >= F.col("least_share"))
    zero = F.lit(0).cast("bigint")
    rows = rows.withColumn("depth", F.when(F.col("_in"), F.col("depth")).otherwise(zero)).withColumn("alt", F.when(F.col("_in"), F.col("alt")).otherwise(zero))
    rows = rows.join(population.select(*SITE, "alt_freq"), list(SITE), "left").join(pvalues.select(*SITE, "pvalue"), list(SITE), "left")
    turned = F.coalesce(F.col("alt_freq") > 0.5, F.lit(False))
    rows = rows.withColumn("polarization", F.when(turned, F.lit("A")).otherwise(F.lit("R"))).withColumn("alt", F.when(turned, F.col("depth") - F.col("alt")).otherwise(F.col("alt")))
    rows = rows.withColumn("pvalue", F.coalesce("pvalue", F.lit(1.0)))
    hit = F.max((F.col("depth") > 0) & (F.col("alt") > expr.snp_threshold(F.col("depth"), share))).over(by)
    ref = F.col("depth") - F.col("alt")
    supported = (F.col("depth") > 0) & ((F.col("alt") == 0) | (ref == 0) | ((F.col("alt") > 1) & (ref > 1)))
    return rows.select(*SITE, "gene_id", "variant_type", "polarization", "pvalue", "sample", "depth", "alt", (hit & (F.col("pvalue") < level)).alias("called"), supported.alias("supported"))


def called_by_gene(sites: DataFrame) -> DataFrame:
    """(species, gene_id, variant_type, sites, called): what the chain leaves of each gene, by type."""
    each = sites.groupBy(*SITE, "gene_id", "variant_type").agg(F.max("called").alias("c"))
    return each.groupBy("species", "gene_id", "variant_type").agg(F.count(F.lit(1)).alias("sites"), F.sum(F.col("c").cast("int")).alias("called"))
