"""Nucleotide diversity, fixation index, diversity matrices and frequency pools."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lociweave.functions import expr
from lociweave.operators.blocks import counted, pair_sums

SITE = ("species", "contig", "pos")


def with_freq(counts: DataFrame) -> DataFrame:
    """Adds ``f`` (alternate) and ``rf`` (reference), null at depth 0."""
    return counts.withColumn("f", expr.freq(F.col("alt"), F.col("depth"))).withColumn("rf", expr.freq(F.col("depth") - F.col("alt"), F.col("depth")))


def site_pi(counts: DataFrame, least_depth: int = 4, method: str = "unbiased") -> DataFrame:
    rows = with_freq(counts).filter(F.col("depth") >= least_depth)
    pi = expr.pi_unbiased(F.col("rf"), F.col("depth")) if method == "unbiased" else expr.pi_regular(F.col("rf"))
    return rows.withColumn("pi", pi)


def pi_summary(sites: DataFrame, by: tuple[str, ...] = ("species", "sample")) -> DataFrame:
    return sites.groupBy(*by).agg(F.avg("pi").alias("mean_pi"), F.avg(F.nullif(F.col("pi"), F.lit(0.0))).alias("mean_pi_variable"), F.avg("depth").alias("mean_depth"), F.count("pi").alias("n_loci"))


def in_copy_window(sites: DataFrame, copynum: DataFrame, low: float = 0.6, high: float = 1.2) -> DataFrame:
    """Sites of genes whose copy number lies strictly between the bounds in that sample."""
    good = copynum.filter((F.col("copynum") > low) & (F.col("copynum") < high)).select("species", "gene_id", "sample")
    return sites.join(good, ["species", "gene_id", "sample"], "left_semi")


def without_genes(sites: DataFrame, genes: DataFrame) -> DataFrame:
    """Drop sites of listed genes."""
    return sites.join(genes.select("gene_id").distinct(), "gene_id", "left_anti")


def renamed_genes(sites: DataFrame, alias: DataFrame) -> DataFrame:
    """Genes by their own name, else by that of an alias (``gene_id``, ``alias_of``); one row per site either way."""
    one = alias.groupBy("gene_id").agg(F.min("alias_of").alias("alias_of"))
    return sites.join(one, "gene_id", "left").withColumn("gene_id", F.coalesce("alias_of", "gene_id")).drop("alias_of")


def site_pairs(rows: DataFrame, keep: tuple[str, ...], by: tuple[str, ...] = SITE, ordered: bool = False) -> DataFrame:
    """Pairs of samples at each site, the columns ``keep`` with suffixes 1 and 2.

    One shuffle by site and no join: the samples of a site are collected, which
    the size of the cohort bounds, and their pairs are exploded.
    """
    held = F.struct("sample", *keep)
    got = rows.groupBy(*by).agg(F.array_sort(F.collect_list(held)).alias("_s"))
    one = got.select(*by, "_s", F.posexplode("_s").alias("_i", "_a"))
    rest = F.filter("_s", lambda x, k: k != F.col("_i")) if ordered else F.slice("_s", F.col("_i") + 2, F.size("_s"))
    both = one.select(*by, "_a", F.explode(rest).alias("_b"))
    return both.select(*by, F.col("_a.sample").alias("sample_1"), F.col("_b.sample").alias("sample_2"), *[F.col(f"_a.{c}").alias(f"{c}_1") for c in keep], *[F.col(f"_b.{c}").alias(f"{c}_2") for c in keep])


#: Chance that one read of each sample differ: p1 (1 - p2) + p2 (1 - p1).
_BETWEEN = [(1.0, "p", "n"), (1.0, "n", "p"), (-2.0, "p", "p")]


def fst_loci(counts: DataFrame, sample_1: str, sample_2: str, least_depth: int = 4) -> DataFrame:
    """Per-site diversity within and between two samples and their fixation index."""
    two = site_pi(counts.filter(F.col("sample").isin(sample_1, sample_2)), least_depth)
    pairs = site_pairs(two, ("rf", "pi", "depth"))
    within, between = (F.col("pi_1") + F.col("pi_2")) / 2, expr.pi_between(F.col("rf_1"), F.col("rf_2"))
    return pairs.withColumn("pi_within", within).withColumn("pi_between", between).withColumn("fst", expr.fst(F.col("pi_within"), F.col("pi_between")))


def fst_summary(loci: DataFrame) -> DataFrame:
    ratio = 1 - F.try_divide(F.sum("pi_within"), F.sum("pi_between"))
    return loci.groupBy("species", "sample_1", "sample_2").agg(ratio.alias("fst_of_means"), F.avg("fst").alias("mean_fst"), F.count(F.lit(1)).alias("n_loci"))


def hudson_fst(counts: DataFrame, least_depth: int = 4) -> DataFrame:
    """Ratio of sums of Hudson's numerator, (p1 - p2)^2 less each sample's own variance, and denominator."""
    rows = with_freq(counts).filter(F.col("depth") >= least_depth)
    f = F.col("f")
    measures = {"n": F.lit(1), "p": f, "pp": f * f, "own": F.try_divide(f * (1 - f), F.col("depth").cast("double") - 1)}
    gap = [(1.0, "pp", "n"), (1.0, "n", "pp"), (-2.0, "p", "p"), (-1.0, "own", "n"), (-1.0, "n", "own")]
    got = pair_sums(rows, measures, {"n_loci": [(1.0, "n", "n")], "num": gap, "den": _BETWEEN}, "n_loci")
    return got.select("species", "sample_1", "sample_2", F.try_divide("num", F.nullif(F.col("den"), F.lit(0.0))).alias("hudson_fst"), counted("n_loci"))


def pi_matrix(sites: DataFrame, variant_type: str = "4D") -> DataFrame:
    """Mean diversity between every pair of samples, and within each averaged over the pair's shared sites."""
    rows = with_freq(sites).filter((F.col("variant_type") == variant_type) & (F.col("depth") > 1))
    a, d = F.col("alt").cast("double"), F.col("depth").cast("double")
    rows = rows.withColumn("own", 2 * a * (d - a) / (d * (d - 1)))
    sums = {"n_sites": [(1.0, "n", "n")], "pi_between": _BETWEEN, "pi_within": [(0.5, "own", "n"), (0.5, "n", "own")]}
    got = pair_sums(rows, {"n": F.lit(1), "p": F.col("f"), "own": F.col("own")}, sums, "n_sites")
    return got.select("species", "sample_1", "sample_2", *[(F.col(c) / F.col("n_sites")).alias(c) for c in ("pi_between", "pi_within")], counted("n_sites"))


def consensus_genotypes(counts: DataFrame, lower: float = expr.LOWER, upper: float = expr.UPPER) -> DataFrame:
    return with_freq(counts).withColumn("genotype", expr.consensus(F.col("f"), lower, upper)).filter(F.col("genotype").isNotNull())


def pooled_freqs(counts: DataFrame) -> DataFrame:
    """Minor frequency of consensus genotypes at sites where both are seen."""
    g = consensus_genotypes(counts).groupBy(*SITE).agg(F.sum("genotype").alias("k"), F.count(F.lit(1)).alias("n"))
    return g.filter((F.col("k") > 0) & (F.col("k") < F.col("n"))).select(*SITE, "n", F.least("k", F.col("n") - F.col("k")).alias("k"), expr.folded(F.col("k") / F.col("n")).alias("f"))


def pooled_counts(counts: DataFrame, least_k: int = 1) -> DataFrame:
    p = pooled_freqs(counts).filter(F.col("k") >= least_k)
    k, n = F.col("k").cast("double"), F.col("n").cast("double")
    return p.groupBy("species").agg(F.count(F.lit(1)).alias("n_sites"), F.sum(F.try_divide(2 * k * (n - k), n * (n - 1))).alias("pi"))


def genotype_covariance(counts: DataFrame, diagonal: bool = False) -> DataFrame:
    """Covariance of centred genotypes over jointly covered sites, the matrix of a principal component analysis with gaps."""
    rows = with_freq(counts).filter(F.col("depth") > 0)
    centred = rows.withColumn("g", F.col("f") - F.avg("f").over(Window.partitionBy(*SITE)))
    got = pair_sums(centred, {"n": F.lit(1), "g": F.col("g")}, {"n_sites": [(1.0, "n", "n")], "cov": [(1.0, "g", "g")]}, "n_sites", diagonal=diagonal)
    return got.select("species", "sample_1", "sample_2", (F.col("cov") / F.col("n_sites")).alias("cov"), counted("n_sites"))


def new_snps(counts: DataFrame, rare: float = 0.05, common: float = 0.2) -> DataFrame:
    """Sites whose minor frequency is below ``rare`` in the first sample and above ``common`` in the second."""
    maf = expr.folded(F.col("f"))
    rows = with_freq(counts).filter(F.col("depth") > 0)
    measures = {"n": F.lit(1), "rare": (maf < rare).cast("int"), "common": (maf > common).cast("int")}
    got = pair_sums(rows, measures, {"n_sites": [(1.0, "n", "n")], "n_new": [(1.0, "rare", "common")]}, "n_sites", ordered=True)
    return got.select("species", "sample_1", "sample_2", counted("n_new"), counted("n_sites"))


def mean_pair_value(pairs: DataFrame, clades: DataFrame, value: str) -> DataFrame:
    """One less mean within clades over mean of all pairs."""
    c = clades.select("sample", "clade")
    both = pairs.join(c.withColumnsRenamed({"sample": "sample_1", "clade": "_c1"}), "sample_1").join(c.withColumnsRenamed({"sample": "sample_2", "clade": "_c2"}), "sample_2")
    within: Column = F.avg(F.when(F.col("_c1") == F.col("_c2"), F.col(value)))
    return both.groupBy("species").agg((1 - F.try_divide(within, F.avg(value))).alias("clade_fst"))
