"""Linkage disequilibrium and haplotype statistics."""

from __future__ import annotations

from collections import Counter
from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lociweave.operators.diversity import consensus_genotypes

SITE = ("species", "contig", "pos")


def site_pair_counts(sites: DataFrame, reach: int | None = None) -> DataFrame:
    """2x2 genotype counts of every two polymorphic sites of one gene.

    A gene's sites are bounded, so are its pairs; the samples of a gene are
    collected per site first, and pairs are exploded from the gene's array.
    """
    g = consensus_genotypes(sites)
    per_site = g.groupBy("species", "gene_id", "contig", "pos").agg(F.map_from_entries(F.collect_list(F.struct("sample", "genotype"))).alias("g"), F.sum("genotype").alias("_k"), F.count(F.lit(1)).alias("_n"))
    per_site = per_site.filter("_k > 0 and _k < _n").drop("_k", "_n")
    genes = per_site.groupBy("species", "gene_id", "contig").agg(F.array_sort(F.collect_list("pos")).alias("at"), F.map_from_entries(F.collect_list(F.struct("pos", "g"))).alias("by"))
    one = genes.select("species", "gene_id", "by", "at", F.posexplode("at").alias("_i", "pos_1"))
    two = one.select("species", "gene_id", "by", "pos_1", F.explode(F.slice("at", F.col("_i") + 2, F.size("at"))).alias("pos_2"))
    if reach is not None:
        two = two.filter(F.col("pos_2") - F.col("pos_1") <= reach)
    a, b = F.element_at("by", F.col("pos_1")), F.element_at("by", F.col("pos_2"))
    both = two.select("species", "gene_id", "pos_1", "pos_2", F.transform(F.array_intersect(F.map_keys(a), F.map_keys(b)), lambda s: F.struct(F.element_at(a, s).alias("x"), F.element_at(b, s).alias("y"))).alias("z"))
    n = lambda x, y: F.size(F.filter("z", lambda v: (v["x"] == x) & (v["y"] == y))).cast("double")
    return both.select("species", "gene_id", "pos_1", "pos_2", n(1, 1).alias("n11"), n(1, 0).alias("n10"), n(0, 1).alias("n01"), n(0, 0).alias("n00"))


def _falling(n: Column, times: int) -> Column:
    out = F.lit(1.0)
    for k in range(times):
        out = out * (n - k)
    return out


def unbiased_sigma_squared(pairs: DataFrame) -> DataFrame:
    """Unbiased estimates of D squared and of p1 q1 p2 q2 from four distinct samples.

    The denominator sums over ordered draws: one sample derived and one ancestral
    at the first site, one derived and one ancestral at the second. Pairs below four
    samples are dropped.
    """
    counts = {(1, 1): F.col("n11"), (1, 0): F.col("n10"), (0, 1): F.col("n01"), (0, 0): F.col("n00")}
    draws = Counter(tuple(sorted(Counter(((1, w), (0, x), (y, 1), (z, 0))).items())) for w, x, y, z in product((0, 1), repeat=4))
    den = F.lit(0.0)
    for kinds, times in draws.items():
        term = F.lit(float(times))
        for kind, k in kinds:
            term = term * _falling(counts[kind], k)
        den = den + term
    d2 = lambda a, b: _falling(counts[a], 2) * _falling(counts[b], 2)
    cross = counts[1, 1] * counts[1, 0] * counts[0, 1] * counts[0, 0]
    num = d2((1, 1), (0, 0)) - 2 * cross + d2((1, 0), (0, 1))
    n = sum(counts.values(), F.lit(0.0))
    all_draws = _falling(n, 4)
    return pairs.filter(n >= 4).select("species", "gene_id", "pos_1", "pos_2", F.try_divide(num, all_draws).alias("num"), F.try_divide(den, all_draws).alias("den"))


def sigma_squared(pairs: DataFrame) -> DataFrame:
    """D squared and p1 q1 p2 q2 from sample frequencies."""
    n = F.col("n11") + F.col("n10") + F.col("n01") + F.col("n00")
    p1, p2, both = (F.try_divide(x, n) for x in (F.col("n11") + F.col("n10"), F.col("n11") + F.col("n01"), F.col("n11")))
    dd = both - p1 * p2
    return pairs.filter(n >= 4).select("species", "gene_id", "pos_1", "pos_2", (dd * dd).alias("num"), (p1 * (1 - p1) * p2 * (1 - p2)).alias("den"))


def binned(ld: DataFrame, width: int = 3) -> DataFrame:
    """Ratios of sums, not means of ratios, by distance; denominators of about 0 are left out."""
    at = F.floor((F.col("pos_2") - F.col("pos_1")) / width)
    return ld.filter("den > 1e-9").groupBy("species", at.alias("bin")).agg(F.sum("num").alias("num"), F.sum("den").alias("den"), F.count(F.lit(1)).alias("n")).withColumn("ratio", F.try_divide("num", "den"))


def haplotypes(sites: DataFrame) -> DataFrame:
    """Each sample's consensus over the sites of a gene, as a string in site order with N for none."""
    from lociweave.functions import expr

    g = expr.consensus(expr.freq(F.col("alt"), F.col("depth")))
    code = F.coalesce(g.cast("string"), F.lit("N"))
    own = sites.select("species", "gene_id", "sample", "pos", code.alias("_c")).groupBy("species", "gene_id", "sample").agg(F.map_from_entries(F.collect_list(F.struct("pos", "_c"))).alias("_m"))
    # a gene's samples together, once, for the places that any of them has
    gene = own.groupBy("species", "gene_id").agg(F.collect_list(F.struct("sample", "_m")).alias("_s"))
    gene = gene.withColumn("_at", F.array_sort(F.array_distinct(F.flatten(F.transform("_s", lambda x: F.map_keys(x["_m"]))))))
    each = gene.select("species", "gene_id", "_at", F.explode("_s").alias("_x"))
    return each.select("species", "gene_id", "_x.sample", F.array_join(F.transform("_at", lambda p: F.coalesce(F.try_element_at("_x._m", p), F.lit("N"))), "").alias("haplotype"))


def haplotype_counts(haps: DataFrame) -> DataFrame:
    return haps.groupBy("species", "gene_id", "haplotype").agg(F.count(F.lit(1)).alias("n"))


def homozygosity(counts: DataFrame) -> DataFrame:
    """K, H1, H2, H12 and H2/H1 of each gene's haplotype sizes."""
    by = ["species", "gene_id"]
    ranked = counts.withColumn("_p", F.col("n") / F.sum("n").over(Window.partitionBy(*by))).withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("n"), "haplotype")))
    sq = F.col("_p") * F.col("_p")
    got = ranked.groupBy(*by).agg(F.count(F.lit(1)).alias("k"), F.sum(sq).alias("h1"), F.coalesce(F.sum(F.when(F.col("_r") > 1, sq)), F.lit(0.0)).alias("h2"), F.sum(F.when(F.col("_r") <= 2, F.col("_p"))).alias("_two"), F.coalesce(F.sum(F.when(F.col("_r") > 2, sq)), F.lit(0.0)).alias("_rest"))
    return got.select(*by, "k", "h1", "h2", (F.col("_two") * F.col("_two") + F.col("_rest")).alias("h12"), F.try_divide("h2", "h1").alias("h2_h1"))
