"""Changes between samples: SNP flips, opportunities, substitution rates, singletons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lociweave.functions import expr
from lociweave.operators.blocks import counted, opposed_pairs, pair_sums
from lociweave.operators.diversity import with_freq
from lociweave.operators.snps import called_sites

SITE = ("species", "contig", "pos")


def opportunities(counts: DataFrame, least_depth: int = 20) -> DataFrame:
    """Sites at which a pair could be seen to change: the first sample is covered, the second to ``least_depth``."""
    measures = {"n": F.lit(1), "deep": (F.col("depth") >= least_depth).cast("int")}
    got = pair_sums(counts.filter("depth > 0"), measures, {"n_sites": [(1.0, "n", "deep")]}, "n_sites", ordered=True)
    return got.select("species", "sample_1", "sample_2", counted("n_sites"))


def flips(counts: DataFrame, least_depth: int = 20, lower: float = expr.LOWER, upper: float = expr.UPPER, with_freqs: bool = False) -> DataFrame:
    """Sites that go from low to high or from high to low, both well covered, at like relative depths; on demand with both frequencies, f1 and f2."""
    mean = counts.filter("depth > 0").groupBy("species", "sample").agg(F.avg("depth").alias("_mean"))
    rows = with_freq(counts).join(mean, ["species", "sample"]).filter(F.col("depth") >= least_depth)
    rows = rows.filter((F.col("f") <= lower) | (F.col("f") >= upper))
    pairs = opposed_pairs(rows.withColumnRenamed("_mean", "m"), F.col("f") >= upper, ("f", "depth", "m"), SITE)
    close = expr.depth_ratio_close(F.col("depth_1"), F.col("m_1"), F.col("depth_2"), F.col("m_2"))
    kind = F.when(F.col("f_1") < F.col("f_2"), "mutation").otherwise("reversion")
    return pairs.filter(close).select(*SITE, "sample_1", "sample_2", kind.alias("kind"), *([F.col(f"f_{k}").alias(f"f{k}") for k in (1, 2)] if with_freqs else []))


def change_counts(flipped: DataFrame) -> DataFrame:
    return flipped.groupBy("species", "sample_1", "sample_2", "kind").agg(F.count(F.lit(1)).alias("n"))


def _category(types: Column, core: Column) -> Column:
    """The overlapping subsets a site belongs to; one pass tags them and one grouping counts them."""
    return F.array_compact(F.array(F.lit("all"), F.when(types == "4D", "4D"), F.when(types == "1D", "1D"), F.when(core, "core")))


def substitution_rates(sites: DataFrame, core_genes: DataFrame, least_depth: int = 20, lower: float = expr.LOWER, upper: float = expr.UPPER) -> DataFrame:
    """Mutations and reversions of each ordered pair with their opportunities, by overlapping category."""
    core = core_genes.select("gene_id").distinct().withColumn("_core", F.lit(True))
    rows = with_freq(sites).filter("depth > 0").join(core, "gene_id", "left").withColumn("c", _category(F.col("variant_type"), F.coalesce("_core", F.lit(False))))
    low, high, deep = F.col("f") <= lower, F.col("f") >= upper, F.col("depth") >= least_depth
    flag = lambda c: c.cast("int")
    measures = {"n": F.lit(1), "low": flag(low), "high": flag(high), "deep": flag(deep), "deep_low": flag(deep & low), "deep_high": flag(deep & high), "deep_sure": flag(deep & (low | high))}
    sums = {"seen": [(1.0, "n", "deep")], "muts": [(1.0, "low", "deep_high")], "revs": [(1.0, "high", "deep_low")], "mut_opportunities": [(1.0, "low", "deep_sure")], "rev_opportunities": [(1.0, "high", "deep_sure")]}
    tagged = rows.withColumn("type", F.explode("c"))
    got = pair_sums(tagged, measures, sums, "seen", by=("species", "type"), ordered=True)
    return got.select("species", "sample_1", "sample_2", "type", *[counted(c) for c in ("muts", "revs", "mut_opportunities", "rev_opportunities")])


def singletons(counts: DataFrame, lower: float = expr.LOWER, upper: float = expr.UPPER) -> DataFrame:
    """Sites where a sample is the only one derived among those with a consensus, by sample, with those where two are."""
    g = expr.consensus(expr.freq(F.col("alt"), F.col("depth")), lower, upper)
    rows = counts.filter("depth > 0").withColumn("g", g).filter("g is not null")
    k = rows.groupBy(*SITE).agg(F.sum("g").alias("_k"), F.count(F.lit(1)).alias("_n"))
    derived = rows.join(k, list(SITE)).filter((F.col("_n") >= 2) & (F.col("g") == 1))
    return derived.groupBy("species", "sample").agg(F.sum(F.when(F.col("_k") == 1, 1).otherwise(0)).alias("singletons"), F.sum(F.when(F.col("_k") == 2, 1).otherwise(0)).alias("doubletons"))


def pair_singletons(sites: DataFrame, called: DataFrame, types: tuple[str, ...] = ("1D", "2D", "3D", "4D"), least: int = 4, lower: float = expr.LOWER, upper: float = expr.UPPER) -> DataFrame:
    """(pair, singletons, doubletons, differences, opportunities) of every ordered pair.

    At a called site with at least ``least`` confident samples, a difference of a pair is a
    singleton of the first sample where no other confident one agrees with it, and an
    agreement is a doubleton where nobody else agrees with the two. Opportunities are the
    sites that both samples cover, less the called ones where one of them is not confident
    or too few samples are.
    """
    by = Window.partitionBy(*SITE)
    rows = with_freq(sites).filter((F.col("depth") > 0) & F.col("variant_type").isin(*types))
    rows = rows.join(called.select(*SITE).distinct().withColumn("_snp", F.lit(True)), list(SITE), "left")
    sure = F.when(F.col("_snp"), expr.consensus(F.col("f"), lower, upper))
    rows = rows.withColumn("_g", sure).withColumn("_d", F.sum("_g").over(by)).withColumn("_k", F.count("_g").over(by))
    flag = lambda c: F.when(c, 1).otherwise(0)
    usable = F.col("_g").isNotNull() & (F.col("_k") >= least)
    derived, ancestral, rest = usable & (F.col("_g") == 1), usable & (F.col("_g") == 0), F.col("_k") - F.col("_d")
    alone = lambda n: {"d": flag(derived & (F.col("_d") == n)), "a": flag(ancestral & (rest == n))}
    measures = {"n": F.lit(1), "snp": flag(F.col("_snp")), "sure": flag(usable), "d": flag(derived), "a": flag(ancestral), "d1": alone(1)["d"], "a1": alone(1)["a"], "d2": alone(2)["d"], "a2": alone(2)["a"]}
    sums = {
        "covered": [(1.0, "n", "n")], "singletons": [(1.0, "d1", "a"), (1.0, "a1", "d")], "doubletons": [(1.0, "d2", "d"), (1.0, "a2", "a")], "differences": [(1.0, "d", "a"), (1.0, "a", "d")],
        "opportunities": [(1.0, "n", "n"), (-1.0, "snp", "snp"), (1.0, "sure", "sure")],
    }
    got = pair_sums(rows, measures, sums, "covered", ordered=True)
    return got.select("species", "sample_1", "sample_2", *[counted(c) for c in ("singletons", "doubletons", "differences", "opportunities")])


def tracked_private(counts: DataFrame, private: DataFrame, least_depth: int = 5) -> DataFrame:
    """Private SNVs high in the first sample of a pair: kept high or lost in the second."""
    rows = with_freq(counts).filter(F.col("depth") >= least_depth).join(private.select(*SITE), list(SITE), "left_semi")
    high, low = (F.col("f") >= expr.UPPER).cast("int"), (F.col("f") <= expr.LOWER).cast("int")
    sums = {"opportunities": [(1.0, "high", "sure")], "reversions": [(1.0, "high", "low")]}
    got = pair_sums(rows, {"high": high, "low": low, "sure": high + low}, sums, "opportunities", ordered=True)
    return got.select("species", "sample_1", "sample_2", counted("opportunities"), counted("reversions"))


def private_changes(grid: DataFrame, private: DataFrame, pairs: DataFrame) -> DataFrame:
    """(site, pair, f1, f2, depth_1, depth_2) of private SNVs in each asked pair of samples; ``grid`` has a row for uncovered samples too, whose frequency is null."""
    rows = with_freq(grid).join(private.select(*SITE), list(SITE), "left_semi").select(*SITE, "sample", "f", "depth")
    one, two = (rows.select(*SITE, F.col("sample").alias(f"sample_{k}"), F.col("f").alias(f"f{k}"), F.col("depth").alias(f"depth_{k}")) for k in (1, 2))
    return pairs.select("sample_1", "sample_2").distinct().join(one, "sample_1").join(two, [*SITE, "sample_2"]).select(*SITE, "sample_1", "sample_2", "f1", "f2", "depth_1", "depth_2")


def triplet_sweeps(counts: DataFrame, triplets: DataFrame) -> DataFrame:
    """Sites low in the first sample of a triplet and high in a later one."""
    rows = with_freq(counts).filter("depth > 0").select(*SITE, "sample", "f")
    long = triplets.select("subject_id", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"sample_{k}").alias("sample")) for k in (1, 2, 3)])).alias("s")).select("subject_id", "s.k", "s.sample")
    at = lambda k: F.max(F.when(F.col("k") == k, F.col("f")))
    wide = rows.join(long, "sample").groupBy(*SITE, "subject_id").agg(at(1).alias("f1"), at(2).alias("f2"), at(3).alias("f3"))
    return wide.filter((F.col("f1") <= expr.LOWER) & ((F.col("f2") >= expr.UPPER) | (F.col("f3") >= expr.UPPER)) & F.col("f2").isNotNull() & F.col("f3").isNotNull())


def called_counts(counts: DataFrame) -> DataFrame:
    return counts.join(called_sites(counts).select(*SITE), list(SITE), "left_semi")
