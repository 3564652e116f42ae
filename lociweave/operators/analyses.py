"""Analyses over the basic tables: filters of groups, spectra, clades, likelihoods, ratios and curves."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lociweave.functions import expr
from lociweave.operators import ranks
from lociweave.operators.blocks import counted, pair_sums
from lociweave.operators.diversity import site_pairs, with_freq
from lociweave.operators.snps import SITE

PAIR = ("species", "sample_1", "sample_2")


def drawn(*keys: str | Column, seed: int = 0) -> Column:
    """A hash that orders rows at random, the same way each time and on every engine."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") if isinstance(k, str) else k.cast("string") for k in keys]))


def one(condition: Column) -> Column:
    return F.sum(F.when(condition, 1).otherwise(0))


# filters of rows and groups ---------------------------------------------------


def enough_loci(summary: DataFrame, least: int = 500_000) -> DataFrame:
    return summary.filter(F.col("n_loci") > least)


def prevalent_species(rows: DataFrame, samples: DataFrame, inoculum: DataFrame, least_samples: int = 3, least_subjects: int = 2) -> DataFrame:
    """Rows of the species in enough samples and subjects that the inoculum (a table of samples) has too."""
    both = rows.join(samples.select("sample", "subject_id"), "sample")
    wide = both.groupBy("species").agg(F.countDistinct("sample").alias("_n"), F.countDistinct("subject_id").alias("_m")).filter((F.col("_n") >= least_samples) & (F.col("_m") >= least_subjects)).select("species")
    present = rows.join(inoculum.select("sample"), "sample", "left_semi").select("species").distinct()
    return rows.join(wide, "species", "left_semi").join(present, "species", "left_semi")


def not_all_zero(rows: DataFrame, by: str, value: str) -> DataFrame:
    """Rows of the groups whose values do not sum to zero."""
    return rows.join(rows.groupBy(by).agg(F.sum(value).alias("_s")).filter("_s <> 0").select(by), by, "left_semi")


def small_changes(counts: DataFrame, samples: DataFrame, most: int = 20) -> DataFrame:
    """Pairs of one subject with at most ``most`` changes, but not of one cage and time point."""
    a, b = (samples.select(*[F.col(c).alias(f"{c}_{k}") for c in ("sample", "subject_id", "cage", "ord")]) for k in (1, 2))
    rows = counts.filter(F.col("n") <= most).join(a, "sample_1").join(b, "sample_2")
    return rows.filter((F.col("subject_id_1") == F.col("subject_id_2")) & ~((F.col("cage_1") == F.col("cage_2")) & (F.col("ord_1") == F.col("ord_2")))).select(*counts.columns)


def complete(rows: DataFrame) -> DataFrame:
    return rows.dropna("any")


def varied_groups(rows: DataFrame, group: str, time: str, kind: str, least: int = 2) -> DataFrame:
    """Rows of the time points with ``least`` kinds or more, in groups with as many such time points."""
    good = rows.groupBy(group, time).agg(F.countDistinct(kind).alias("_k")).filter(F.col("_k") >= least)
    enough = good.groupBy(group).agg(F.count(F.lit(1)).alias("_t")).filter(F.col("_t") >= least)
    return rows.join(good.join(enough, group, "left_semi").select(group, time), [group, time], "left_semi")


def groups_with(rows: DataFrame, by: list[str], distinct: str, least: int = 2) -> DataFrame:
    """Rows of groups with ``least`` different values or more."""
    return rows.join(rows.groupBy(*by).agg(F.countDistinct(distinct).alias("_n")).filter(F.col("_n") >= least).select(*by), by, "left_semi")


def first_rows(rows: DataFrame, by: list[str], order: list[str], most: int | None = 1) -> DataFrame:
    """The first ``most`` rows of each group in an explicit order."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("_n") <= most).drop("_n")


def extremes(rows: DataFrame, value: str, name: str, most: int = 10) -> DataFrame:
    """The ``most`` highest and lowest rows; each is a top-k that every partition cuts first."""
    top = rows.orderBy(F.desc(value), name).limit(most).withColumn("end", F.lit("high"))
    return top.unionByName(rows.orderBy(value, name).limit(most).withColumn("end", F.lit("low")))


def random_subset(rows: DataFrame, by: str, keys: list[str], most: int, seed: int = 0) -> DataFrame:
    """At most ``most`` rows of each group, drawn by a hash: a sampling operator."""
    return rows.withColumn("_d", drawn(*keys, seed=seed)).withColumn("_n", F.row_number().over(Window.partitionBy(by).orderBy("_d", *keys))).filter(F.col("_n") <= most).drop("_d", "_n")


# aggregates -------------------------------------------------------------------


def family_abundance(rows: DataFrame) -> DataFrame:
    """Mean over hosts and sites of each family's summed abundance."""
    return rows.groupBy("subject_id", "family", "site").agg(F.sum("abundance").alias("a")).groupBy("family").agg(F.avg("a").alias("abundance"))


def tallies(rows: DataFrame, by: str, flag: str) -> DataFrame:
    """(by, n_true, n_false, total) of a boolean; groups of one row are left out."""
    got = rows.groupBy(by).agg(one(F.col(flag)).alias("n_true"), one(~F.col(flag)).alias("n_false"), F.count(F.lit(1)).alias("total"))
    return got.filter("total > 1")


def against_reference(rows: DataFrame, reference: str, value: str) -> DataFrame:
    """(species, mean, sd, reference, ratio) of the other samples against one reference sample."""
    own = rows.filter(F.col("sample") == reference).select("species", F.col(value).alias("reference"))
    others = rows.filter(F.col("sample") != reference).groupBy("species").agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))
    return others.join(own, "species").withColumn("ratio", F.try_divide("mean", "reference"))


def highest_in(rows: DataFrame, value: str) -> DataFrame:
    """(species, sample): where each species' value is highest, of equals the first by name."""
    return rows.groupBy("species").agg(F.min_by("sample", F.struct((-F.col(value)).alias("v"), "sample")).alias("sample"), F.max(value).alias(value))


def by_pathway(pairs: DataFrame, pathways: DataFrame, value: str, sites: str, least_sites: int = 100) -> DataFrame:
    """Mean of a per-gene pair measure by pathway and over all annotated genes, weighted by sites, where there are enough."""
    tagged = pairs.join(pathways.select("gene_id", "pathway").distinct(), "gene_id").select(*PAIR, "gene_id", value, sites, "pathway")
    every = pairs.join(pathways.select("gene_id").distinct(), "gene_id", "left_semi").select(*PAIR, "gene_id", value, sites, F.lit("Annotated pathways").alias("pathway"))
    got = tagged.unionByName(every).groupBy("pathway", *PAIR).agg(F.sum(value).alias("_v"), F.sum(sites).alias("n_sites"))
    return got.filter(F.col("n_sites") >= least_sites).select("pathway", *PAIR, (F.col("_v") / F.col("n_sites")).alias("mean"), "n_sites")


def gene_pair_pi(sites: DataFrame) -> DataFrame:
    """Between-sample diversity of each gene, summed over its sites, with their number."""
    sums = {"n_sites": [(1.0, "n", "n")], "pi": [(1.0, "p", "n"), (1.0, "n", "p"), (-2.0, "p", "p")]}
    got = pair_sums(with_freq(sites).filter("depth > 0"), {"n": F.lit(1), "p": F.col("f")}, sums, "n_sites", by=("species", "gene_id"))
    return got.select("gene_id", *PAIR, "pi", counted("n_sites"))


def gene_pair_flips(sites: DataFrame, lower: float = expr.LOWER, upper: float = expr.UPPER) -> DataFrame:
    """Consensus differences of each gene between two samples, with the sites where both have a consensus."""
    g = with_freq(sites).filter("depth > 0").withColumn("g", expr.consensus(F.col("f"), lower, upper)).filter("g is not null")
    sums = {"n_sites": [(1.0, "n", "n")], "flips": [(1.0, "d", "a"), (1.0, "a", "d")]}
    got = pair_sums(g, {"n": F.lit(1), "d": F.col("g"), "a": 1 - F.col("g")}, sums, "n_sites", by=("species", "gene_id"))
    return got.select("gene_id", *PAIR, counted("flips"), counted("n_sites"))


def log_bins(hist: DataFrame, by: list[str], value: str, n: str, bins: int = 30, top: float = 1e5) -> DataFrame:
    """Histogram on ``bins`` bins of equal ratio from 1 to ``top``."""
    at = F.least(F.floor(F.log(F.col(value).cast("double")) / math.log(top) * bins), F.lit(bins - 1)).cast("bigint")
    return hist.filter(F.col(value) > 0).groupBy(*by, at.alias("bin")).agg(F.sum(n).alias("n"))


def cumulated(hist: DataFrame, by: list[str], value: str, n: str) -> DataFrame:
    """Counts up to and from each value on, and the total."""
    up = Window.partitionBy(*by).orderBy(value)
    down = Window.partitionBy(*by).orderBy(F.desc(value))
    return hist.select(*by, value, n, F.sum(n).over(up).alias("upto"), F.sum(n).over(down).alias("from_on"), F.sum(n).over(Window.partitionBy(*by)).alias("total"))


def median_above(hist: DataFrame, by: list[str], value: str, n: str, least: float) -> DataFrame:
    """Lower median of the values above ``least``."""
    rows = cumulated(hist.filter(F.col(value) > least), by, value, n)
    return rows.filter(2 * F.col("upto") >= F.col("total")).groupBy(*by).agg(F.min(value).alias("median"))


# frequencies ------------------------------------------------------------------


def sample_freqs(sites: DataFrame, types: tuple[str, ...] = ("4D",), fold: bool = True) -> DataFrame:
    """Nonzero frequencies of each sample's sites of the given types, folded."""
    f = with_freq(sites.filter(F.col("variant_type").isin(*types) & (F.col("depth") > 0)))
    return f.withColumn("f", expr.folded(F.col("f")) if fold else F.col("f")).filter("f > 0").select(*SITE, "sample", "f")


def joint_freqs(sites: DataFrame, samples: list[str], types: tuple[str, ...] = ("4D",), fold: bool = True) -> DataFrame:
    """One row a site with the (folded) frequency of each of ``samples`` and whether all are covered."""
    rows = with_freq(sites.filter(F.col("variant_type").isin(*types) & F.col("sample").isin(*samples)))
    at = lambda s: F.max(F.when(F.col("sample") == s, expr.folded(F.col("f")) if fold else F.col("f")))
    seen = F.countDistinct(F.when(F.col("depth") > 0, F.col("sample"))) == len(samples)
    return rows.groupBy(*SITE).agg(*[at(s).alias(f"f_{s}") for s in samples], seen.alias("all_covered"))


def temporal_freqs(counts: DataFrame, pairs: DataFrame) -> DataFrame:
    """Frequencies at the two samples of each pair, polarised so that they do not fall; equal ones by a hash of the site."""
    rows = with_freq(counts).filter("depth > 0").select(*SITE, "sample", "f")
    a, b = (rows.withColumnsRenamed({"sample": f"sample_{k}", "f": f"f{k}"}) for k in (1, 2))
    both = pairs.select("sample_1", "sample_2").join(a, "sample_1").join(b, [*SITE, "sample_2"])
    flip = (F.col("f2") < F.col("f1")) | ((F.col("f2") == F.col("f1")) & (F.substring(drawn(*SITE), 1, 1) < "8"))
    keep = both.filter("f1 > 0 or f2 > 0").filter("f1 < 1 or f2 < 1")
    return keep.select(*PAIR[:1], "contig", "pos", "sample_1", "sample_2", F.when(flip, 1 - F.col("f1")).otherwise(F.col("f1")).alias("f1"), F.when(flip, 1 - F.col("f2")).otherwise(F.col("f2")).alias("f2"))


def triplet_copies(copies: DataFrame, triplets: DataFrame, absent: float = 0.05, low: float = 0.6, high: float = 1.2) -> DataFrame:
    """Copy numbers at the three samples of a triplet, of genes that are absent in one and normal in another of them."""
    long = triplets.select("subject_id", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"sample_{k}").alias("sample")) for k in (1, 2, 3)])).alias("s")).select("subject_id", "s.k", "s.sample")
    rows = copies.join(long, "sample")
    normal = (F.col("copynum") > low) & (F.col("copynum") < high)
    at = lambda k: F.max(F.when(F.col("k") == k, F.col("copynum"))).alias(f"c{k}")
    got = rows.groupBy("species", "gene_id", "subject_id").agg(at(1), at(2), at(3), one(F.col("copynum") <= absent).alias("_a"), one(normal).alias("_n"), F.count(F.lit(1)).alias("_k"))
    return got.filter("_k = 3 and _a > 0 and _n > 0").drop("_a", "_n", "_k")


def sequence_differences(a: Column, b: Column) -> Column:
    """Positions, from 0, at which two sequences of one length differ; null where the lengths do."""
    at = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: x != y)
    found = F.filter(F.transform(at, lambda d, i: F.when(d, i)), lambda i: i.isNotNull())
    return F.when(F.length(a) == F.length(b), found)


# clades -----------------------------------------------------------------------


def clade_freqs(counts: DataFrame, clades: DataFrame) -> DataFrame:
    """(site, clade, k, n): derived and confident samples of each clade."""
    g = with_freq(counts).filter("depth > 0").withColumn("g", expr.consensus(F.col("f"))).filter("g is not null")
    return g.join(clades.select("species", "sample", "clade"), ["species", "sample"]).groupBy(*SITE, "clade").agg(F.sum("g").alias("k"), F.count(F.lit(1)).alias("n"))


def phylogenetic_consistency(freqs: DataFrame) -> DataFrame:
    """SNVs of each species: singletons, polymorphic ones, and those that are polymorphic within more than one clade or in one and outside it."""
    inside = (F.col("k") > 0) & (F.col("k") < F.col("n"))
    rows = freqs.groupBy(*SITE).agg(F.sum("k").alias("_k"), F.sum("n").alias("_n"), one(inside).alias("_in"), one(F.col("k") > 0).alias("_with"), one(F.col("k") < F.col("n")).alias("_without"))
    poly = rows.filter("_k > 0 and _k < _n")
    bad = (F.col("_in") > 1) | ((F.col("_in") == 1) & (F.col("_with") > 1) & (F.col("_without") > 1))
    return poly.groupBy("species").agg(F.count(F.lit(1)).alias("polymorphic"), one((F.col("_k") == 1) | (F.col("_k") == F.col("_n") - 1)).alias("singletons"), one(bad).alias("inconsistent"))


def shuffled_clades(clades: DataFrame, groups: str, seed: int = 0) -> DataFrame:
    """``clades`` with the members of each group dealt its labels in another order, by a hash."""
    a = clades.withColumn("_n", F.row_number().over(Window.partitionBy("species", groups).orderBy("sample")))
    b = clades.withColumn("_n", F.row_number().over(Window.partitionBy("species", groups).orderBy(drawn("species", "sample", seed=seed), "sample")))
    return a.select("species", groups, "_n", "clade").join(b.select("species", groups, "_n", "sample"), ["species", groups, "_n"]).drop("_n")


def snv_distances(counts: DataFrame, distances: DataFrame, value: str) -> DataFrame:
    """Of each SNV: the least distance between a derived and an ancestral sample, the largest and mean one among the derived."""
    g = with_freq(counts).filter("depth > 0").withColumn("g", expr.consensus(F.col("f"))).filter("g is not null")
    pairs = site_pairs(g, ("g",)).filter("g_1 = 1 or g_2 = 1").join(distances.select(*PAIR, value), list(PAIR))
    across = F.col("g_1") != F.col("g_2")
    got = pairs.groupBy(*SITE).agg(F.min(F.when(across, F.col(value))).alias("between"), F.max(F.when(~across, F.col(value))).alias("within_max"), F.avg(F.when(~across, F.col(value))).alias("within_mean"))
    return got.filter("between is not null and within_max is not null")


def inconsistency_curve(snvs: DataFrame, steps: int = 50, low: float = 1e-3, high: float = 1.0, apart: float = 2.0) -> DataFrame:
    """Share of each species' SNVs with ``between`` at most d and ``within_max`` at least ``apart`` times d, on ``steps`` values of d of equal ratio."""
    ratio = math.log(high / low) / (steps - 1)
    d = lambda k: low * F.exp(F.lit(ratio) * k)
    # an SNV counts from the first d above "between" to the last at which "within_max" is far enough
    first = F.greatest(F.ceil(F.log(F.col("between") / low) / ratio - 1e-9), F.lit(0)).cast("int")
    last = F.least(F.floor(F.log(F.col("within_max") / apart / low) / ratio + 1e-9), F.lit(steps - 1)).cast("int")
    hits = snvs.filter("within_max > 0").withColumn("_a", F.when(F.col("between") <= low, 0).otherwise(first)).withColumn("_b", last).filter("_a <= _b")
    n = snvs.groupBy("species").agg(F.count(F.lit(1)).alias("n"))
    counted = hits.select("species", F.explode(F.sequence("_a", "_b")).alias("step")).groupBy("species", "step").agg(F.count(F.lit(1)).alias("hits"))
    return counted.join(n, "species").select("species", "step", d(F.col("step")).alias("d"), (F.col("hits") / F.col("n")).alias("share"))


# changes and rates ------------------------------------------------------------


def split_changes(changes: DataFrame, first: str = "f1", second: str = "f2", lower: float = expr.LOWER, upper: float = expr.UPPER) -> DataFrame:
    """Changes of each pair by direction."""
    up = (F.col(first) <= lower) & (F.col(second) >= upper)
    down = (F.col(first) >= upper) & (F.col(second) <= lower)
    return changes.groupBy(*PAIR).agg(one(up).alias("mutations"), one(down).alias("reversions"))


def split_gene_changes(copies: DataFrame, absent: float = 0.05, low: float = 0.6, high: float = 1.2) -> DataFrame:
    """Gains and losses of each pair (copies c1, c2), bounds included."""
    normal = lambda c: (F.col(c) >= low) & (F.col(c) <= high)
    return copies.groupBy(*PAIR).agg(one((F.col("c1") <= absent) & normal("c2")).alias("gains"), one(normal("c1") & (F.col("c2") <= absent)).alias("losses"))


def private_reversions(changes: DataFrame, totals: DataFrame, lower: float = expr.LOWER, upper: float = expr.UPPER) -> DataFrame:
    """Private SNVs that went from high to low, and the opportunities less those without reads in the second sample."""
    got = changes.groupBy(*PAIR).agg(one((F.col("f1") >= upper) & (F.col("f2") <= lower) & (F.col("depth_2") > 0)).alias("reversions"), one(F.col("depth_2") == 0).alias("_unseen"))
    rows = totals.join(got, list(PAIR), "left")
    return rows.select(*PAIR, F.coalesce("reversions", F.lit(0)).alias("reversions"), (F.col("opportunities") - F.coalesce("_unseen", F.lit(0))).alias("opportunities"))


def shared_fraction(tracked: DataFrame) -> DataFrame:
    return tracked.select(*PAIR, (1 - F.try_divide("reversions", "opportunities")).alias("shared"))


def rate_matrix(rates: DataFrame, samples: DataFrame, kind: str, columns: list[str]) -> DataFrame:
    """The rates of one kind for every ordered pair of samples, 0 where there are none."""
    names = samples.select("sample").distinct()
    grid = names.select(F.col("sample").alias("sample_1")).join(names.select(F.col("sample").alias("sample_2")), F.col("sample_1") != F.col("sample_2"))
    species = rates.select("species").distinct()
    rows = grid.join(F.broadcast(species.agg(F.collect_set("species").alias("_s"))), F.lit(True)).select(F.explode("_s").alias("species"), "sample_1", "sample_2")
    return rows.join(rates.filter(F.col("type") == kind), list(PAIR), "left").select(*PAIR, *[F.coalesce(c, F.lit(0)).alias(c) for c in columns])


def gated_changes(counts: DataFrame, opportunities: DataFrame, least_sites: int, errors: DataFrame | None = None) -> DataFrame:
    """Pairs with their changes where enough sites were seen and errors explain little: at most half a change or a tenth of them."""
    rows = opportunities.filter(F.col("n_sites") >= least_sites).join(counts, list(PAIR), "left").withColumn("n", F.coalesce("n", F.lit(0)))
    if errors is not None:
        rows = rows.join(errors.select(*PAIR, "expected"), list(PAIR), "left").filter(F.coalesce("expected", F.lit(0.0)) <= F.greatest(F.lit(0.5), 0.1 * F.col("n"))).drop("expected")
    return rows


def closest_other(rows: DataFrame, value: str) -> DataFrame:
    """For each species and first sample the pair with the least ``value``, of equals the first by name."""
    return rows.groupBy("species", "sample_1").agg(F.min_by("sample_2", F.struct(value, "sample_2")).alias("sample_2"), F.min(value).alias(value))


def change_class(n: Column, modification: int = 20, replacement: int = 500) -> Column:
    """Few changes modify a strain, many replace it."""
    return F.when(n == 0, F.lit("none")).when(n <= modification, F.lit("modification")).when(n >= replacement, F.lit("replacement")).otherwise(F.lit("unclear"))


def selection_ratio(rates: DataFrame, pseudo: float = 1.0) -> DataFrame:
    """(pair, ds, dnds) from counts and sites of nonsynonymous (1D) and synonymous (4D) changes, with pseudocounts."""
    at = lambda kind, c: F.sum(F.when(F.col("type") == kind, F.col(c)).otherwise(0))
    got = rates.withColumn("n", F.col("muts") + F.col("revs")).withColumn("l", F.col("mut_opportunities") + F.col("rev_opportunities")).groupBy(*PAIR).agg(*[at(k, c).alias(f"{c}{k}") for k in ("1D", "4D") for c in ("n", "l")])
    ds = (F.col("n4D") + pseudo) / (F.col("l4D") + pseudo)
    dn = (F.col("n1D") + pseudo) / (F.col("l1D") + pseudo)
    return got.filter("l4D > 0 and l1D > 0").select(*PAIR, ds.alias("ds"), (dn / ds).alias("dnds"))


def cumulative_ratio(ratios: DataFrame) -> DataFrame:
    """Mean dnds of the pairs at and below each divergence, and above it, by species."""
    each = ratios.groupBy("species", "ds").agg(F.sum("dnds").alias("s"), F.count(F.lit(1)).alias("n"))
    up = ranks.running(each, ["species"], "ds", ["s", "n"])
    below, n = F.col("before_s") + F.col("s"), F.col("before_n") + F.col("n")
    return up.select("species", "ds", (below / n).alias("below"), F.try_divide(F.col("all_s") - below, F.col("all_n") - n).alias("above"), n.alias("n_below"))


def ratio_of_pairs(a: DataFrame, b: DataFrame, value: str) -> DataFrame:
    """``value`` of ``a`` over that of ``b`` for each pair of both."""
    return a.select(*PAIR, F.col(value).alias("_a")).join(b.select(*PAIR, F.col(value).alias("_b")), list(PAIR)).select(*PAIR, F.try_divide("_a", "_b").alias("ratio"))


def annotated_changes(changes: DataFrame, annotations: DataFrame) -> DataFrame:
    """Changed genes with description and pathway; a gene of several pathways has a row each."""
    return changes.join(annotations, "gene_id", "left").withColumn("description", F.coalesce("description", F.lit("")))


def control_draws(changed: DataFrame, pool: DataFrame, by: str, trials: int, seed: int = 0) -> DataFrame:
    """For each trial as many genes of the pool as the group has changes, drawn by a hash."""
    size = changed.groupBy(by).agg(F.count(F.lit(1)).alias("_size"))
    rows = pool.join(size, by).withColumn("trial", F.explode(F.sequence(F.lit(1), F.lit(trials))))
    w = Window.partitionBy(by, "trial").orderBy(drawn(by, "gene_id", "trial", seed=seed), "gene_id")
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n <= _size").select(by, "trial", "gene_id")


def ortholog_matches(hits: DataFrame) -> DataFrame:
    """(gene_id, genomes, strong): other genomes that match a gene, and those as well as its own does."""
    own = hits.filter("own").groupBy("gene_id").agg(F.max("score").alias("_own"))
    best = hits.filter("not own").groupBy("gene_id", "genome").agg(F.max("score").alias("_s"))
    return best.join(own, "gene_id").groupBy("gene_id").agg(F.count(F.lit(1)).alias("genomes"), one(F.col("_s") >= F.col("_own")).alias("strong"))


# likelihoods and curves -------------------------------------------------------

def multinomial_loglikelihood(rows: DataFrame, by: list[str], n: str, p: str) -> DataFrame:
    """Of the counts of a group under probabilities ``p``; classes without counts give nothing."""
    term = F.when(F.col(n) > 0, F.col(n) * F.log(F.col(p)) - expr.log_factorial(F.col(n))).otherwise(0.0)
    return rows.groupBy(*by).agg(F.sum(n).alias("_t"), F.sum(term).alias("_s")).select(*by, (expr.log_factorial(F.col("_t")) + F.col("_s")).alias("loglikelihood"))


def binomial_loglikelihood(rows: DataFrame, by: list[str], k: str, n: str, p: Column) -> DataFrame:
    """Sum over rows of the log probability of ``k`` of ``n`` at ``p``, which is kept off 0 and 1."""
    q = F.least(F.greatest(p, F.lit(1e-9)), F.lit(1 - 1e-9))
    return rows.groupBy(*by).agg(F.sum(expr.log_choose(F.col(n), F.col(k)) + F.col(k) * F.log(q) + (F.col(n) - F.col(k)) * F.log(1 - q)).alias("loglikelihood"))


def reversal_loglikelihood(rows: DataFrame, by: list[str], at: str, n: str, top: int) -> DataFrame:
    """Log probability that counts at ``at`` and ``top - at`` split evenly."""
    folded = rows.groupBy(*by, F.least(F.col(at), top - F.col(at)).alias("_m")).agg(F.sum(n).alias("_n"), F.sum(F.when(2 * F.col(at) <= top, F.col(n)).otherwise(0)).alias("_k"))
    return folded.filter(2 * F.col("_m") < top).groupBy(*by).agg(F.sum(expr.log_choose(F.col("_n"), F.col("_k")) + F.col("_n") * math.log(0.5)).alias("loglikelihood"))


def symmetrised_ks(hist: DataFrame, by: list[str], value: str, n: str) -> DataFrame:
    """Largest difference between the distribution of x in [0, 1] and that of x and 1 - x together."""
    both = hist.select(*by, F.col(value).alias("_x"), F.col(n).alias("_a"), F.col(n).alias("_b")).unionByName(hist.select(*by, (1 - F.col(value)).alias("_x"), F.lit(0).cast("bigint").alias("_a"), F.col(n).alias("_b")))
    return ranks.ks_distance(both.withColumn("_x", F.round("_x", 9)), F.col("_a"), F.col("_b"), "_x", by)


def normalised_neutral_ld(nr: Column) -> Column:
    return expr.neutral_ld(nr) / (10.0 / 22.0)


def effective_recombination(ratio: Column) -> Column:
    """The scaled distance at which the normalised neutral curve has fallen to ``ratio``: the positive root of a quadratic."""
    # 22 (10 + 2x) = 10 r (22 + 26x + 4x^2)
    a, b, c = 40 * ratio, 260 * ratio - 44, 220 * ratio - 220
    return F.when(ratio >= 1, F.lit(0.0)).otherwise((-b + F.sqrt(b * b - 4 * a * c)) / (2 * a))


def ld_given_freq(pairs: DataFrame, low: float, high: float) -> DataFrame:
    """Numerator and denominator of r-squared of site pairs (n11, n10, n01, n00) whose rarer alleles are both between ``low`` and ``high``."""
    n = F.col("n11") + F.col("n10") + F.col("n01") + F.col("n00")
    p, q, pq = (F.try_divide(x.cast("double"), n.cast("double")) for x in (F.col("n11") + F.col("n10"), F.col("n11") + F.col("n01"), F.col("n11")))
    inside = lambda f: (expr.folded(f) >= low) & (expr.folded(f) <= high)
    return pairs.filter((n >= 4) & inside(p) & inside(q)).withColumn("num", (pq - p * q) * (pq - p * q)).withColumn("den", p * (1 - p) * q * (1 - q))


def phased_tensor(counts: DataFrame, least_depth: int = 5, share: float = 0.3, cohort: int | None = None) -> DataFrame:
    """Sites for strain inference: enough samples are covered, and not all of them are near 0 or all near 1."""
    rows = with_freq(counts).filter(F.col("depth") > least_depth)
    n = F.lit(cohort) if cohort else F.lit(counts.select("sample").distinct().count())
    kept = rows.groupBy(*SITE).agg((F.count(F.lit(1)) / n).alias("_s"), F.max("f").alias("_hi"), F.min("f").alias("_lo")).filter((F.col("_s") >= share) & (F.col("_hi") >= 0.05) & (F.col("_lo") <= 0.95))
    return rows.join(kept.select(*SITE), list(SITE), "left_semi").select(*SITE, "sample", "alt", "depth")


def common_samples(members: DataFrame, least: int = 100) -> DataFrame:
    """Samples in which every cluster of a species has ``least`` SNVs or more."""
    n = members.groupBy("species", "sample", "cluster").agg(F.count(F.lit(1)).alias("_n"))
    clusters = members.groupBy("species").agg(F.countDistinct("cluster").alias("_c"))
    good = n.filter(F.col("_n") >= least).groupBy("species", "sample").agg(F.count(F.lit(1)).alias("_g"))
    return good.join(clusters, "species").filter("_g = _c").select("species", "sample")


def assigned(sites: DataFrame, centroids: DataFrame, near: float = 3.5) -> DataFrame:
    """Every SNV with the first cluster whose centroid is nearer than ``near``, as it is or with its allele turned.

    ``sites`` has (site, sample, f, depth), ``centroids`` (species, cluster, sample, f, depth), a few rows a
    species. The distance weighs a sample by its depth and by the variance that its frequencies allow.
    """
    c = centroids.select("species", "cluster", "sample", F.col("f").alias("_cf"), F.col("depth").alias("_cd"))
    # by site first: the rows of a site with each cluster then stay in their task and are never shuffled
    rows = sites.filter("depth > 0").repartition(*SITE).join(F.broadcast(c), ["species", "sample"])

    def term(f: Column) -> Column:
        spread = (f + F.col("_cf")) * (2 - f - F.col("_cf"))
        return F.when(spread > 0, (F.col("depth") + F.col("_cd")) * (f - F.col("_cf")) * (f - F.col("_cf")) / spread).otherwise(0.0)

    d = rows.groupBy(*SITE, "cluster").agg((2 * F.avg(term(F.col("f")))).alias("forward"), (2 * F.avg(term(1 - F.col("f")))).alias("backward"))
    close = d.filter(F.least("forward", "backward") < near).groupBy(*SITE).agg(F.min_by(F.struct("cluster", (F.col("backward") < F.col("forward")).alias("turned")), "cluster").alias("c"))
    return close.select(*SITE, "c.cluster", "c.turned")


def strain_order(freqs: DataFrame, inoculum: str) -> DataFrame:
    """(species, strain, place): by frequency in the inoculum where the species is there, else by the mean over subjects of their means."""
    own = freqs.groupBy("species", "strain").agg(F.max(F.when(F.col("sample") == inoculum, F.col("freq"))).alias("_i"))
    mean = freqs.filter(F.col("sample") != inoculum).groupBy("species", "strain", "subject_id").agg(F.avg("freq").alias("_m")).groupBy("species", "strain").agg(F.avg("_m").alias("_m"))
    rows = own.join(mean, ["species", "strain"], "left")
    key = F.coalesce("_i", "_m", F.lit(0.0))
    return rows.select("species", "strain", F.row_number().over(Window.partitionBy("species").orderBy(F.desc(key), "strain")).alias("place"))


def repolarised(sites: DataFrame, inoculum: str) -> DataFrame:
    """Frequencies turned where the inoculum's is above one half, or, at sites it lacks, the mean over samples.

    A mean of one half is not above it, whatever the order in which a site's rows are summed: twelve digits of it count.
    """
    by = Window.partitionBy(*SITE)
    lead = F.coalesce(F.max(F.when((F.col("sample") == inoculum), F.col("f"))).over(by), F.round(F.avg("f").over(by), 12))
    return sites.withColumn("turned", lead > 0.5).withColumn("f", F.when(F.col("turned"), 1 - F.col("f")).otherwise(F.col("f")))


def with_missing_samples(sites: DataFrame, samples: DataFrame) -> DataFrame:
    """A row for every site and sample of the cohort, without a frequency where there is none."""
    names = samples.agg(F.collect_set("sample").alias("_all"))
    grid = sites.select(*SITE).distinct().join(F.broadcast(names), F.lit(True)).select(*SITE, F.explode("_all").alias("sample"))
    return grid.join(sites.select(*SITE, "sample", "f"), [*SITE, "sample"], "left")


def outer(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    return a.join(b, on, "full")


def by_timepoint(times: DataFrame, rows: DataFrame) -> DataFrame:
    """Every time point of a subject with its rows, none where nothing was seen."""
    return rows.join(times, ["subject_id", "date"], "right")


def eligible(rows: DataFrame, pairs: DataFrame, on: list[str]) -> DataFrame:
    return rows.join(pairs.select(*on).distinct(), on, "left_semi")
