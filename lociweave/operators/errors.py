"""False changes that reading noise alone leads one to expect, over a list of frequency changes."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lociweave.functions import expr
from lociweave.operators.analyses import PAIR

#: Changes of frequency that count as one, and bins of the true frequency.
CHANGES = (0.6, 0.7, 0.8, 0.9, 0.98)
BINS = 20


def low_tails(depths: DataFrame, changes: tuple[float, ...] = CHANGES, bins: int = BINS) -> DataFrame:
    """(depth, bin, change, tail): the chance that a site of a bin's middle frequency reads at most (1 - change) / 2 at a depth.

    The terms of a depth and frequency are made once; each threshold is a part of their sum.
    """
    widest = (1 - min(changes)) / 2
    cells = depths.select("depth").distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    terms = cells.withColumn("_k", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor(F.col("depth") * widest + 1e-9))))
    f = (F.col("bin") + 0.5) / bins
    d, k = F.col("depth"), F.col("_k")
    term = F.exp(expr.log_choose(d, k) + k * F.log(f) + (d - k) * F.log(1 - f))
    sums = [F.struct(F.lit(float(c)).alias("change"), F.sum(F.when(k <= d * ((1 - c) / 2) + 1e-9, F.col("_p")).otherwise(0.0)).alias("tail")) for c in changes]
    return terms.withColumn("_p", term).groupBy("depth", "bin").agg(F.array(*sums).alias("_t")).select("depth", "bin", F.explode("_t").alias("_t")).select("depth", "bin", "_t.change", "_t.tail")


def change_errors(sfs: DataFrame, pairs: DataFrame, changes: tuple[float, ...] = CHANGES, bins: int = BINS, sites: float = 3e6) -> DataFrame:
    """(pair, change, rate, expected): the chance per site that both samples have one frequency and read a change of it, and that times ``sites``.

    ``sfs`` has (species, sample, depth, alt, n). The true frequency has the mean of both
    samples' spectra, folded; each sample reads it at its own depths.
    """
    cells = sfs.filter("depth > 0")
    total = cells.groupBy("species", "sample").agg(F.sum("n").alias("_all"))
    at = F.least(F.floor(expr.freq(F.col("alt"), F.col("depth")) * bins + 1e-9), F.lit(bins - 1)).cast("int")
    prior = cells.groupBy("species", "sample", at.alias("bin")).agg(F.sum("n").alias("_n")).join(total, ["species", "sample"]).select("species", "sample", "bin", (F.col("_n") / F.col("_all")).alias("p"))
    depths = cells.groupBy("species", "sample", "depth").agg(F.sum("n").alias("_n"))
    reads = depths.join(low_tails(depths, changes, bins), "depth").groupBy("species", "sample", "bin", "change").agg(F.sum(F.col("_n") * F.col("tail")).alias("_s"))
    reads = reads.join(total, ["species", "sample"]).select("species", "sample", "bin", "change", (F.col("_s") / F.col("_all")).alias("low"))
    # both samples' spectra, either way up, weigh each bin: four halves of a half
    asked = pairs.select("sample_1", "sample_2").distinct()
    sides = asked.select("sample_1", "sample_2", F.explode(F.array("sample_1", "sample_2")).alias("sample"))
    mirrored = prior.withColumn("bin", F.explode(F.array("bin", bins - 1 - F.col("bin"))))
    weight = mirrored.join(sides, "sample").groupBy(*PAIR, "bin").agg((F.sum("p") / 4).alias("p"))
    one = reads.select("species", F.col("sample").alias("sample_1"), "bin", "change", F.col("low").alias("low_1"))
    two = reads.select("species", F.col("sample").alias("sample_2"), (bins - 1 - F.col("bin")).alias("bin"), "change", F.col("low").alias("low_2"))
    both = weight.join(one, ["species", "sample_1", "bin"]).join(two, ["species", "sample_2", "bin", "change"])
    return both.groupBy(*PAIR, "change").agg(F.sum(F.col("p") * F.col("low_1") * F.col("low_2")).alias("rate")).withColumn("expected", F.col("rate") * sites)


def gene_errors(genes: DataFrame, pairs: DataFrame, absent: float = 0.05, low: float = 0.6, high: float = 1.2) -> DataFrame:
    """(pair, n_genes, expected): genes of each pair that reading noise alone would turn from normal to absent, or back.

    ``genes`` has (species, gene_id, sample, reads, copynum). A sample reads a gene of one
    copy ``reads / copynum`` times, and the reads follow a Poisson law; genes that no copy
    was seen of are left out. Each distinct number of reads a copy is computed once.
    """
    rate = F.round(F.try_divide(F.col("reads").cast("double"), F.nullif(F.col("copynum"), F.lit(0.0))), 6)
    rows = genes.filter("copynum > 0 and reads > 0").select("species", "gene_id", "sample", rate.alias("unit"))
    units = rows.select("unit").distinct()
    k = F.col("_k")
    terms = units.withColumn("_k", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor(F.col("unit") * high + 1e-9))))
    p = F.exp(k * F.log("unit") - F.col("unit") - expr.log_factorial(k))
    part = lambda c: F.sum(F.when(c, F.col("_p")).otherwise(0.0))
    chances = terms.withColumn("_p", p).groupBy("unit").agg(part(k <= F.col("unit") * absent + 1e-9).alias("gone"), part(k >= F.col("unit") * low - 1e-9).alias("there"))
    each = rows.join(chances, "unit").select("species", "gene_id", "sample", "gone", "there")
    one, two = (each.select("species", "gene_id", *[F.col(c).alias(f"{c}_{n}") for c in ("sample", "gone", "there")]) for n in (1, 2))
    both = pairs.select("sample_1", "sample_2").distinct().join(one, "sample_1").join(two, ["species", "gene_id", "sample_2"])
    noise = F.col("gone_1") * F.col("there_2") + F.col("there_1") * F.col("gone_2")
    return both.groupBy(*PAIR).agg(F.count(F.lit(1)).alias("n_genes"), F.sum(noise).alias("expected"))


#: Steps of equal ratio over which linkage is smoothed: a tenth of a decade.
SMOOTHING = 10**0.1


def inverted_neutral(r: Column) -> Column:
    """The scaled recombination x at which the neutral curve has fallen to ``r`` of its start, 0 where it has not, null where ``r`` is not above 0."""
    # (10 + 2x) / (22 + 26x + 4x^2) = r 10 / 22: the positive root
    b = 260 * r - 44
    root = (-b + F.sqrt(b * b - 160 * r * (220 * r - 220))) / (80 * r)
    return F.when(r >= 1, F.lit(0.0)).when(r > 0, root)


def effective_rates(bins: DataFrame, width: int = 3, reference: float = 9.0) -> DataFrame:
    """(species, distance, ratio, relative, nr, rate): the scaled recombination that explains how far linkage has fallen at each distance.

    ``bins`` has sums (species, bin, num, den, n) by distance. At a distance the sums of
    the bins within ``SMOOTHING`` of it are pooled; ``relative`` is their ratio over that
    of all bins up to ``reference`` bases, and the neutral curve is inverted there.
    """
    at = (F.col("bin") + 0.5) * width
    rows = bins.filter("n > 0").select("species", at.alias("distance"), "num", "den")
    span = math.sqrt(SMOOTHING)
    near = rows.select("species", F.col("distance").alias("_d"), F.col("num").alias("_num"), F.col("den").alias("_den"))
    # a species has as many bins as its genes are long: the band of each is a part of them
    pooled = rows.join(near, "species").filter(F.col("_d").between(F.col("distance") / span, F.col("distance") * span)).groupBy("species", "distance").agg(F.try_divide(F.sum("_num"), F.sum("_den")).alias("ratio"))
    start = rows.filter(F.col("distance") <= reference).groupBy("species").agg(F.try_divide(F.sum("num"), F.sum("den")).alias("_start"))
    told = pooled.join(start, "species").withColumn("relative", F.try_divide("ratio", F.nullif(F.col("_start"), F.lit(0.0))))
    nr = inverted_neutral(F.col("relative"))
    return told.select("species", "distance", "ratio", "relative", nr.alias("nr"), (nr / F.col("distance")).alias("rate"))


def recombination_by_mutation(rates: DataFrame, diversity: DataFrame, fraction: float = 0.5) -> DataFrame:
    """(species, distance, r_by_mu): where linkage first is at most ``fraction`` of its start, and the recombination a mutation that this implies, twice x over distance and ``pi``."""
    first = rates.filter(F.col("relative") <= fraction).groupBy("species").agg(F.min("distance").alias("distance"))
    x = inverted_neutral(F.lit(float(fraction)))
    return first.join(diversity.select("species", "pi"), "species").select("species", "distance", F.try_divide(2 * x / F.col("distance"), F.nullif(F.col("pi"), F.lit(0.0))).alias("r_by_mu"))
