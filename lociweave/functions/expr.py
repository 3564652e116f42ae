"""Per-site and per-label column expressions; all stay in the JVM."""

from __future__ import annotations

import math
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

LOWER, UPPER = 0.2, 0.8


def freq(alt: Column, depth: Column) -> Column:
    """Allele frequency, null where nothing was read."""
    return F.try_divide(alt.cast("double"), F.nullif(depth.cast("double"), F.lit(0.0)))


def ref_count(ref_freq: Column, depth: Column) -> Column:
    """Reference reads by truncation of ``ref_freq * depth``."""
    return F.floor(ref_freq * depth)


def ref_count_rounded(ref_freq: Column, depth: Column) -> Column:
    """Reference reads by half-even rounding."""
    return F.bround(ref_freq * depth)


def pi_regular(ref_freq: Column) -> Column:
    return 2 * ref_freq * (1 - ref_freq)


def pi_unbiased(ref_freq: Column, depth: Column) -> Column:
    """Chance that two reads drawn without replacement differ; null below two reads."""
    n1 = ref_count(ref_freq, depth).cast("double")
    d = depth.cast("double")
    return F.try_divide(2 * n1 * (d - n1), d * (d - 1))


def pi_between(f1: Column, f2: Column) -> Column:
    """Chance that one read of each sample differ."""
    return f1 * (1 - f2) + f2 * (1 - f1)


def fst(within: Column, between: Column) -> Column:
    return F.when(between == 0, F.lit(0.0)).otherwise(1 - F.try_divide(within, between))


def hudson(p1: Column, n1: Column, p2: Column, n2: Column) -> tuple[Column, Column]:
    """Numerator and denominator of Hudson's estimator."""
    num = (p1 - p2) * (p1 - p2) - F.try_divide(p1 * (1 - p1), n1 - 1) - F.try_divide(p2 * (1 - p2), n2 - 1)
    return num, p1 * (1 - p2) + p2 * (1 - p1)


def supported(ref_freq: Column, depth: Column) -> Column:
    """Monomorphic, or more than one read on both alleles (half-even rounding of each)."""
    ref, alt = F.bround(ref_freq * depth), F.bround((1 - ref_freq) * depth)
    return (ref_freq == 0) | (ref_freq == 1) | ((ref > 1) & (alt > 1))


def consensus(f: Column, lower: float = LOWER, upper: float = UPPER) -> Column:
    """0 or 1 where the frequency is at most ``lower`` or at least ``upper``, else null."""
    return F.when(f <= lower, F.lit(0)).when(f >= upper, F.lit(1))


def folded(f: Column) -> Column:
    return F.least(f, 1 - f)


def snp_threshold(depth: Column, share: float = 0.05) -> Column:
    """Alternate reads that a call must exceed."""
    return F.ceil(share * depth) + 0.5


def depth_window(median: Column, least: float, low: float = 0.3, high: float = 3.0) -> tuple[Column, Column]:
    """Bounds of the usable depth from the nonzero median; samples below ``least`` get bounds nothing meets."""
    good = median >= least
    return (F.when(good, F.floor(low * median) - 0.5).otherwise(F.lit(1e9 + 1)), F.when(good, F.ceil(high * median) + 0.5).otherwise(F.lit(1e9 + 1)))


def depth_ratio_close(d1: Column, m1: Column, d2: Column, m2: Column, most: float = 3.0) -> Column:
    """Whether two depths, each relative to its sample's mean, differ less than ``most``-fold."""
    ratio = F.try_divide(F.try_divide(d1.cast("double"), m1), F.try_divide(d2.cast("double"), m2))
    return F.abs(F.log10(ratio)) < F.log10(F.lit(most))


def hamming(a: Column, b: Column) -> Column:
    """Positions that differ, and the difference in length."""
    pairs = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: F.when(x.isNull() | y.isNull() | (x != y), 1).otherwise(0))
    return F.aggregate(pairs, F.lit(0), lambda n, x: n + x)


def neutral_ld(nr: Column) -> Column:
    """Expected sigma-squared at a scaled recombination distance."""
    return F.try_divide(10 + 2 * nr, 22 + 26 * nr + 4 * nr * nr)


# likelihoods -----------------------------------------------------------------

#: Logarithms of 0!, 1!, ...; beyond them Stirling's series is exact to ten digits.
_SMALL = 16


def log_factorial(n: Column) -> Column:
    x = n.cast("double")
    series = x * F.log(x) - x + 0.5 * F.log(2 * math.pi * x) + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * x * x * x * x * x)
    return F.when(n < _SMALL, F.get(F.array(*[F.lit(math.lgamma(k + 1)) for k in range(_SMALL)]), n.cast("int"))).otherwise(series)


def log_choose(n: Column, k: Column) -> Column:
    return log_factorial(n) - log_factorial(k) - log_factorial(n - k)


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(X >= k) of n draws: one less the terms below, of which there are as many as k."""
    term = lambda j: F.exp(log_choose(n, j) + j * math.log(p) + (n - j) * math.log1p(-p))
    below = F.aggregate(F.sequence(F.lit(0).cast("bigint"), F.greatest(k - 1, F.lit(0)).cast("bigint")), F.lit(0.0), lambda s, j: s + term(j))
    return F.when(k <= 0, F.lit(1.0)).otherwise(F.greatest(1 - below, F.lit(0.0)))


# labels ---------------------------------------------------------------------

#: Codes in sample names, gut sites in order, mice by diet and cage.
SITES = {"Co": "Colon", "Ce": "Cecum", "I": "Ileum", "J": "Jejunum", "D": "Duodenum"}
SITE_ORDER = {"Duodenum": 1, "Jejunum": 2, "Ileum": 3, "Cecum": 4, "Colon": 5, "Inoculum": 1, "Stool": 1}
UPPER_GUT = ("Duodenum", "Jejunum", "Ileum")
INOCULUM = "TL1gDNAshort"
DIETS = {"1": "Control diet", "2": "Control diet", "3": "Control diet", "4": "Guar gum diet", "5": "Guar gum diet", "6": "Guar gum diet", "7": "Guar gum diet", "8": "Guar gum diet"}
CAGES = {"1": "Cage 1", "2": "Cage 1", "3": "Cage 1", "4": "Cage 2", "5": "Cage 2", "6": "Cage 3", "7": "Cage 3", "8": "Cage 3"}


#: The rational approximation of the error function in Abramowitz and Stegun, 7.1.26, off by 1.5e-7 at most.
ERF_SCALE = 0.3275911
ERF = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def two_sided(z: Column) -> Column:
    """Chance of a normal value at least ``z`` (not negative) away from its mean."""
    x = z / math.sqrt(2)
    t = 1 / (1 + ERF_SCALE * x)
    poly = F.lit(0.0)
    for c in reversed(ERF):
        poly = t * (c + poly)
    return F.least(F.lit(1.0), poly * F.exp(-x * x))


def lookup(values: dict, key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for x in chain(*values.items())]), key)


def known(value: Column, sample: Column, what: str) -> Column:
    """``value``, failing where it is null although the sample is not."""
    return F.when(value.isNull() & sample.isNotNull(), F.raise_error(F.concat(F.lit(f"no {what} in sample name "), sample))).otherwise(value)


def mouse_number(sample: Column) -> Column:
    return F.when(sample == INOCULUM, F.lit("Inoculum")).otherwise(F.substring(sample, 2, 1))


def gut_site(sample: Column) -> Column:
    code = F.regexp_extract(sample, r"^M\d(Co|Ce|I|J|D)", 1)
    return known(F.when(sample == INOCULUM, F.lit("Inoculum")).otherwise(lookup(SITES, code)), sample, "gut site")


def gut_region(site: Column) -> Column:
    return F.when(site == "Inoculum", F.lit("Inoculum")).when(site.isin(*UPPER_GUT), F.lit("Upper gut")).when(site.isNotNull(), F.lit("Lower gut"))


def diet(sample: Column) -> Column:
    return known(F.when(sample == INOCULUM, F.lit("Human diet")).otherwise(lookup(DIETS, mouse_number(sample))), sample, "diet")


def cage(sample: Column) -> Column:
    return known(F.when(sample == INOCULUM, F.lit("Inoculum")).otherwise(lookup(CAGES, mouse_number(sample))), sample, "cage")


def orientation(a: Column, b: Column, what: str) -> Column:
    return F.when(a == b, F.lit(f"Same {what}")).otherwise(F.lit(f"Different {what}"))


def unmerged(sample: Column) -> Column:
    """Without the trailing c of merged replicates; only for cohorts that mark them so."""
    return F.regexp_replace(F.trim(sample), "c$", "")


def genus(species: Column) -> Column:
    return F.substring_index(species, "_", 1)


def pretty_species(species: Column, number: bool = False) -> Column:
    parts = F.split(species, "_")
    name = F.concat_ws(" ", F.get(parts, F.lit(0)), F.get(parts, F.lit(1)))
    return F.concat(name, F.lit(" ("), F.get(parts, F.lit(2)), F.lit(")")) if number else name


def abbreviated_species(species: Column) -> Column:
    return F.concat(F.substring(species, 1, 1), F.lit(". "), F.get(F.split(species, "_"), F.lit(1)))


def genome_of(gene: Column) -> Column:
    return F.substring_index(gene, ".", 2)


def gene_number(gene: Column) -> Column:
    return F.element_at(F.split(gene, r"\."), -1).cast("bigint")


def near(gene_1: Column, gene_2: Column, most: int = 5) -> Column:
    """Whether two genes of one genome are at most ``most`` numbers apart."""
    return F.coalesce((genome_of(gene_1) == genome_of(gene_2)) & (F.abs(gene_number(gene_1) - gene_number(gene_2)) <= most), F.lit(False))


def hours_between(a: Column, b: Column) -> Column:
    return (F.unix_timestamp(b) - F.unix_timestamp(a)) / 3600.0


def instant(text: Column) -> Column:
    return F.to_timestamp(text, "yyyy-MM-dd'T'HH:mm:ss'Z'")
