"""The named analyses as queries over the benchmark tables, with their SQL twins.

Values that depend on the order of a floating-point sum are rounded alike on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociweave.functions import expr
from lociweave.operators import changes, coverage, diversity, ecology, genes, inference, linkage, pairs, ranks, snps
from lociweave.sources import adapters as A

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = A.sql(sql)
        return f

    return add


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """``df`` with its fractions rounded; -0 becomes 0."""
    return df.select(*[(F.round(c, places) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _copies(spark: SparkSession, d: str) -> DataFrame:
    g = A.gene_counts(spark, d)
    return genes.copy_number(g, genes.marker_coverage(g))


#: Named pieces of SQL that several queries share.
_PI = "p AS (SELECT *, 2 * FLOOR(rf * depth) * (depth - FLOOR(rf * depth)) / (CAST(depth AS DOUBLE) * (depth - 1)) AS pi FROM a_sites WHERE depth >= 4)"
_HIST = "h AS (SELECT species, sample, depth, COUNT(*) AS n FROM a_site_counts GROUP BY 1, 2, 3)"
_CDF = f"{_HIST}, c AS (SELECT *, CAST(SUM(n) OVER (PARTITION BY species, sample ORDER BY depth) AS DOUBLE) / SUM(n) OVER (PARTITION BY species, sample) AS cdf FROM h WHERE depth > 0)"
_COPY = """m AS (SELECT species, sample, QUANTILE_CONT(depth, 0.5) AS mc FROM a_gene_counts GROUP BY 1, 2),
k AS (SELECT g.*, mc, depth / GREATEST(mc, 1.0::DOUBLE) AS cn FROM a_gene_counts g JOIN m USING (species, sample))"""
_SFS = "s AS (SELECT species, sample, variant_type, depth, alt, COUNT(*) AS n FROM a_sites WHERE depth > 0 GROUP BY ALL)"
_G = "g AS (SELECT *, CASE WHEN f <= 0.2::DOUBLE THEN 0 WHEN f >= 0.8::DOUBLE THEN 1 END AS g FROM a_sites WHERE depth > 0)"
_REL = "r AS (SELECT *, coverage / SUM(coverage) OVER (PARTITION BY sample) AS a FROM a_species_profile)"
_STATE = "t AS (SELECT *, CASE WHEN cn <= 0.05::DOUBLE THEN 0 WHEN cn > 0.6::DOUBLE AND cn < 1.2::DOUBLE THEN 1 END AS st FROM k)"
_DAILY = "dd AS (SELECT species, subject_id, date, SUM(freq * n) / SUM(n) AS f FROM a_strain_frequency GROUP BY 1, 2, 3)"


@_query(f"WITH {_PI} SELECT species, sample, ROUND(AVG(pi), 6) AS mean_pi, ROUND(AVG(NULLIF(pi, 0)), 6) AS mean_pi_variable, ROUND(AVG(depth), 6) AS mean_depth, COUNT(pi) AS n_loci FROM p GROUP BY 1, 2")
def pi_single_sample(spark, d):
    return rounded(diversity.pi_summary(diversity.site_pi(A.annotated(spark, d))))


@_query("SELECT species, sample, ROUND(AVG(2 * rf * (1 - rf)), 6) AS mean_pi, ROUND(AVG(NULLIF(2 * rf * (1 - rf), 0)), 6) AS mean_pi_variable, ROUND(AVG(depth), 6) AS mean_depth, COUNT(*) AS n_loci FROM a_sites WHERE depth >= 4 GROUP BY 1, 2")
def pi_regular(spark, d):
    return rounded(diversity.pi_summary(diversity.site_pi(A.annotated(spark, d), method="regular")))


@_query(
    f"WITH {_PI}, {_COPY} SELECT species, sample, ROUND(AVG(pi), 6) AS mean_pi, ROUND(AVG(NULLIF(pi, 0)), 6) AS mean_pi_variable, ROUND(AVG(p.depth), 6) AS mean_depth, COUNT(pi) AS n_loci "
    "FROM p JOIN k USING (species, gene_id, sample) WHERE cn > 0.6::DOUBLE AND cn < 1.2::DOUBLE AND (rf = 0 OR rf = 1 OR (ROUND_EVEN(rf * p.depth, 0) > 1 AND ROUND_EVEN((1 - rf) * p.depth, 0) > 1)) GROUP BY 1, 2"
)
def pi_filtered(spark, d):
    sites = diversity.site_pi(A.annotated(spark, d)).filter(expr.supported(F.col("rf"), F.col("depth")))
    return rounded(diversity.pi_summary(diversity.in_copy_window(sites, _copies(spark, d))))


_FST = f"""{_PI}, q AS (SELECT species, contig, pos, x.pi AS p1, y.pi AS p2, x.rf AS f1, y.rf AS f2 FROM (SELECT * FROM p WHERE sample = 'S00') x JOIN (SELECT * FROM p WHERE sample = 'S01') y USING (species, contig, pos)),
z AS (SELECT *, (p1 + p2) / 2 AS pw, f1 * (1 - f2) + f2 * (1 - f1) AS pb FROM q), y AS (SELECT *, CASE WHEN pb = 0 THEN 0 ELSE 1 - pw / pb END AS fst FROM z)"""


@_query(f"WITH {_FST} SELECT species, contig, pos, ROUND(pw, 6) AS pi_within, ROUND(pb, 6) AS pi_between, ROUND(fst, 6) AS fst FROM y")
def fst_pair_loci(spark, d):
    return rounded(diversity.fst_loci(A.annotated(spark, d), "S00", "S01").select("species", "contig", "pos", "pi_within", "pi_between", "fst"))


@_query(f"WITH {_FST} SELECT species, 'S00' AS sample_1, 'S01' AS sample_2, ROUND(1 - SUM(pw) / SUM(pb), 6) AS fst_of_means, ROUND(AVG(fst), 6) AS mean_fst, COUNT(*) AS n_loci FROM y GROUP BY 1")
def fst_pair_summary(spark, d):
    return rounded(diversity.fst_summary(diversity.fst_loci(A.annotated(spark, d), "S00", "S01")))


@_query(
    """SELECT a.species, a.sample AS sample_1, b.sample AS sample_2,
       ROUND(SUM((a.f - b.f) * (a.f - b.f) - a.f * (1 - a.f) / (a.depth - 1) - b.f * (1 - b.f) / (b.depth - 1)) / SUM(a.f * (1 - b.f) + b.f * (1 - a.f)), 6) AS hudson_fst, COUNT(*) AS n_loci
       FROM a_sites a JOIN a_sites b USING (species, contig, pos) WHERE a.sample < b.sample AND a.depth >= 4 AND b.depth >= 4 GROUP BY 1, 2, 3"""
)
def fst_hudson(spark, d):
    return rounded(diversity.hudson_fst(A.annotated(spark, d)))


@_query(f"WITH {_HIST} SELECT * FROM h")
def coverage_hist(spark, d):
    return coverage.depth_histogram(A.site_counts(spark, d))


@_query(
    """WITH q AS (SELECT species, contig, pos FROM a_site_counts GROUP BY 1, 2, 3 HAVING SUM(CASE WHEN depth >= 3 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) / 12.0::DOUBLE >= 0.75::DOUBLE)
       SELECT species, sample, depth, COUNT(*) AS n FROM a_site_counts JOIN q USING (species, contig, pos) GROUP BY 1, 2, 3"""
)
def coverage_hist_filtered(spark, d):
    return coverage.filtered_depth_histogram(A.site_counts(spark, d), share=0.75, cohort=12)


@_query("SELECT species, gene_id, sample, ROUND(AVG(CAST(depth AS DOUBLE)), 6) AS mean_depth, COUNT(*) AS n_sites FROM a_sites GROUP BY 1, 2, 3")
def gene_coverage(spark, d):
    return rounded(coverage.gene_coverage(A.annotated(spark, d)))


@_query(f"WITH {_CDF} SELECT species, sample, MIN(depth) AS median FROM c WHERE cdf >= 0.5::DOUBLE GROUP BY 1, 2")
def nonzero_median(spark, d):
    return coverage.nonzero_median(coverage.depth_histogram(A.site_counts(spark, d)), ["species", "sample"])


@_query(
    f"WITH {_CDF}, q AS (SELECT species, sample, CAST(MIN(depth) AS DOUBLE) AS median FROM c WHERE cdf >= 0.5::DOUBLE GROUP BY 1, 2) SELECT *, "
    "CASE WHEN median >= 5 THEN FLOOR(0.3::DOUBLE * median) - 0.5::DOUBLE ELSE 1e9::DOUBLE + 1 END AS lower, CASE WHEN median >= 5 THEN CEIL(3.0::DOUBLE * median) + 0.5::DOUBLE ELSE 1e9::DOUBLE + 1 END AS upper FROM q"
)
def depth_thresholds(spark, d):
    return coverage.depth_windows(A.site_counts(spark, d))


@_query(
    f"WITH {_CDF} SELECT species, sample, MIN(CASE WHEN cdf >= 0.25::DOUBLE THEN depth END) AS q1, MIN(CASE WHEN cdf >= 0.75::DOUBLE THEN depth END) AS q3, "
    "MIN(CASE WHEN cdf >= 0.75::DOUBLE THEN depth END) - MIN(CASE WHEN cdf >= 0.25::DOUBLE THEN depth END) AS iqr FROM c GROUP BY 1, 2"
)
def depth_quartiles(spark, d):
    return coverage.depth_quartiles(coverage.depth_histogram(A.site_counts(spark, d)))


@_query("SELECT species, sample, ROUND(coverage, 6) AS coverage FROM a_species_profile UNION ALL SELECT 'Total', sample, ROUND(SUM(coverage), 6) FROM a_species_profile GROUP BY sample")
def marker_total(spark, d):
    return rounded(coverage.marker_totals(A.species_profile(spark, d)))


@_query("SELECT species, ROUND(SUM(coverage), 6) AS total, CAST(ROW_NUMBER() OVER (ORDER BY SUM(coverage) DESC, species) AS INTEGER) AS place FROM a_species_profile GROUP BY 1")
def species_by_coverage(spark, d):
    return rounded(coverage.species_by_total(A.species_profile(spark, d)))


@_query(
    """WITH q AS (SELECT *, AVG(CASE WHEN 2 * alt >= depth THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) OVER (PARTITION BY species, contig, pos) AS p FROM a_site_counts WHERE depth > 0)
       SELECT species, contig, pos, ROUND(MIN(p), 6) AS alt_freq, ROUND(AVG(CASE WHEN (CASE WHEN p > 0.5 THEN depth - alt ELSE alt END) >= CEIL(depth * 0.1::DOUBLE) + 0.5::DOUBLE THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS snp_freq, COUNT(*) AS n_covered
       FROM q GROUP BY 1, 2, 3"""
)
def snp_prevalence(spark, d):
    return rounded(snps.prevalence(A.site_counts(spark, d)))


@_query("SELECT species, contig, pos, SUM(CASE WHEN alt > CEIL(0.05::DOUBLE * depth) + 0.5::DOUBLE THEN 1 ELSE 0 END) AS n_called, COUNT(*) AS n_samples FROM a_site_counts GROUP BY 1, 2, 3 HAVING n_called > 0")
def snp_calls(spark, d):
    return snps.called_sites(A.site_counts(spark, d))


@_query(
    """WITH q AS (SELECT species, contig, pos, AVG(CASE WHEN 2 * alt >= depth THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS p FROM a_site_counts GROUP BY 1, 2, 3)
       SELECT species, sample, CASE WHEN p > 0.5 THEN 'R' ELSE 'A' END AS polarization, SUM(CASE WHEN p > 0.5 THEN depth - alt ELSE alt END) AS alt, SUM(depth) AS depth FROM a_site_counts JOIN q USING (species, contig, pos) GROUP BY 1, 2, 3"""
)
def polarised_totals(spark, d):
    c = A.site_counts(spark, d)
    return snps.polarised(c, snps.prevalence(c)).groupBy("species", "sample", "polarization").agg(F.sum("alt").alias("alt"), F.sum("depth").alias("depth"))


@_query("SELECT species, contig, pos, ROUND(AVG(CASE WHEN alt::DOUBLE / depth > 0.1::DOUBLE THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS prevalence FROM a_site_counts GROUP BY 1, 2, 3 HAVING prevalence > 0")
def preexisting_snps(spark, d):
    return rounded(snps.preexisting(A.site_counts(spark, d)))


@_query(f"WITH {_SFS} SELECT * FROM s")
def within_sample_sfs(spark, d):
    return snps.spectrum(A.annotated(spark, d))


@_query(
    f"""WITH {_SFS}, q AS (SELECT *, CASE WHEN alt::DOUBLE / depth < 0.05::DOUBLE + 1e-9::DOUBLE THEN 0 WHEN alt::DOUBLE / depth > 1 - 0.05::DOUBLE - 1e-9::DOUBLE THEN depth ELSE alt END AS a FROM s WHERE depth > 1)
        SELECT species, sample, ROUND(SUM(2.0::DOUBLE * a * (depth - a) / (depth::DOUBLE * (depth - 1)) * n) / SUM(n), 6) AS pi, SUM(n) AS n_sites FROM q GROUP BY 1, 2"""
)
def sfs_pi(spark, d):
    return rounded(snps.spectrum_pi(snps.spectrum(A.annotated(spark, d))))


_RATES = f"{_SFS}, q AS (SELECT species, sample, SUM(CASE WHEN alt::DOUBLE / depth > 0.2::DOUBLE AND alt::DOUBLE / depth < 0.8::DOUBLE THEN n ELSE 0 END) AS within, SUM(CASE WHEN alt::DOUBLE / depth >= 0.8::DOUBLE THEN n ELSE 0 END) AS between, SUM(n) AS total FROM s"


@_query(f"WITH {_RATES} WHERE variant_type = '4D' GROUP BY 1, 2) SELECT *, within <= 0.1::DOUBLE * between AS haploid FROM q")
def ploidy(spark, d):
    return snps.ploidy(snps.spectrum(A.annotated(spark, d)))


@_query(f"WITH {_RATES} GROUP BY 1, 2) SELECT * FROM q")
def sfs_rates(spark, d):
    return snps.spectrum_rates(snps.spectrum(A.annotated(spark, d)))


@_query(
    f"WITH {_SFS}, q AS (SELECT species, sample, n, LEAST(alt::DOUBLE / depth, 1 - alt::DOUBLE / depth) AS f FROM s) SELECT species, sample, LEAST(CAST(FLOOR(f * 2 * 10) AS BIGINT), 9) AS bin, SUM(n) AS n FROM q WHERE f > 0 GROUP BY 1, 2, 3"
)
def sfs_binned(spark, d):
    return snps.binned_spectrum(snps.spectrum(A.annotated(spark, d)))


@_query("WITH q AS (SELECT species, sample, CAST(FLOOR(f * 10 + 0.5::DOUBLE) AS BIGINT) AS k FROM a_sites) SELECT species, sample, LEAST(k, 10 - k) AS k, COUNT(*) AS n FROM q GROUP BY 1, 2, 3")
def sfs_folded(spark, d):
    return snps.folded_spectrum(snps.naive_spectrum(A.annotated(spark, d)))


@_query(f"WITH {_HIST}, c AS (SELECT *, CAST(SUM(n) OVER (PARTITION BY species, sample ORDER BY depth) AS DOUBLE) / SUM(n) OVER (PARTITION BY species, sample) AS cdf FROM h) SELECT species, sample, MIN(depth) AS median_depth FROM c WHERE cdf > 0.5::DOUBLE GROUP BY 1, 2")
def sfs_median_depth(spark, d):
    return snps.spectrum_median_depth(snps.spectrum(A.annotated(spark, d)))


@_query("SELECT a.sample AS sample_1, a.subject_id AS subject_id_1, b.sample AS sample_2, b.subject_id AS subject_id_2, a.subject_id = b.subject_id AS same_subject FROM a_samples a JOIN a_samples b ON a.sample < b.sample")
def pairs_all(spark, d):
    return pairs.unordered(A.samples(spark, d))


@_query("WITH q AS (SELECT subject_id, sample AS sample_1, LEAD(sample) OVER (PARTITION BY subject_id ORDER BY ord, sample) AS sample_2 FROM a_samples) SELECT * FROM q WHERE sample_2 IS NOT NULL")
def pairs_consecutive(spark, d):
    return pairs.consecutive(A.samples(spark, d))


@_query("WITH q AS (SELECT subject_id, FIRST(sample ORDER BY ord, sample) AS sample_1, LAST(sample ORDER BY ord, sample) AS sample_2 FROM a_samples GROUP BY 1) SELECT * FROM q WHERE sample_1 <> sample_2")
def pairs_longest(spark, d):
    return pairs.longest(A.samples(spark, d))


@_query("SELECT a.subject_id, a.sample AS sample_1, b.sample AS sample_2 FROM a_samples a JOIN a_samples b ON a.subject_id = b.subject_id AND a.ord < b.ord")
def pairs_nonconsecutive(spark, d):
    return pairs.nonconsecutive(A.samples(spark, d))


@_query("WITH q AS (SELECT subject_id, FIRST(sample ORDER BY ord, sample) AS sample FROM a_samples GROUP BY 1) SELECT a.sample AS sample_1, a.subject_id AS subject_id_1, b.sample AS sample_2, b.subject_id AS subject_id_2 FROM q a JOIN q b ON a.subject_id < b.subject_id")
def pairs_across_subjects(spark, d):
    return pairs.across_subjects(A.samples(spark, d))


@_query("SELECT a.subject_id, a.sample AS sample_1, b.sample AS sample_2, c.sample AS sample_3 FROM a_samples a JOIN a_samples b USING (subject_id) JOIN a_samples c USING (subject_id) WHERE a.ord = 1 AND b.ord = 2 AND c.ord = 3")
def triplets(spark, d):
    return pairs.triplets(A.samples(spark, d))


@_query("SELECT subject_id, MIN(sample) AS sample FROM a_samples GROUP BY 1")
def unique_samples(spark, d):
    return pairs.unique(A.samples(spark, d))


@_query("SELECT subject_id, COUNT(DISTINCT ord) AS n, STRING_AGG(sample, ',' ORDER BY ord, sample) AS samples FROM a_samples GROUP BY 1 HAVING n >= 3")
def longitudinal_subjects(spark, d):
    return pairs.longitudinal(A.samples(spark, d))


@_query("SELECT a.cage, a.sample AS sample_1, b.sample AS sample_2 FROM a_samples a JOIN a_samples b ON a.cage = b.cage AND a.subject_id < b.subject_id")
def pairs_same_cage(spark, d):
    return pairs.same_cage(A.samples(spark, d))


@_query("SELECT a.species, a.sample AS sample_1, b.sample AS sample_2, COUNT(*) AS n_sites FROM a_site_counts a JOIN a_site_counts b USING (species, contig, pos) WHERE a.sample <> b.sample AND a.depth > 0 AND b.depth >= 20 GROUP BY 1, 2, 3")
def pair_opportunities(spark, d):
    return changes.opportunities(A.site_counts(spark, d))


_FLIPS = """mm AS (SELECT species, sample, AVG(depth) AS m FROM a_site_counts WHERE depth > 0 GROUP BY 1, 2), e AS (SELECT * FROM a_sites JOIN mm USING (species, sample) WHERE depth >= 20),
fl AS (SELECT a.species, a.contig, a.pos, a.sample AS sample_1, b.sample AS sample_2, CASE WHEN a.f < b.f THEN 'mutation' ELSE 'reversion' END AS kind FROM e a JOIN e b USING (species, contig, pos)
  WHERE a.sample < b.sample AND ((a.f <= 0.2::DOUBLE AND b.f >= 0.8::DOUBLE) OR (a.f >= 0.8::DOUBLE AND b.f <= 0.2::DOUBLE)) AND ABS(LOG10((a.depth / a.m) / (b.depth / b.m))) < LOG10(3.0::DOUBLE))"""


@_query(f"WITH {_FLIPS} SELECT * FROM fl")
def snp_changes(spark, d):
    return changes.flips(A.site_counts(spark, d))


@_query(f"WITH {_FLIPS} SELECT species, sample_1, sample_2, kind, COUNT(*) AS n FROM fl GROUP BY ALL")
def snp_change_counts(spark, d):
    return changes.change_counts(changes.flips(A.site_counts(spark, d)))


@_query(
    f"""WITH {_COPY}, co AS (SELECT DISTINCT gene_id FROM (SELECT species, gene_id FROM k GROUP BY 1, 2 HAVING AVG(CASE WHEN cn >= 0.3::DOUBLE THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) >= 0.9::DOUBLE)),
    e AS (SELECT a_sites.*, co.gene_id IS NOT NULL AS core FROM a_sites LEFT JOIN co USING (gene_id)),
    pr AS (SELECT species, a.sample AS sample_1, b.sample AS sample_2, a.f AS f1, b.f AS f2, UNNEST(list_filter(['all', CASE WHEN a.variant_type = '4D' THEN '4D' END, CASE WHEN a.variant_type = '1D' THEN '1D' END, CASE WHEN a.core THEN 'core' END], lambda x: x IS NOT NULL)) AS type
      FROM e a JOIN e b USING (species, contig, pos) WHERE a.sample <> b.sample AND b.depth >= 20)
    SELECT species, sample_1, sample_2, type, SUM(CASE WHEN f1 <= 0.2::DOUBLE AND f2 >= 0.8::DOUBLE THEN 1 ELSE 0 END) AS muts, SUM(CASE WHEN f1 >= 0.8::DOUBLE AND f2 <= 0.2::DOUBLE THEN 1 ELSE 0 END) AS revs,
      SUM(CASE WHEN f1 <= 0.2::DOUBLE AND (f2 <= 0.2::DOUBLE OR f2 >= 0.8::DOUBLE) THEN 1 ELSE 0 END) AS mut_opportunities, SUM(CASE WHEN f1 >= 0.8::DOUBLE AND (f2 <= 0.2::DOUBLE OR f2 >= 0.8::DOUBLE) THEN 1 ELSE 0 END) AS rev_opportunities
    FROM pr GROUP BY 1, 2, 3, 4"""
)
def substitution_rates(spark, d):
    return changes.substitution_rates(A.annotated(spark, d), genes.core(_copies(spark, d)))


@_query(
    f"""WITH {_G}, q AS (SELECT species, contig, pos, subject_id, MAX(g) AS g FROM g JOIN a_samples USING (sample) WHERE g IS NOT NULL GROUP BY 1, 2, 3, 4)
        SELECT species, contig, pos, COUNT(*) AS n_hosts, MAX(CASE WHEN g = 1 THEN subject_id END) AS host FROM q GROUP BY 1, 2, 3 HAVING COUNT(*) >= 4 AND SUM(g) = 1"""
)
def private_snvs(spark, d):
    return snps.private_snvs(A.site_counts(spark, d), A.samples(spark, d))


@_query(
    f"""WITH {_G}, q AS (SELECT species, contig, pos, SUM(g) AS k, COUNT(*) AS n FROM g WHERE g IS NOT NULL GROUP BY 1, 2, 3)
        SELECT species, sample, SUM(CASE WHEN k = 1 THEN 1 ELSE 0 END) AS singletons, SUM(CASE WHEN k = 2 THEN 1 ELSE 0 END) AS doubletons FROM g JOIN q USING (species, contig, pos) WHERE g.g = 1 AND n >= 2 GROUP BY 1, 2"""
)
def singletons(spark, d):
    return changes.singletons(A.site_counts(spark, d))


@_query(
    """SELECT species, a.sample AS sample_1, b.sample AS sample_2, ROUND(AVG(a.f * (1 - b.f) + b.f * (1 - a.f)), 6) AS pi_between,
       ROUND(AVG((2.0::DOUBLE * a.alt * (a.depth - a.alt) / (a.depth::DOUBLE * (a.depth - 1)) + 2.0::DOUBLE * b.alt * (b.depth - b.alt) / (b.depth::DOUBLE * (b.depth - 1))) / 2), 6) AS pi_within, COUNT(*) AS n_sites
       FROM a_sites a JOIN a_sites b USING (species, contig, pos) WHERE a.sample < b.sample AND a.variant_type = '4D' AND a.depth > 1 AND b.depth > 1 GROUP BY 1, 2, 3"""
)
def pi_matrix(spark, d):
    return rounded(diversity.pi_matrix(A.annotated(spark, d)))


_POOL = f"{_G}, pf AS (SELECT species, contig, pos, COUNT(*) AS n, LEAST(SUM(g), COUNT(*) - SUM(g)) AS k, LEAST(SUM(g)::DOUBLE / COUNT(*), 1 - SUM(g)::DOUBLE / COUNT(*)) AS f FROM g WHERE g IS NOT NULL GROUP BY 1, 2, 3 HAVING SUM(g) > 0 AND SUM(g) < COUNT(*))"


@_query(f"WITH {_POOL} SELECT species, contig, pos, n, k, ROUND(f, 6) AS f FROM pf")
def pooled_freqs(spark, d):
    return rounded(diversity.pooled_freqs(A.site_counts(spark, d)))


@_query(f"WITH {_POOL} SELECT species, COUNT(*) AS n_sites, ROUND(SUM(2.0::DOUBLE * k * (n - k) / (n::DOUBLE * (n - 1))), 6) AS pi FROM pf GROUP BY 1")
def pooled_counts(spark, d):
    return rounded(diversity.pooled_counts(A.site_counts(spark, d)))


@_query(
    """SELECT species, a.sample AS sample_1, b.sample AS sample_2, SUM(CASE WHEN LEAST(a.f, 1 - a.f) < 0.05::DOUBLE AND LEAST(b.f, 1 - b.f) > 0.2::DOUBLE THEN 1 ELSE 0 END) AS n_new, COUNT(*) AS n_sites
       FROM a_sites a JOIN a_sites b USING (species, contig, pos) WHERE a.sample <> b.sample GROUP BY 1, 2, 3"""
)
def new_snps(spark, d):
    return diversity.new_snps(A.annotated(spark, d))


@_query(
    """WITH q AS (SELECT *, f - AVG(f) OVER (PARTITION BY species, contig, pos) AS g FROM a_sites)
       SELECT species, a.sample AS sample_1, b.sample AS sample_2, ROUND(AVG(a.g * b.g), 6) AS cov, COUNT(*) AS n_sites FROM q a JOIN q b USING (species, contig, pos) WHERE a.sample < b.sample GROUP BY 1, 2, 3"""
)
def genotype_covariance(spark, d):
    return rounded(diversity.genotype_covariance(A.site_counts(spark, d)))


@_query(
    """WITH q AS (SELECT species, a.sample AS s1, b.sample AS s2, AVG(a.f * (1 - b.f) + b.f * (1 - a.f)) AS v FROM a_sites a JOIN a_sites b USING (species, contig, pos) WHERE a.sample < b.sample AND a.variant_type = '4D' AND a.depth > 1 AND b.depth > 1 GROUP BY 1, 2, 3)
       SELECT species, ROUND(1 - AVG(CASE WHEN x.cage = y.cage THEN v END) / AVG(v), 6) AS clade_fst FROM q JOIN a_samples x ON s1 = x.sample JOIN a_samples y ON s2 = y.sample GROUP BY 1"""
)
def clade_fst(spark, d):
    clades = A.samples(spark, d).select("sample", F.col("cage").alias("clade"))
    return rounded(diversity.mean_pair_value(diversity.pi_matrix(A.annotated(spark, d)), clades, "pi_between"))


@_query(f"WITH {_COPY} SELECT species, gene_id, SUM(CASE WHEN cn >= 0.3::DOUBLE THEN 1 ELSE 0 END) AS n_present, ROUND(AVG(CASE WHEN cn >= 0.3::DOUBLE THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS prevalence FROM k GROUP BY 1, 2")
def gene_prevalence(spark, d):
    return rounded(genes.prevalence(_copies(spark, d)))


@_query(f"WITH {_COPY} SELECT species, sample, SUM(CASE WHEN cn >= 0.5::DOUBLE THEN 1 ELSE 0 END) AS n_genes FROM k GROUP BY 1, 2")
def genes_per_sample(spark, d):
    return genes.genes_per_sample(_copies(spark, d))


@_query(
    f"WITH {_COPY}, {_STATE} SELECT species, a.sample AS sample_1, b.sample AS sample_2, SUM(CASE WHEN a.st < b.st THEN 1 ELSE 0 END) AS gains, SUM(CASE WHEN a.st > b.st THEN 1 ELSE 0 END) AS losses, COUNT(*) AS opportunities "
    "FROM t a JOIN t b USING (species, gene_id) WHERE a.sample < b.sample AND a.st IS NOT NULL AND b.st IS NOT NULL GROUP BY 1, 2, 3"
)
def gene_changes(spark, d):
    return genes.gain_loss(_copies(spark, d))


_CORE = f"{_COPY}, core AS (SELECT species, gene_id FROM k GROUP BY 1, 2 HAVING AVG(CASE WHEN cn >= 0.3::DOUBLE THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) >= 0.9::DOUBLE), shared AS (SELECT species, gene_id FROM k GROUP BY 1, 2 HAVING MAX(cn) > 2.0::DOUBLE)"


@_query(f"WITH {_CORE} SELECT * FROM core")
def core_genes(spark, d):
    return genes.core(_copies(spark, d))


@_query(f"WITH {_CORE} SELECT * FROM core EXCEPT SELECT * FROM shared")
def personal_core_genes(spark, d):
    c = _copies(spark, d)
    return genes.personal_core(genes.core(c), genes.shared(c, 2.0))


@_query(f"WITH {_CORE} SELECT * FROM core INTERSECT SELECT * FROM shared")
def core_shared_genes(spark, d):
    c = _copies(spark, d)
    return genes.with_external(genes.core(c), genes.shared(c, 2.0))


@_query(f"WITH {_COPY} SELECT species, gene_id FROM k GROUP BY 1, 2 HAVING MIN(cn) >= 0.3::DOUBLE")
def stringent_genes(spark, d):
    return genes.stringent(_copies(spark, d))


@_query(
    """WITH g AS (SELECT DISTINCT gene_id, CAST(SPLIT_PART(gene_id, '.', 4) AS BIGINT) AS n FROM a_site_info) SELECT a.gene_id, b.gene_id AS neighbour FROM g a JOIN g b ON a.n <> b.n AND ABS(a.n - b.n) <= 2"""
)
def gene_neighbours(spark, d):
    return genes.neighbours(A.site_info(spark, d), 2)


@_query(f"WITH {_REL} SELECT sample, ROUND(-SUM(a * LN(a)), 6) AS shannon, COUNT(*) AS richness FROM r WHERE a > 0 GROUP BY 1")
def shannon(spark, d):
    return rounded(ecology.shannon(A.species_profile(spark, d)))


@_query(
    """WITH q AS (SELECT a.sample AS sample_1, b.sample AS sample_2, SUM(LEAST(a.coverage, b.coverage)) AS low FROM a_species_profile a JOIN a_species_profile b USING (species) WHERE a.sample < b.sample GROUP BY 1, 2), t AS (SELECT sample, SUM(coverage) AS t FROM a_species_profile GROUP BY 1)
       SELECT x.sample AS sample_1, y.sample AS sample_2, ROUND(1 - 2 * COALESCE(low, 0) / (x.t + y.t), 6) AS bray_curtis FROM t x JOIN t y ON x.sample < y.sample LEFT JOIN q ON q.sample_1 = x.sample AND q.sample_2 = y.sample"""
)
def bray_curtis(spark, d):
    return rounded(ecology.bray_curtis(A.species_profile(spark, d)))


@_query(
    f"WITH {_REL} SELECT sample, species, CAST(ROW_NUMBER() OVER w AS INTEGER) AS place, ROUND(a, 6) AS abundance, ROUND(1 - SUM(a) OVER (PARTITION BY sample ORDER BY a DESC, species), 5) + 0.0::DOUBLE AS remaining FROM r WHERE a > 0 WINDOW w AS (PARTITION BY sample ORDER BY a DESC, species)"
)
def rank_abundance(spark, d):
    return rounded(ecology.rank_abundance(A.species_profile(spark, d)).withColumn("remaining", F.round("remaining", 5)))


@_query(f"WITH {_REL} SELECT sample, species, ROUND(LN(a) - AVG(LN(a)) OVER (PARTITION BY sample), 5) + 0.0::DOUBLE AS clr FROM r WHERE a > 0")
def clr(spark, d):
    return rounded(ecology.clr(A.species_profile(spark, d)), 5)


@_query(
    """WITH q AS (SELECT c.sample, c.species, cage, subject_id, alt::DOUBLE / depth AS f FROM a_site_counts c JOIN a_samples USING (sample)), one AS (SELECT species, cage, subject_id, AVG(f) AS m, VAR_SAMP(f) AS v FROM q GROUP BY 1, 2, 3),
       two AS (SELECT species, cage, AVG(m) AS m, VAR_SAMP(m) AS vb, SUM(v) AS v, COUNT(v) AS n FROM one GROUP BY 1, 2) SELECT species, ROUND(SUM(v) / SUM(n), 6) AS within_inner, ROUND(AVG(vb), 6) AS between_inner, ROUND(VAR_SAMP(m), 6) AS between_outer FROM two GROUP BY 1"""
)
def nested_variance(spark, d):
    rows = diversity.with_freq(A.site_counts(spark, d)).join(A.samples(spark, d), "sample")
    return rounded(ecology.nested_variance(rows, "f", "subject_id", "cage"))


@_query("SELECT species, subject_id, region, date, ROUND(freq, 6) AS freq, n, CAST(DENSE_RANK() OVER (PARTITION BY subject_id ORDER BY date) AS INTEGER) AS timepoint FROM a_strain_frequency")
def strain_timepoints(spark, d):
    return rounded(ecology.timepoints(A.strain_frequency(spark, d)))


@_query(f"WITH {_DAILY}, q AS (SELECT species, subject_id, date, ROUND(f, 6) AS freq, CAST(DATE_DIFF('day', LAG(date) OVER w, date) AS INTEGER) AS days, ROUND(f - LAG(f) OVER w, 6) + 0.0::DOUBLE AS delta FROM dd WINDOW w AS (PARTITION BY species, subject_id ORDER BY date)) SELECT * FROM q WHERE delta IS NOT NULL")
def strain_changes(spark, d):
    return rounded(ecology.consecutive_change(A.strain_frequency(spark, d)))


@_query(f"WITH {_DAILY} SELECT species, subject_id, ROUND(FIRST(f ORDER BY date), 6) AS first_freq, ROUND(LAST(f ORDER BY date), 6) AS last_freq, COUNT(DISTINCT date) AS n_dates FROM dd GROUP BY 1, 2")
def strain_first_last(spark, d):
    return rounded(ecology.first_and_last(A.strain_frequency(spark, d)))


@_query("SELECT a.region AS region_1, b.region AS region_2, ROUND(QUANTILE_CONT(ABS(a.freq - b.freq), 0.5), 6) AS median_delta, COUNT(*) AS n FROM a_strain_frequency a JOIN a_strain_frequency b USING (species, subject_id, date) WHERE a.region < b.region GROUP BY 1, 2")
def region_pairs(spark, d):
    return rounded(ecology.region_pairs(A.strain_frequency(spark, d)))


@_query("SELECT region, ROUND(QUANTILE_CONT(freq, 0.25), 6) AS q1, ROUND(QUANTILE_CONT(freq, 0.5), 6) AS median, ROUND(QUANTILE_CONT(freq, 0.75), 6) AS q3 FROM a_strain_frequency GROUP BY 1")
def strain_quartiles(spark, d):
    return rounded(ecology.quartiles(A.strain_frequency(spark, d), ["region"], "freq"))


@_query("SELECT region, ROUND(REGR_SLOPE(freq, n), 6) + 0.0::DOUBLE AS slope, ROUND(REGR_INTERCEPT(freq, n), 6) AS intercept, ROUND(REGR_R2(freq, n), 6) AS r2 FROM a_strain_frequency GROUP BY 1")
def strain_fit(spark, d):
    return rounded(ecology.linear_fit(A.strain_frequency(spark, d), "n", "freq", ["region"]))


@_query(
    """WITH q AS (SELECT region, RANK() OVER (PARTITION BY region ORDER BY n) + (COUNT(*) OVER (PARTITION BY region, n) - 1) / 2.0::DOUBLE AS x, RANK() OVER (PARTITION BY region ORDER BY freq) + (COUNT(*) OVER (PARTITION BY region, freq) - 1) / 2.0::DOUBLE AS y FROM a_strain_frequency)
       SELECT region, ROUND(CORR(x, y), 6) AS rho, COUNT(*) AS n FROM q GROUP BY 1"""
)
def strain_rank_correlation(spark, d):
    return rounded(ranks.rank_correlation(A.strain_frequency(spark, d), "n", "freq", ["region"]))


@_query(
    f"""WITH {_FLIPS}, ch AS (SELECT species, sample_1, sample_2, COUNT(*) AS n FROM fl GROUP BY 1, 2, 3), op AS (SELECT species, a.sample AS sample_1, b.sample AS sample_2, COUNT(*) AS n_sites FROM a_site_counts a JOIN a_site_counts b USING (species, contig, pos) WHERE a.sample <> b.sample AND a.depth > 0 AND b.depth >= 20 GROUP BY 1, 2, 3)
        SELECT CASE WHEN x.subject_id = y.subject_id THEN 'Within host' ELSE 'Between hosts' END AS host, CASE WHEN x.cage = y.cage THEN 'Same cage' ELSE 'Different cage' END AS cage, SUM(COALESCE(n, 0)) AS n_changes, SUM(n_sites) AS n_opportunities, ROUND(SUM(COALESCE(n, 0))::DOUBLE / SUM(n_sites), 6) AS rate
        FROM op LEFT JOIN ch USING (species, sample_1, sample_2) JOIN a_samples x ON op.sample_1 = x.sample JOIN a_samples y ON op.sample_2 = y.sample WHERE op.sample_1 < op.sample_2 GROUP BY 1, 2"""
)
def change_rates(spark, d):
    c, s = A.site_counts(spark, d), A.samples(spark, d)
    counted = changes.flips(c).groupBy("species", "sample_1", "sample_2").agg(F.count(F.lit(1)).alias("n"))
    return rounded(ecology.pooled_rates(counted, changes.opportunities(c).filter("sample_1 < sample_2"), pairs.oriented(pairs.unordered(s), s)))


_LD = f"""{_G}, po AS (SELECT species, contig, pos FROM g WHERE g IS NOT NULL GROUP BY 1, 2, 3 HAVING SUM(g) > 0 AND SUM(g) < COUNT(*)), gg AS (SELECT * FROM g JOIN po USING (species, contig, pos) WHERE g IS NOT NULL),
n AS (SELECT species, a.gene_id, a.pos AS p1, b.pos AS p2, SUM(a.g * b.g)::DOUBLE AS n11, SUM(a.g * (1 - b.g))::DOUBLE AS n10, SUM((1 - a.g) * b.g)::DOUBLE AS n01, SUM((1 - a.g) * (1 - b.g))::DOUBLE AS n00, COUNT(*)::DOUBLE AS n
  FROM gg a JOIN gg b USING (species, contig, sample) WHERE a.gene_id = b.gene_id AND a.pos < b.pos GROUP BY 1, 2, 3, 4)"""


@_query(
    f"""WITH {_LD}, q AS (SELECT species, p2 - p1 AS dist, (n11 / n - (n11 + n10) / n * (n11 + n01) / n) ** 2 AS num, (n11 + n10) / n * (1 - (n11 + n10) / n) * (n11 + n01) / n * (1 - (n11 + n01) / n) AS den FROM n WHERE n >= 4)
        SELECT species, CAST(FLOOR(dist / 3.0::DOUBLE) AS BIGINT) AS bin, ROUND(SUM(num), 6) AS num, ROUND(SUM(den), 6) AS den, COUNT(*) AS n, ROUND(SUM(num) / SUM(den), 6) AS ratio FROM q WHERE den > 1e-9::DOUBLE GROUP BY 1, 2"""
)
def ld_bins(spark, d):
    return rounded(linkage.binned(linkage.sigma_squared(linkage.site_pair_counts(A.annotated(spark, d)))))


@_query(
    f"""WITH {_LD}, q AS (SELECT species, p2 - p1 AS dist, n * (n - 1) * (n - 2) * (n - 3) AS w, n11 * (n11 - 1) * n00 * (n00 - 1) - 2 * n11 * n10 * n01 * n00 + n10 * (n10 - 1) * n01 * (n01 - 1) AS num,
          n10 * (n10 - 1) * n01 * (n01 - 1) + n11 * (n11 - 1) * n00 * (n00 - 1) + 2 * n10 * n01 * n11 * n00
          + n10 * n01 * n00 * (n01 - 1 + n10 - 1 + n00 - 1) + n10 * n01 * n11 * (n10 - 1 + n01 - 1 + n11 - 1) + n11 * n00 * n10 * (n10 - 1 + n00 - 1 + n11 - 1) + n11 * n00 * n01 * (n01 - 1 + n11 - 1 + n00 - 1) AS den FROM n WHERE n >= 4)
        SELECT species, CAST(FLOOR(dist / 3.0::DOUBLE) AS BIGINT) AS bin, ROUND(SUM(num / w), 6) AS num, ROUND(SUM(den / w), 6) AS den, COUNT(*) AS n, ROUND(SUM(num / w) / SUM(den / w), 6) AS ratio FROM q WHERE den / w > 1e-9::DOUBLE GROUP BY 1, 2"""
)
def ld_unbiased_bins(spark, d):
    return rounded(linkage.binned(linkage.unbiased_sigma_squared(linkage.site_pair_counts(A.annotated(spark, d)))))


_HAP = f"""{_G}, gs AS (SELECT DISTINCT species, gene_id, sample FROM g), gp AS (SELECT DISTINCT species, gene_id, pos FROM g),
hp AS (SELECT species, gene_id, sample, STRING_AGG(COALESCE(CAST(g AS VARCHAR), 'N'), '' ORDER BY pos) AS haplotype FROM gs JOIN gp USING (species, gene_id) LEFT JOIN g USING (species, gene_id, pos, sample) GROUP BY 1, 2, 3), hc AS (SELECT species, gene_id, haplotype, COUNT(*) AS n FROM hp GROUP BY 1, 2, 3)"""


@_query(f"WITH {_HAP} SELECT * FROM hc")
def haplotype_counts(spark, d):
    return linkage.haplotype_counts(linkage.haplotypes(A.annotated(spark, d)))


@_query(
    f"""WITH {_HAP}, q AS (SELECT *, n::DOUBLE / SUM(n) OVER (PARTITION BY species, gene_id) AS p, ROW_NUMBER() OVER (PARTITION BY species, gene_id ORDER BY n DESC, haplotype) AS r FROM hc)
        SELECT species, gene_id, COUNT(*) AS k, ROUND(SUM(p * p), 6) AS h1, ROUND(COALESCE(SUM(CASE WHEN r > 1 THEN p * p END), 0), 6) AS h2, ROUND(SUM(CASE WHEN r <= 2 THEN p END) ** 2 + COALESCE(SUM(CASE WHEN r > 2 THEN p * p END), 0), 6) AS h12,
          ROUND(COALESCE(SUM(CASE WHEN r > 1 THEN p * p END), 0) / SUM(p * p), 6) AS h2_h1 FROM q GROUP BY 1, 2"""
)
def haplotype_homozygosity(spark, d):
    return rounded(linkage.homozygosity(linkage.haplotype_counts(linkage.haplotypes(A.annotated(spark, d)))))


@_query(
    """WITH r AS (SELECT c.*, a_samples.subject_id, ord, f FROM a_sites c JOIN a_samples USING (sample)), w AS (SELECT species, contig, pos, subject_id, MAX(CASE WHEN ord = 1 THEN f END) AS f1, MAX(CASE WHEN ord = 2 THEN f END) AS f2, MAX(CASE WHEN ord = 3 THEN f END) AS f3 FROM r GROUP BY 1, 2, 3, 4)
       SELECT species, contig, pos, subject_id, ROUND(f1, 6) AS f1, ROUND(f2, 6) AS f2, ROUND(f3, 6) AS f3 FROM w WHERE f1 <= 0.2::DOUBLE AND f2 IS NOT NULL AND f3 IS NOT NULL AND (f2 >= 0.8::DOUBLE OR f3 >= 0.8::DOUBLE)"""
)
def triplet_sweeps(spark, d):
    return rounded(changes.triplet_sweeps(A.site_counts(spark, d), pairs.triplets(A.samples(spark, d))))


# Further analyses ------------------------------------------------------------------


@_query("SELECT species, sample, CASE WHEN coverage >= 20 THEN 15.0::DOUBLE ELSE 1e9::DOUBLE + 1 END AS lower FROM a_species_profile")
def absolute_thresholds(spark, d):
    return coverage.absolute_windows(A.species_profile(spark, d))


@_query(
    f"""WITH {_CDF}, q AS (SELECT species, sample, CAST(MIN(depth) AS DOUBLE) AS m FROM c WHERE cdf >= 0.5::DOUBLE GROUP BY 1, 2)
        SELECT species, sample, SUM(CASE WHEN m >= 5 AND depth BETWEEN FLOOR(0.3::DOUBLE * m) - 0.5::DOUBLE AND CEIL(3.0::DOUBLE * m) + 0.5::DOUBLE THEN depth ELSE 0 END) AS depth,
          SUM(CASE WHEN m >= 5 AND depth BETWEEN FLOOR(0.3::DOUBLE * m) - 0.5::DOUBLE AND CEIL(3.0::DOUBLE * m) + 0.5::DOUBLE THEN alt ELSE 0 END) AS alt FROM a_site_counts JOIN q USING (species, sample) GROUP BY 1, 2"""
)
def windowed_totals(spark, d):
    c = A.site_counts(spark, d)
    return coverage.within_window(c, coverage.depth_windows(c)).groupBy("species", "sample").agg(F.sum("depth").alias("depth"), F.sum("alt").alias("alt"))


@_query(
    """WITH q AS (SELECT *, COUNT(*) OVER p AS k, AVG(CASE WHEN depth > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) OVER p AS s FROM a_site_counts WINDOW p AS (PARTITION BY species, contig, pos))
       SELECT species, sample, COUNT(*) AS n FROM q WHERE s >= LEAST(4.0::DOUBLE / k, 0.5::DOUBLE) GROUP BY 1, 2"""
)
def prevalent_sites_per_sample(spark, d):
    return snps.prevalent_only(A.site_counts(spark, d)).groupBy("species", "sample").agg(F.count(F.lit(1)).alias("n"))


@_query(f"WITH {_CDF} SELECT species, sample, MIN(depth) AS median FROM c WHERE cdf >= 0.5::DOUBLE GROUP BY 1, 2 HAVING median >= 20")
def high_coverage_samples(spark, d):
    return snps.high_coverage(coverage.nonzero_median(coverage.depth_histogram(A.site_counts(spark, d)), ["species", "sample"]))


@_query(
    f"""WITH {_G}, ho AS (SELECT species, contig, pos, subject_id, MAX(g) AS g FROM g JOIN a_samples USING (sample) WHERE g IS NOT NULL GROUP BY 1, 2, 3, 4), pv AS (SELECT species, contig, pos FROM ho GROUP BY 1, 2, 3 HAVING COUNT(*) >= 4 AND SUM(g) = 1),
    e AS (SELECT a_sites.* FROM a_sites JOIN pv USING (species, contig, pos) WHERE depth >= 5)
    SELECT species, a.sample AS sample_1, b.sample AS sample_2, COUNT(*) AS opportunities, SUM(CASE WHEN b.f <= 0.2::DOUBLE THEN 1 ELSE 0 END) AS reversions FROM e a JOIN e b USING (species, contig, pos)
    WHERE a.sample <> b.sample AND a.f >= 0.8::DOUBLE AND (b.f >= 0.8::DOUBLE OR b.f <= 0.2::DOUBLE) GROUP BY 1, 2, 3"""
)
def tracked_private_snvs(spark, d):
    c = A.site_counts(spark, d)
    return changes.tracked_private(c, snps.private_snvs(c, A.samples(spark, d)))


_CHG = f"{_COPY}, {_STATE}, chg AS (SELECT species, gene_id, a.sample AS sample_1, b.sample AS sample_2, CASE WHEN a.st = 0 THEN 'gain' ELSE 'loss' END AS kind FROM t a JOIN t b USING (species, gene_id) WHERE a.sample < b.sample AND a.st <> b.st)"


@_query(f"WITH {_CHG} SELECT * FROM chg")
def changed_genes(spark, d):
    return genes.changed_genes(_copies(spark, d))


@_query(
    f"""WITH {_COPY}, {_STATE}, lo AS (SELECT species, gene_id, sample, CAST(SPLIT_PART(gene_id, '.', 4) AS BIGINT) AS n FROM t WHERE st = 1),
    w AS (SELECT *, CASE WHEN n - LAG(n) OVER (PARTITION BY species, sample ORDER BY n) <= 2 THEN 0 ELSE 1 END AS fresh FROM lo), r AS (SELECT *, SUM(fresh) OVER (PARTITION BY species, sample ORDER BY n) AS run FROM w)
    SELECT species, sample AS sample_1, sample AS sample_2, '1.1' AS genome, run, COUNT(*) AS n_genes, MIN(n) AS first_gene, MAX(n) AS last_gene FROM r GROUP BY 1, 2, 3, 4, 5"""
)
def gene_runs(spark, d):
    normal = _copies(spark, d).filter("copynum > 0.6 and copynum < 1.2").select("species", "gene_id", F.col("sample").alias("sample_1"), F.col("sample").alias("sample_2"))
    return genes.merged_nearby(normal, 2)


@_query(
    f"""WITH {_COPY}, pr AS (SELECT species, gene_id, AVG(CASE WHEN cn >= 0.3::DOUBLE THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS p FROM k GROUP BY 1, 2), pa AS (SELECT DISTINCT gene_id, variant_type AS pathway FROM a_site_info)
        SELECT species, pathway, CASE WHEN p < 0.1 THEN '0-0.1' WHEN p < 0.5 THEN '0.1-0.5' WHEN p < 0.9 THEN '0.5-0.9' ELSE '0.9-1' END AS bin, COUNT(*) AS n_genes FROM pr JOIN pa USING (gene_id) GROUP BY 1, 2, 3"""
)
def pathway_prevalence(spark, d):
    pathways = A.site_info(spark, d).select("gene_id", F.col("variant_type").alias("pathway")).distinct()
    return genes.pathway_histogram(genes.prevalence(_copies(spark, d)), pathways)


@_query(f"WITH {_REL}, m AS (SELECT species FROM r GROUP BY 1 HAVING MAX(a) > 0.3::DOUBLE) SELECT species, sample, ROUND(coverage, 6) AS coverage, ROUND(a, 6) AS abundance FROM r JOIN m USING (species)")
def abundant_species(spark, d):
    return rounded(ecology.abundant(A.species_profile(spark, d), 0.3))


@_query(
    """WITH x AS (SELECT MIN(region) AS lo, MAX(region) AS hi FROM a_strain_frequency)
       SELECT species, ROUND(LOG2(AVG(CASE WHEN region = hi THEN freq END) + 1) - LOG2(AVG(CASE WHEN region = lo THEN freq END) + 1), 6) + 0.0::DOUBLE AS log2_fold FROM a_strain_frequency, x GROUP BY 1"""
)
def region_log_fold(spark, d):
    s = A.strain_frequency(spark, d)
    low, high = "click", "view"
    return rounded(ecology.log_fold(s, "region", low, high, ["species"], "freq"))


@_query(
    """WITH x AS (SELECT MIN(region) AS lo, MAX(region) AS hi FROM a_strain_frequency), q AS (SELECT species, n, SUM(CASE WHEN region = lo THEN 1 ELSE 0 END) AS na, SUM(CASE WHEN region = hi THEN 1 ELSE 0 END) AS nb FROM a_strain_frequency, x WHERE region IN (lo, hi) GROUP BY 1, 2),
       c AS (SELECT species, ABS(SUM(na) OVER w::DOUBLE / SUM(na) OVER (PARTITION BY species) - SUM(nb) OVER w::DOUBLE / SUM(nb) OVER (PARTITION BY species)) AS g FROM q WINDOW w AS (PARTITION BY species ORDER BY n)) SELECT species, ROUND(MAX(g), 6) AS ks FROM c GROUP BY 1"""
)
def region_ks(spark, d):
    s = A.strain_frequency(spark, d)
    low, high = "click", "view"
    return rounded(ecology.ks_distance(s, "region", low, high, "n", ["species"]))


@_query("SELECT a.sample AS sample_1, b.sample AS sample_2, CASE WHEN a.subject_id = b.subject_id THEN 'Within host' ELSE 'Between hosts' END AS host, CASE WHEN a.cage = b.cage THEN 'Same cage' ELSE 'Different cage' END AS cage FROM a_samples a JOIN a_samples b ON a.sample < b.sample")
def pair_orientation(spark, d):
    s = A.samples(spark, d)
    return pairs.oriented(pairs.unordered(s), s)


@_query(
    """WITH c AS (SELECT a.sample, b.sample AS candidate, ABS(a.ord - b.ord) AS distance, b.ord AS bias FROM a_samples a JOIN a_samples b ON a.cage = b.cage AND a.subject_id <> b.subject_id),
       q AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY sample ORDER BY distance, bias DESC, candidate) AS n FROM c) SELECT sample, distance, bias FROM q WHERE n = 1"""
)
def nearest_sample(spark, d):
    s = A.samples(spark, d)
    other = s.select(F.col("sample").alias("candidate"), F.col("subject_id").alias("_s"), "cage", F.col("ord").alias("bias"))
    c = s.join(other, "cage").filter("subject_id <> _s").select("sample", "candidate", F.abs(F.col("ord") - F.col("bias")).alias("distance"), "bias")
    return pairs.nearest(c, ["sample"], "distance", "bias").select("sample", "distance", "bias")


@_query("SELECT c_custkey AS id, SPLIT_PART(c_mktsegment || '_' || c_name || '_' || CAST(c_custkey AS VARCHAR), '_', 1) AS genus, SUBSTR(c_mktsegment, 1, 1) || '. ' || c_name AS short, c_mktsegment || ' ' || c_name || ' (' || CAST(c_custkey AS VARCHAR) || ')' AS pretty FROM customer")
def species_labels(spark, d):
    name = F.concat_ws("_", "c_mktsegment", "c_name", F.col("c_custkey").cast("string"))
    return spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("id"), expr.genus(name).alias("genus"), expr.abbreviated_species(name).alias("short"), expr.pretty_species(name, number=True).alias("pretty"))


@_query(
    """WITH e AS (SELECT user_id, ts, LAG(ts) OVER (PARTITION BY user_id ORDER BY ts) AS before FROM events) SELECT user_id, COUNT(before) AS n, ROUND(SUM(CAST(FLOOR(EPOCH(ts)) AS BIGINT) - CAST(FLOOR(EPOCH(before)) AS BIGINT)) / 3600.0::DOUBLE, 4) AS hours FROM e GROUP BY 1"""
)
def event_hours(spark, d):
    from pyspark.sql import Window

    e = spark.read.parquet(f"{d}/events.parquet").select("user_id", "ts")
    w = Window.partitionBy("user_id").orderBy("ts")
    gaps = e.withColumn("before", F.lag("ts").over(w)).withColumn("h", expr.hours_between(F.col("before"), F.col("ts")))
    return rounded(gaps.groupBy("user_id").agg(F.count("before").alias("n"), F.sum("h").alias("hours")), 4)


@_query("WITH g AS (SELECT DISTINCT gene_id, CAST(SPLIT_PART(gene_id, '.', 4) AS BIGINT) AS n FROM a_site_info) SELECT a.gene_id AS gene_1, b.gene_id AS gene_2, b.n - a.n AS spacing FROM g a JOIN g b ON b.n BETWEEN a.n + 1 AND a.n + 5")
def genes_near(spark, d):
    near = genes.neighbours(A.site_info(spark, d), 5).select(F.col("gene_id").alias("gene_1"), F.col("neighbour").alias("gene_2"))
    spacing = expr.gene_number(F.col("gene_2")) - expr.gene_number(F.col("gene_1"))
    return near.filter(expr.near(F.col("gene_1"), F.col("gene_2"))).withColumn("spacing", spacing).filter("spacing > 0")


@_query(f"WITH {_LD}, b AS (SELECT DISTINCT species, p2 - p1 AS distance FROM n) SELECT species, distance, ROUND((10 + 2.0::DOUBLE * (0.1::DOUBLE * distance)) / (22 + 26.0::DOUBLE * (0.1::DOUBLE * distance) + 4.0::DOUBLE * (0.1::DOUBLE * distance) * (0.1::DOUBLE * distance)), 6) AS expected FROM b")
def neutral_ld_curve(spark, d):
    at = linkage.site_pair_counts(A.annotated(spark, d)).select("species", (F.col("pos_2") - F.col("pos_1")).alias("distance")).distinct()
    return rounded(at.select("species", "distance", expr.neutral_ld(0.1 * F.col("distance")).alias("expected")))


# Grouped inference: iterative or random, so without SQL; unit tests hold the kernels.


@_query()
def trajectory_pvalues(spark, d):
    return inference.trajectory_pvalues(A.site_counts(spark, d))


@_query(
    """WITH p AS (SELECT DISTINCT alt, depth FROM a_site_counts), t AS (SELECT alt, depth, CASE WHEN LEAST(alt, depth - alt) = 0 THEN 1 ELSE 1 - LIST_SUM(list_transform(range(0, LEAST(alt, depth - alt)), lambda k: EXP(LGAMMA(depth + 1.0::DOUBLE) - LGAMMA(k + 1.0::DOUBLE) - LGAMMA(depth - k + 1.0::DOUBLE) + k * LN(0.01::DOUBLE) + (depth - k) * LN(0.99::DOUBLE)))) END AS pv FROM p)
       SELECT species, sample, COUNT(*) AS n FROM a_site_counts JOIN t USING (alt, depth) WHERE pv < 0.05::DOUBLE GROUP BY 1, 2"""
)
def polymorphic_counts(spark, d):
    return inference.polymorphic(A.site_counts(spark, d)).groupBy("species", "sample").agg(F.count(F.lit(1)).alias("n"))


@_query()
def smoothed_sfs(spark, d):
    return rounded(inference.smoothed_spectra(snps.spectrum(A.annotated(spark, d))))


@_query()
def sample_clades(spark, d):
    return inference.clades(diversity.pi_matrix(A.annotated(spark, d)), "pi_between", 0.42)


@_query()
def community_ordination(spark, d):
    return rounded(inference.ordination(ecology.bray_curtis(A.species_profile(spark, d)), "bray_curtis"))


@_query()
def variance_explained(spark, d):
    return rounded(inference.variance_explained(A.strain_frequency(spark, d), "freq", ["subject_id", "region"]))


_TWO_SIDED = "LEAST(1.0::DOUBLE, t * (0.254829592::DOUBLE + t * (-0.284496736::DOUBLE + t * (1.421413741::DOUBLE + t * (-1.453152027::DOUBLE + t * 1.061405429::DOUBLE)))) * EXP(-z * z / 2.0::DOUBLE))"


@_query(
    f"""WITH c AS (SELECT species, region, freq, COUNT(*) AS n FROM a_strain_frequency GROUP BY 1, 2, 3), g AS (SELECT DISTINCT species, region FROM c),
       p AS (SELECT a.species, a.region AS group_1, b.region AS group_2 FROM g a JOIN g b ON a.species = b.species AND a.region < b.region),
       e AS (SELECT p.species, group_1, group_2, freq, SUM(CASE WHEN region = group_1 THEN n ELSE 0 END)::DOUBLE AS n1, SUM(CASE WHEN region = group_2 THEN n ELSE 0 END)::DOUBLE AS n2 FROM p JOIN c ON c.species = p.species AND c.region IN (group_1, group_2) GROUP BY 1, 2, 3, 4),
       r AS (SELECT *, SUM(n2) OVER (PARTITION BY species, group_1, group_2 ORDER BY freq) - n2 / 2 AS below FROM e),
       s AS (SELECT species, group_1, group_2, SUM(n1) AS a, SUM(n2) AS b, SUM(n1 * below) AS u, SUM((n1 + n2) ** 3 - n1 - n2) AS ties FROM r GROUP BY 1, 2, 3),
       v AS (SELECT *, a * b / 12 * (a + b + 1 - ties / GREATEST((a + b) * (a + b - 1), 1)) AS spread FROM s),
       w AS (SELECT *, GREATEST(ABS(u - a * b / 2) - 0.5::DOUBLE, 0) / SQRT(GREATEST(spread, 1e-300::DOUBLE)) AS z FROM v), y AS (SELECT *, 1 / (1 + 0.3275911::DOUBLE * z / SQRT(2.0::DOUBLE)) AS t FROM w)
       SELECT species, group_1, group_2, ROUND(u, 6) AS u, ROUND(CASE WHEN spread <= 0 THEN 1 ELSE {_TWO_SIDED} END, 6) AS pvalue FROM y"""
)
def region_rank_tests(spark, d):
    return rounded(ranks.rank_sum_tests(A.strain_frequency(spark, d), "region", "freq", ["species"]))


@_query()
def fixation_errors(spark, d):
    s = A.samples(spark, d)
    return rounded(inference.fixation_errors(snps.spectrum(A.annotated(spark, d)).groupBy("species", "sample", "depth", "alt").agg(F.sum("n").alias("n")), pairs.consecutive(s)))


@_query(
    """WITH r AS (SELECT species, sample, depth, alt, COUNT(*) AS n FROM a_site_counts WHERE depth >= 10 GROUP BY 1, 2, 3, 4), k AS (SELECT r.*, UNNEST(range(0, 11)) AS k FROM r), v AS (SELECT * FROM k WHERE k <= alt AND 10 - k <= depth - alt)
       SELECT species, sample, CAST(k AS INTEGER) AS k, ROUND(SUM(n * EXP(LGAMMA(alt + 1.0::DOUBLE) - LGAMMA(k + 1.0::DOUBLE) - LGAMMA(alt - k + 1.0::DOUBLE) + LGAMMA(depth - alt + 1.0::DOUBLE) - LGAMMA(11.0::DOUBLE - k) - LGAMMA(depth - alt - 9.0::DOUBLE + k) - LGAMMA(depth + 1.0::DOUBLE) + LGAMMA(11.0::DOUBLE) + LGAMMA(depth - 9.0::DOUBLE))), 6) AS expected FROM v GROUP BY 1, 2, 3"""
)
def projected_sfs(spark, d):
    return rounded(snps.projected_spectrum(A.site_counts(spark, d)))


@_query()
def median_capped_depth(spark, d):
    reference, targets = [f"S{k:02d}" for k in range(6)], ["S06", "S07"]
    return coverage.median_capped(A.site_counts(spark, d), reference, targets).groupBy("species", "sample").agg(F.sum("depth").alias("depth"), F.sum("alt").alias("alt"))
