"""Further analyses as queries over the benchmark tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lociweave.functions import expr
from lociweave.operators import analyses as N
from lociweave.operators import changes, coverage, diversity, genes, linkage, pairs, ranks, snps
from lociweave.plans.queries import _COPY, _FLIPS, _G, _HIST, _LD, _PI, _RATES, _SFS, _copies, _query, rounded
from lociweave.sources import adapters as A

_PAIR = "species, sample_1, sample_2"


@_query(f"WITH {_PI}, s AS (SELECT species, sample, ROUND(AVG(pi), 6) AS mean_pi, COUNT(pi) AS n_loci FROM p GROUP BY 1, 2) SELECT * FROM s WHERE n_loci > 100")
def samples_with_enough_loci(spark, d):
    return rounded(N.enough_loci(diversity.pi_summary(diversity.site_pi(A.annotated(spark, d))).select("species", "sample", "mean_pi", "n_loci"), 100))


@_query(
    """WITH m AS (SELECT s.*, 'H' || CAST(CAST(SUBSTR(sample, 2) AS INTEGER) % 4 AS VARCHAR) AS subject_id FROM a_species_profile s), w AS (SELECT species FROM m GROUP BY 1 HAVING COUNT(DISTINCT sample) >= 3 AND COUNT(DISTINCT subject_id) >= 2)
       SELECT species, sample, ROUND(coverage, 6) AS coverage FROM a_species_profile WHERE species IN (SELECT species FROM w) AND species IN (SELECT species FROM a_species_profile WHERE sample IN ('N3', 'N4'))"""
)
def prevalent_species(spark, d):
    p = A.species_profile(spark, d)
    s = p.select("sample", F.concat(F.lit("H"), (F.substring("sample", 2, 9).cast("int") % 4).cast("string")).alias("subject_id")).distinct()
    return rounded(N.prevalent_species(p, s, s.filter(F.col("sample").isin("N3", "N4")).select("sample")))


@_query("WITH r AS (SELECT species, sample, CASE WHEN species = 'BUILDING' THEN 0 ELSE coverage END AS coverage FROM a_species_profile) SELECT species, sample, ROUND(coverage, 6) AS coverage FROM r WHERE species IN (SELECT species FROM r GROUP BY 1 HAVING SUM(coverage) <> 0)")
def species_not_all_zero(spark, d):
    p = A.species_profile(spark, d).withColumn("coverage", F.when(F.col("species") == "BUILDING", 0.0).otherwise(F.col("coverage")))
    return rounded(N.not_all_zero(p, "species", "coverage").select("species", "sample", "coverage"))


_NCH = f"{_FLIPS}, nc AS (SELECT {_PAIR}, COUNT(*) AS n FROM fl GROUP BY ALL)"


def _counts(spark, d):
    return changes.flips(A.site_counts(spark, d)).groupBy(*N.PAIR).agg(F.count(F.lit(1)).alias("n"))


@_query(f"WITH {_NCH} SELECT nc.* FROM nc JOIN a_samples a ON a.sample = sample_1 JOIN a_samples b ON b.sample = sample_2 WHERE n <= 400 AND a.subject_id = b.subject_id AND NOT (a.cage = b.cage AND a.ord = b.ord)")
def small_changes_of_subjects(spark, d):
    return N.small_changes(_counts(spark, d), A.samples(spark, d), 400)


@_query("SELECT s.sample, accession FROM a_samples s JOIN (SELECT DISTINCT 'S' || LPAD(CAST(visit * 3 AS VARCHAR), 2, '0') AS sample, 'R' || CAST(visit AS VARCHAR) AS accession FROM a_metadata) USING (sample)")
def complete_rows(spark, d):
    from lociweave.operators import samples

    runs = A.metadata(spark, d).select(F.concat(F.lit("S"), F.lpad((F.col("visit") * 3).cast("string"), 2, "0")).alias("sample"), F.concat(F.lit("R"), F.col("visit").cast("string")).alias("accession")).distinct()
    return N.complete(samples.with_runs(A.samples(spark, d), runs).select("sample", "accession"))


@_query("WITH g AS (SELECT subject_id, date FROM a_strain_frequency GROUP BY 1, 2 HAVING COUNT(DISTINCT region) >= 5), e AS (SELECT subject_id FROM g GROUP BY 1 HAVING COUNT(*) >= 5) SELECT species, subject_id, region, date, n FROM a_strain_frequency JOIN g USING (subject_id, date) WHERE subject_id IN (SELECT subject_id FROM e)")
def varied_timepoints(spark, d):
    return N.varied_groups(A.strain_frequency(spark, d).select("species", "subject_id", "region", "date", "n"), "subject_id", "date", "region", 5)


@_query("WITH g AS (SELECT species, subject_id FROM a_strain_frequency GROUP BY 1, 2 HAVING COUNT(DISTINCT date) >= 3) SELECT species, subject_id, region, date, n FROM a_strain_frequency JOIN g USING (species, subject_id)")
def groups_with_timepoints(spark, d):
    return N.groups_with(A.strain_frequency(spark, d).select("species", "subject_id", "region", "date", "n"), ["species", "subject_id"], "date", 3)


@_query("WITH q AS (SELECT species, subject_id, region, date, n, ROW_NUMBER() OVER (PARTITION BY species, subject_id ORDER BY date, region) AS r FROM a_strain_frequency) SELECT species, subject_id, region, date, n FROM q WHERE r = 1")
def first_strain_rows(spark, d):
    return N.first_rows(A.strain_frequency(spark, d).select("species", "subject_id", "region", "date", "n"), ["species", "subject_id"], ["date", "region"])


@_query("WITH q AS (SELECT species, sample, coverage FROM a_species_profile) (SELECT *, 'high' AS e FROM q ORDER BY coverage DESC, sample LIMIT 10) UNION ALL (SELECT *, 'low' FROM q ORDER BY coverage, sample LIMIT 10)".replace("species, sample, coverage FROM a_species", "species, sample, ROUND(coverage, 6) AS coverage FROM a_species").replace(" AS e ", ' AS "end" '))
def extreme_species(spark, d):
    return N.extremes(rounded(A.species_profile(spark, d).select("species", "sample", "coverage")), "coverage", "sample")


@_query("WITH q AS (SELECT species, contig, pos, ROW_NUMBER() OVER (PARTITION BY species ORDER BY md5('3|' || species || '|' || contig || '|' || CAST(pos AS VARCHAR))) AS r FROM (SELECT DISTINCT species, contig, pos FROM a_site_counts)) SELECT species, contig, pos FROM q WHERE r <= 50")
def random_sites(spark, d):
    return N.random_subset(A.site_counts(spark, d).select("species", "contig", "pos").distinct(), "species", ["species", "contig", "pos"], 50, seed=3)


@_query("WITH q AS (SELECT n_regionkey AS subject_id, c_mktsegment AS family, c_nationkey % 3 AS site, SUM(c_acctbal) AS a FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2, 3) SELECT family, ROUND(AVG(a), 4) AS abundance FROM q GROUP BY 1")
def family_abundance(spark, d):
    c, n = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("customer", "nation"))
    rows = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_regionkey").alias("subject_id"), F.col("c_mktsegment").alias("family"), (F.col("c_nationkey") % 3).alias("site"), F.col("c_acctbal").alias("abundance"))
    return rounded(N.family_abundance(rows), 4)


@_query(f"WITH {_RATES} WHERE variant_type = '4D' GROUP BY 1, 2), h AS (SELECT *, within <= 0.1::DOUBLE * between AS haploid FROM q) SELECT species, CAST(SUM(CASE WHEN haploid THEN 1 ELSE 0 END) AS BIGINT) AS n_true, CAST(SUM(CASE WHEN haploid THEN 0 ELSE 1 END) AS BIGINT) AS n_false, COUNT(*) AS total FROM h GROUP BY 1 HAVING total > 1")
def ploidy_tallies(spark, d):
    return N.tallies(snps.ploidy(snps.spectrum(A.annotated(spark, d))), "species", "haploid")


_PIS = f"{_PI}, ps AS (SELECT species, sample, AVG(pi) AS pi FROM p GROUP BY 1, 2)"


def _pis(spark, d):
    return diversity.pi_summary(diversity.site_pi(A.annotated(spark, d))).select("species", "sample", F.col("mean_pi").alias("pi"))


@_query(f"WITH {_PIS}, o AS (SELECT species, AVG(pi) AS m, STDDEV_SAMP(pi) AS sd FROM ps WHERE sample <> 'S00' GROUP BY 1) SELECT species, ROUND(m, 6) AS mean, ROUND(sd, 6) AS sd, ROUND(pi, 6) AS reference, ROUND(m / pi, 6) AS ratio FROM o JOIN ps USING (species) WHERE sample = 'S00'")
def pi_against_reference(spark, d):
    return rounded(N.against_reference(_pis(spark, d), "S00", "pi"))


@_query(f"WITH {_PIS} SELECT species, FIRST(sample ORDER BY pi DESC, sample) AS sample, ROUND(MAX(pi), 6) AS pi FROM ps GROUP BY 1")
def highest_pi(spark, d):
    return rounded(N.highest_in(_pis(spark, d), "pi"))


_GPI = "gp AS (SELECT a.gene_id, a.species, a.sample AS sample_1, b.sample AS sample_2, SUM(a.f * (1 - b.f) + b.f * (1 - a.f)) AS pi, COUNT(*) AS n_sites FROM a_sites a JOIN a_sites b USING (species, contig, pos) WHERE a.sample < b.sample GROUP BY 1, 2, 3, 4)"
_PATH = "pw AS (SELECT DISTINCT gene_id, variant_type AS pathway FROM a_site_info WHERE CAST(SPLIT_PART(gene_id, '.', 4) AS INTEGER) % 3 <> 0)"


def _pathways(spark, d):
    return A.site_info(spark, d).filter(F.element_at(F.split("gene_id", r"\."), -1).cast("int") % 3 != 0).select("gene_id", F.col("variant_type").alias("pathway")).distinct()


@_query(f"WITH {_GPI}, {_PATH}, t AS (SELECT pathway, gp.* FROM gp JOIN pw USING (gene_id) UNION ALL SELECT 'Annotated pathways', gp.* FROM gp WHERE gene_id IN (SELECT gene_id FROM pw)) SELECT pathway, {_PAIR}, ROUND(SUM(pi) / SUM(n_sites), 6) AS mean, CAST(SUM(n_sites) AS BIGINT) AS n_sites FROM t GROUP BY ALL HAVING SUM(n_sites) >= 20")
def pi_by_pathway(spark, d):
    return rounded(N.by_pathway(N.gene_pair_pi(A.annotated(spark, d)), _pathways(spark, d), "pi", "n_sites", 20))


@_query(f"WITH {_G}, gp AS (SELECT a.gene_id, a.species, a.sample AS sample_1, b.sample AS sample_2, SUM(CASE WHEN a.g <> b.g THEN 1 ELSE 0 END) AS flips, COUNT(*) AS n_sites FROM g a JOIN g b USING (species, contig, pos) WHERE a.sample < b.sample AND a.g IS NOT NULL AND b.g IS NOT NULL GROUP BY 1, 2, 3, 4), {_PATH}, t AS (SELECT pathway, gp.* FROM gp JOIN pw USING (gene_id) UNION ALL SELECT 'Annotated pathways', gp.* FROM gp WHERE gene_id IN (SELECT gene_id FROM pw)) SELECT pathway, {_PAIR}, ROUND(SUM(flips)::DOUBLE / SUM(n_sites), 6) AS mean, CAST(SUM(n_sites) AS BIGINT) AS n_sites FROM t GROUP BY ALL HAVING SUM(n_sites) >= 10")
def fixations_by_pathway(spark, d):
    return rounded(N.by_pathway(N.gene_pair_flips(A.annotated(spark, d)), _pathways(spark, d), "flips", "n_sites", 10))


@_query(f"WITH {_HIST} SELECT species, sample, LEAST(CAST(FLOOR(LN(depth::DOUBLE) / LN(100000.0::DOUBLE) * 30) AS BIGINT), 29) AS bin, CAST(SUM(n) AS BIGINT) AS n FROM h WHERE depth > 0 GROUP BY 1, 2, 3")
def depth_log_bins(spark, d):
    return N.log_bins(coverage.depth_histogram(A.site_counts(spark, d)), ["species", "sample"], "depth", "n")


@_query(f"WITH {_HIST} SELECT species, sample, depth, n, CAST(SUM(n) OVER (PARTITION BY species, sample ORDER BY depth) AS BIGINT) AS upto, CAST(SUM(n) OVER (PARTITION BY species, sample ORDER BY depth DESC) AS BIGINT) AS from_on, CAST(SUM(n) OVER (PARTITION BY species, sample) AS BIGINT) AS total FROM h")
def depth_cumulated(spark, d):
    return N.cumulated(coverage.depth_histogram(A.site_counts(spark, d)), ["species", "sample"], "depth", "n")


@_query(f"WITH {_HIST}, c AS (SELECT *, SUM(n) OVER (PARTITION BY species, sample ORDER BY depth) AS u, SUM(n) OVER (PARTITION BY species, sample) AS t FROM h WHERE depth > 10) SELECT species, sample, MIN(depth) AS median FROM c WHERE 2 * u >= t GROUP BY 1, 2")
def median_depth_above(spark, d):
    return N.median_above(coverage.depth_histogram(A.site_counts(spark, d)), ["species", "sample"], "depth", "n", 10)


@_query("SELECT species, contig, pos, sample, ROUND(LEAST(f, 1 - f), 6) AS f FROM a_sites WHERE variant_type = '4D' AND LEAST(f, 1 - f) > 0")
def sample_freqs(spark, d):
    return rounded(N.sample_freqs(A.annotated(spark, d)))


@_query("SELECT species, contig, pos, ROUND(MAX(CASE WHEN sample = 'S00' THEN LEAST(f, 1 - f) END), 6) AS f_S00, ROUND(MAX(CASE WHEN sample = 'S01' THEN LEAST(f, 1 - f) END), 6) AS f_S01, COUNT(DISTINCT sample) = 2 AS all_covered FROM a_sites WHERE variant_type = '4D' AND sample IN ('S00', 'S01') GROUP BY 1, 2, 3")
def joint_freqs(spark, d):
    return rounded(N.joint_freqs(A.annotated(spark, d), ["S00", "S01"]))


@_query(
    """WITH pr AS (SELECT sample AS sample_1, LEAD(sample) OVER (PARTITION BY subject_id ORDER BY ord, sample) AS sample_2 FROM a_samples), r AS (SELECT species, contig, pos, sample, alt::DOUBLE / depth AS f FROM a_site_counts WHERE depth > 0),
       b AS (SELECT species, contig, pos, sample_1, sample_2, x.f AS f1, y.f AS f2 FROM pr JOIN r x ON x.sample = sample_1 JOIN r y USING (species, contig, pos) WHERE y.sample = sample_2 AND (x.f > 0 OR y.f > 0) AND (x.f < 1 OR y.f < 1)),
       t AS (SELECT *, f2 < f1 OR (f2 = f1 AND SUBSTR(md5('0|' || species || '|' || contig || '|' || CAST(pos AS VARCHAR)), 1, 1) < '8') AS flip FROM b)
       SELECT species, contig, pos, sample_1, sample_2, ROUND(CASE WHEN flip THEN 1 - f1 ELSE f1 END, 6) AS f1, ROUND(CASE WHEN flip THEN 1 - f2 ELSE f2 END, 6) AS f2 FROM t"""
)
def temporal_freqs(spark, d):
    return rounded(N.temporal_freqs(A.site_counts(spark, d), pairs.consecutive(A.samples(spark, d))))


_TCOPY = "kc AS (SELECT species, gene_id, sample, CASE WHEN (CAST(SPLIT_PART(gene_id, '.', 4) AS INTEGER) + CAST(SUBSTR(sample, 2) AS INTEGER)) % 4 = 0 THEN 0.01::DOUBLE ELSE 0.7::DOUBLE END AS c FROM a_gene_counts)"


def _absences(spark, d):
    k = F.element_at(F.split("gene_id", r"\."), -1).cast("int") + F.substring("sample", 2, 9).cast("int")
    return A.gene_counts(spark, d).select("species", "gene_id", "sample", F.when(k % 4 == 0, 0.01).otherwise(0.7).alias("copynum"))


@_query(
    f"""WITH {_TCOPY}, r AS (SELECT kc.*, subject_id, ord FROM kc JOIN a_samples USING (sample)), w AS (SELECT species, gene_id, subject_id, MAX(CASE WHEN ord = 1 THEN c END) AS c1, MAX(CASE WHEN ord = 2 THEN c END) AS c2, MAX(CASE WHEN ord = 3 THEN c END) AS c3 FROM r GROUP BY 1, 2, 3)
        SELECT * FROM w WHERE c1 IS NOT NULL AND c2 IS NOT NULL AND c3 IS NOT NULL AND LEAST(c1, c2, c3) <= 0.05::DOUBLE AND GREATEST(c1, c2, c3) > 0.6::DOUBLE"""
)
def triplet_copies(spark, d):
    return N.triplet_copies(_absences(spark, d), pairs.triplets(A.samples(spark, d)))


@_query(f"WITH {_TCOPY} SELECT species, gene_id, a.sample AS sample_1, b.sample AS sample_2, CASE WHEN a.c < b.c THEN 'gain' ELSE 'loss' END AS kind FROM kc a JOIN kc b USING (species, gene_id) WHERE a.sample < b.sample AND a.c <> b.c")
def changed_genes_with_absences(spark, d):
    return genes.changed_genes(_absences(spark, d))


@_query(f"WITH {_TCOPY} SELECT species, a.sample AS sample_1, b.sample AS sample_2, SUM(CASE WHEN a.c <= 0.05::DOUBLE AND b.c >= 0.6::DOUBLE THEN 1 ELSE 0 END) AS gains, SUM(CASE WHEN b.c <= 0.05::DOUBLE AND a.c >= 0.6::DOUBLE THEN 1 ELSE 0 END) AS losses FROM kc a JOIN kc b USING (species, gene_id) WHERE a.sample < b.sample GROUP BY 1, 2, 3")
def split_gene_changes(spark, d):
    from lociweave.operators.diversity import site_pairs

    both = site_pairs(_absences(spark, d), ("copynum",), ("species", "gene_id"))
    return N.split_gene_changes(both.withColumnsRenamed({"copynum_1": "c1", "copynum_2": "c2"}))


@_query("SELECT a.c_custkey AS id, list_filter(range(0, 18), lambda i: SUBSTR(a.c_name, CAST(i + 1 AS INTEGER), 1) <> SUBSTR(b.c_name, CAST(i + 1 AS INTEGER), 1))::VARCHAR AS positions FROM customer a JOIN customer b ON b.c_custkey = a.c_custkey + 7")
def sequence_differences(spark, d):
    c = spark.read.parquet(f"{d}/customer.parquet").select("c_custkey", "c_name")
    other = c.select((F.col("c_custkey") - 7).alias("c_custkey"), F.col("c_name").alias("other"))
    found = N.sequence_differences(F.col("c_name"), F.col("other"))
    return c.join(other, "c_custkey").select(F.col("c_custkey").alias("id"), F.concat(F.lit("["), F.array_join(F.transform(found, lambda x: x.cast("string")), ", "), F.lit("]")).alias("positions"))


_CLADE = f"{_G}, cl AS (SELECT species, contig, pos, CAST(CAST(SUBSTR(sample, 2) AS INTEGER) % 3 AS INTEGER) AS clade, SUM(g) AS k, COUNT(*) AS n FROM g WHERE g IS NOT NULL GROUP BY 1, 2, 3, 4)"


def _clades(spark, d):
    return A.site_counts(spark, d).select("species", "sample").distinct().withColumn("clade", F.substring("sample", 2, 9).cast("int") % 3)


@_query(f"WITH {_CLADE} SELECT species, contig, pos, clade, CAST(k AS BIGINT) AS k, n FROM cl")
def clade_freqs(spark, d):
    return N.clade_freqs(A.site_counts(spark, d), _clades(spark, d))


@_query(
    f"""WITH {_CLADE}, r AS (SELECT species, contig, pos, SUM(k) AS k, SUM(n) AS n, SUM(CASE WHEN k > 0 AND k < n THEN 1 ELSE 0 END) AS i, SUM(CASE WHEN k > 0 THEN 1 ELSE 0 END) AS w, SUM(CASE WHEN k < n THEN 1 ELSE 0 END) AS o FROM cl GROUP BY 1, 2, 3)
        SELECT species, COUNT(*) AS polymorphic, SUM(CASE WHEN k = 1 OR k = n - 1 THEN 1 ELSE 0 END) AS singletons, SUM(CASE WHEN i > 1 OR (i = 1 AND w > 1 AND o > 1) THEN 1 ELSE 0 END) AS inconsistent FROM r WHERE k > 0 AND k < n GROUP BY 1"""
)
def phylogenetic_consistency(spark, d):
    return N.phylogenetic_consistency(N.clade_freqs(A.site_counts(spark, d), _clades(spark, d)))


@_query(
    """WITH c AS (SELECT DISTINCT species, sample, CAST(CAST(SUBSTR(sample, 2) AS INTEGER) % 3 AS INTEGER) AS clade, cage FROM a_site_counts JOIN a_samples USING (sample)), a AS (SELECT species, cage, clade, ROW_NUMBER() OVER (PARTITION BY species, cage ORDER BY sample) AS r FROM c),
       b AS (SELECT species, cage, sample, ROW_NUMBER() OVER (PARTITION BY species, cage ORDER BY md5('5|' || species || '|' || sample), sample) AS r FROM c) SELECT species, cage, clade, sample FROM a JOIN b USING (species, cage, r)"""
)
def shuffled_clades(spark, d):
    return N.shuffled_clades(_clades(spark, d).join(A.samples(spark, d).select("sample", "cage"), "sample"), "cage", seed=5)


_DIST = f"""{_G}, pm AS (SELECT species, a.sample AS sample_1, b.sample AS sample_2, AVG(a.f * (1 - b.f) + b.f * (1 - a.f)) AS d FROM a_sites a JOIN a_sites b USING (species, contig, pos) WHERE a.sample < b.sample AND a.variant_type = '4D' AND a.depth > 1 AND b.depth > 1 GROUP BY 1, 2, 3),
gc AS (SELECT species, contig, pos, sample, CASE WHEN alt::DOUBLE / depth <= 0.2::DOUBLE THEN 0 WHEN alt::DOUBLE / depth >= 0.8::DOUBLE THEN 1 END AS g FROM a_site_counts WHERE depth > 0),
sd AS (SELECT species, contig, pos, MIN(CASE WHEN a.g <> b.g THEN d END) AS between, MAX(CASE WHEN a.g = b.g THEN d END) AS within_max, AVG(CASE WHEN a.g = b.g THEN d END) AS within_mean
  FROM gc a JOIN gc b USING (species, contig, pos) JOIN pm USING (species) WHERE a.sample < b.sample AND a.g IS NOT NULL AND b.g IS NOT NULL AND (a.g = 1 OR b.g = 1) AND sample_1 = a.sample AND sample_2 = b.sample GROUP BY 1, 2, 3 HAVING between IS NOT NULL AND within_max IS NOT NULL)"""


def _snv_distances(spark, d):
    return N.snv_distances(A.site_counts(spark, d), diversity.pi_matrix(A.annotated(spark, d)), "pi_between")


@_query(f"WITH {_DIST} SELECT species, contig, pos, ROUND(between, 6) AS between, ROUND(within_max, 6) AS within_max, ROUND(within_mean, 6) AS within_mean FROM sd")
def snv_distances(spark, d):
    return rounded(_snv_distances(spark, d))


@_query(f"WITH {_DIST}, n AS (SELECT species, COUNT(*) AS n FROM sd GROUP BY 1), k AS (SELECT CAST(k AS INTEGER) AS step, 0.2::DOUBLE * EXP(LN(3.0::DOUBLE) / 49 * k) AS d FROM (SELECT UNNEST(range(0, 50)) AS k)) SELECT species, step, ROUND(d, 6) AS d, ROUND(COUNT(*)::DOUBLE / MAX(n), 6) AS share FROM sd JOIN n USING (species) JOIN k ON between <= d AND within_max >= 1.02::DOUBLE * d GROUP BY 1, 2, 3")
def inconsistency_curve(spark, d):
    # the table's distances lie close together
    return rounded(N.inconsistency_curve(_snv_distances(spark, d), low=0.2, high=0.6, apart=1.02))


@_query(f"WITH {_FLIPS} SELECT {_PAIR}, SUM(CASE WHEN kind = 'mutation' THEN 1 ELSE 0 END) AS mutations, SUM(CASE WHEN kind = 'reversion' THEN 1 ELSE 0 END) AS reversions FROM fl GROUP BY ALL")
def split_changes(spark, d):
    return N.split_changes(changes.flips(A.site_counts(spark, d), with_freqs=True))


_SUBS = f"""{_COPY}, co AS (SELECT DISTINCT gene_id FROM (SELECT species, gene_id FROM k GROUP BY 1, 2 HAVING AVG(CASE WHEN cn >= 0.3::DOUBLE THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) >= 0.9::DOUBLE)),
pr AS (SELECT species, a.sample AS sample_1, b.sample AS sample_2, a.f AS f1, b.f AS f2, a.variant_type AS type FROM a_sites a JOIN a_sites b USING (species, contig, pos) WHERE a.sample <> b.sample AND b.depth >= 20 AND a.variant_type IN ('1D', '4D')),
su AS (SELECT {_PAIR}, type, SUM(CASE WHEN f1 <= 0.2::DOUBLE AND f2 >= 0.8::DOUBLE THEN 1 ELSE 0 END) AS muts, SUM(CASE WHEN f1 >= 0.8::DOUBLE AND f2 <= 0.2::DOUBLE THEN 1 ELSE 0 END) AS revs,
  SUM(CASE WHEN f1 <= 0.2::DOUBLE AND (f2 <= 0.2::DOUBLE OR f2 >= 0.8::DOUBLE) THEN 1 ELSE 0 END) AS mo, SUM(CASE WHEN f1 >= 0.8::DOUBLE AND (f2 <= 0.2::DOUBLE OR f2 >= 0.8::DOUBLE) THEN 1 ELSE 0 END) AS ro FROM pr GROUP BY ALL)"""


def _rates(spark, d):
    return changes.substitution_rates(A.annotated(spark, d), genes.core(_copies(spark, d))).filter("type in ('1D', '4D')")


@_query(f"WITH {_SUBS}, g AS (SELECT species, a.sample AS sample_1, b.sample AS sample_2 FROM (SELECT DISTINCT species FROM su), a_samples a, a_samples b WHERE a.sample <> b.sample) SELECT {_PAIR}, CAST(COALESCE(muts, 0) AS BIGINT) AS muts, CAST(COALESCE(revs, 0) AS BIGINT) AS revs, CAST(COALESCE(mo, 0) AS BIGINT) AS mut_opportunities, CAST(COALESCE(ro, 0) AS BIGINT) AS rev_opportunities FROM g LEFT JOIN (SELECT * FROM su WHERE type = '4D') USING ({_PAIR})")
def substitution_matrices(spark, d):
    return N.rate_matrix(_rates(spark, d), A.samples(spark, d), "4D", ["muts", "revs", "mut_opportunities", "rev_opportunities"])


@_query(f"WITH {_SUBS}, g AS (SELECT species, a.sample AS sample_1, b.sample AS sample_2 FROM (SELECT DISTINCT species FROM su), a_samples a, a_samples b WHERE a.sample <> b.sample) SELECT {_PAIR}, CAST(COALESCE(muts + revs, 0) AS BIGINT) AS differences, CAST(COALESCE(mo + ro, 0) AS BIGINT) AS opportunities FROM g LEFT JOIN (SELECT * FROM su WHERE type = '1D') USING ({_PAIR})")
def difference_matrix(spark, d):
    rates = _rates(spark, d).select(*N.PAIR, "type", (F.col("muts") + F.col("revs")).alias("differences"), (F.col("mut_opportunities") + F.col("rev_opportunities")).alias("opportunities"))
    return N.rate_matrix(rates, A.samples(spark, d), "1D", ["differences", "opportunities"])


_RATIO = f"{_SUBS}, ty AS (SELECT {_PAIR}, SUM(CASE WHEN type = '1D' THEN muts + revs ELSE 0 END) AS n1, SUM(CASE WHEN type = '1D' THEN mo + ro ELSE 0 END) AS l1, SUM(CASE WHEN type = '4D' THEN muts + revs ELSE 0 END) AS n4, SUM(CASE WHEN type = '4D' THEN mo + ro ELSE 0 END) AS l4 FROM su GROUP BY ALL), dn AS (SELECT {_PAIR}, (n4 + 1.0::DOUBLE) / (l4 + 1) AS ds, ((n1 + 1.0::DOUBLE) / (l1 + 1)) / ((n4 + 1.0::DOUBLE) / (l4 + 1)) AS dnds FROM ty WHERE l1 > 0 AND l4 > 0)"


@_query(f"WITH {_RATIO} SELECT {_PAIR}, ROUND(ds, 6) AS ds, ROUND(dnds, 6) AS dnds FROM dn")
def selection_ratios(spark, d):
    return rounded(N.selection_ratio(_rates(spark, d)))


@_query(f"WITH {_RATIO}, q AS (SELECT species, ROUND(ds, 9) AS ds, dnds FROM dn), w AS (SELECT species, ds, AVG(dnds) OVER (PARTITION BY species ORDER BY ds) AS b, COUNT(*) OVER (PARTITION BY species ORDER BY ds) AS n, SUM(dnds) OVER (PARTITION BY species) AS s, SUM(dnds) OVER (PARTITION BY species ORDER BY ds) AS u, COUNT(*) OVER (PARTITION BY species) AS m FROM q) SELECT DISTINCT species, ROUND(ds, 6) AS ds, ROUND(b, 5) AS below, CASE WHEN m > n THEN ROUND((s - u) / (m - n), 5) END AS above, n AS n_below FROM w")
def cumulative_selection(spark, d):
    r = N.selection_ratio(_rates(spark, d)).withColumn("ds", F.round("ds", 9))
    out = N.cumulative_ratio(r)
    return out.select("species", F.round("ds", 6).alias("ds"), F.round("below", 5).alias("below"), F.round("above", 5).alias("above"), "n_below").distinct()


@_query("WITH q AS (SELECT species, a.sample AS sample_1, b.sample AS sample_2, AVG(CASE WHEN a.variant_type = '1D' THEN a.f * (1 - b.f) + b.f * (1 - a.f) END) AS n, AVG(CASE WHEN a.variant_type = '4D' THEN a.f * (1 - b.f) + b.f * (1 - a.f) END) AS s FROM a_sites a JOIN a_sites b USING (species, contig, pos) WHERE a.sample < b.sample AND a.depth > 1 AND b.depth > 1 GROUP BY 1, 2, 3) SELECT species, sample_1, sample_2, ROUND(n / s, 6) AS ratio FROM q WHERE n IS NOT NULL AND s IS NOT NULL")
def pi_ratio(spark, d):
    s = A.annotated(spark, d)
    return rounded(N.ratio_of_pairs(diversity.pi_matrix(s, "1D"), diversity.pi_matrix(s, "4D"), "pi_between"))


_OPP = "op AS (SELECT species, a.sample AS sample_1, b.sample AS sample_2, COUNT(*) AS n_sites FROM a_site_counts a JOIN a_site_counts b USING (species, contig, pos) WHERE a.sample < b.sample AND a.depth > 0 AND b.depth >= 20 GROUP BY 1, 2, 3)"


@_query(f"WITH {_NCH}, {_OPP} SELECT {_PAIR}, n_sites, COALESCE(n, 0) AS n, CASE WHEN COALESCE(n, 0) = 0 THEN 'none' WHEN n <= 4 THEN 'modification' WHEN n >= 8 THEN 'replacement' ELSE 'unclear' END AS class FROM op LEFT JOIN nc USING ({_PAIR}) WHERE n_sites >= 10")
def gated_change_classes(spark, d):
    opp = changes.opportunities(A.site_counts(spark, d)).filter("sample_1 < sample_2")
    return N.gated_changes(_counts(spark, d), opp, 10).withColumn("class", N.change_class(F.col("n"), 4, 8))


@_query(f"WITH {_NCH} SELECT species, sample_1, FIRST(sample_2 ORDER BY n, sample_2) AS sample_2, MIN(n) AS n FROM nc GROUP BY 1, 2")
def closest_other(spark, d):
    return N.closest_other(_counts(spark, d), "n")


@_query(f"WITH {_NCH} SELECT species, n AS at, CAST(SUM(SUM(n)) OVER (PARTITION BY species ORDER BY n) AS BIGINT) AS changes FROM nc GROUP BY 1, 2")
def accumulated_changes(spark, d):
    return ranks.accumulated(_counts(spark, d).select("species", F.col("n").alias("at"), F.col("n").alias("changes")), "species", "at", "changes")


@_query(f"WITH {_TCOPY}, ch AS (SELECT DISTINCT species, sample, gene_id FROM kc WHERE c < 0.05::DOUBLE) SELECT ch.species, ch.sample, ch.gene_id, COALESCE(description, '') AS description FROM ch LEFT JOIN (SELECT '1.1.peg.' || CAST(line AS VARCHAR) AS gene_id, description FROM a_pangenome WHERE line % 2 = 0) USING (gene_id)")
def annotated_gene_changes(spark, d):
    ch = _absences(spark, d).filter("copynum < 0.05").select("species", "sample", "gene_id").distinct()
    return N.annotated_changes(ch, A.pangenome(spark, d).filter("line % 2 = 0").select(F.concat(F.lit("1.1.peg."), F.col("line").cast("string")).alias("gene_id"), "description"))


@_query(
    f"""WITH {_TCOPY}, ch AS (SELECT DISTINCT species || '/' || sample AS key, gene_id FROM kc WHERE c < 0.05::DOUBLE), z AS (SELECT key, COUNT(*) AS size FROM ch GROUP BY 1), po AS (SELECT DISTINCT species || '/' || sample AS key, gene_id FROM kc),
        q AS (SELECT po.key, trial, gene_id, size, ROW_NUMBER() OVER (PARTITION BY po.key, trial ORDER BY md5('9|' || po.key || '|' || gene_id || '|' || CAST(trial AS VARCHAR)), gene_id) AS r FROM po JOIN z USING (key), (SELECT CAST(UNNEST(range(1, 6)) AS INTEGER) AS trial)) SELECT key, trial, gene_id FROM q WHERE r <= size"""
)
def gene_change_null(spark, d):
    # a sample's changed genes against as many of all its genes
    k = _absences(spark, d).withColumn("key", F.concat_ws("/", "species", "sample"))
    return N.control_draws(k.filter("copynum < 0.05").select("key", "gene_id").distinct(), k.select("key", "gene_id").distinct(), "key", 5, seed=9)


@_query("WITH h AS (SELECT l_partkey % 50 AS gene_id, l_suppkey % 9 AS genome, l_suppkey % 9 = l_partkey % 9 AS own, l_quantity AS score FROM lineitem), o AS (SELECT gene_id, MAX(score) AS s FROM h WHERE own GROUP BY 1), b AS (SELECT gene_id, genome, MAX(score) AS s FROM h WHERE NOT own GROUP BY 1, 2) SELECT gene_id, COUNT(*) AS genomes, SUM(CASE WHEN b.s >= o.s THEN 1 ELSE 0 END) AS strong FROM b JOIN o USING (gene_id) GROUP BY 1")
def ortholog_matches(spark, d):
    own = F.col("l_suppkey") % 9 == F.col("l_partkey") % 9
    return N.ortholog_matches(spark.read.parquet(f"{d}/lineitem.parquet").select((F.col("l_partkey") % 50).alias("gene_id"), (F.col("l_suppkey") % 9).alias("genome"), own.alias("own"), F.col("l_quantity").alias("score")))


@_query("WITH h AS (SELECT c_mktsegment AS g, c_nationkey AS b, COUNT(*) AS n FROM customer GROUP BY 1, 2) SELECT g, ROUND(LGAMMA(SUM(n) + 1.0::DOUBLE) + SUM(n * LN(1 / 25.0::DOUBLE) - LGAMMA(n + 1.0::DOUBLE)), 6) AS loglikelihood FROM h GROUP BY 1")
def multinomial_loglikelihoods(spark, d):
    h = spark.read.parquet(f"{d}/customer.parquet").groupBy(F.col("c_mktsegment").alias("g"), F.col("c_nationkey").alias("b")).agg(F.count(F.lit(1)).alias("n"))
    return rounded(N.multinomial_loglikelihood(h.withColumn("p", F.lit(1 / 25.0)), ["g"], "n", "p"))


@_query("SELECT species, sample, ROUND(SUM(LGAMMA(depth + 1.0::DOUBLE) - LGAMMA(alt + 1.0::DOUBLE) - LGAMMA(depth - alt + 1.0::DOUBLE) + alt * LN(0.3::DOUBLE) + (depth - alt) * LN(0.7::DOUBLE)), 4) AS loglikelihood FROM a_site_counts GROUP BY 1, 2")
def binomial_loglikelihoods(spark, d):
    return rounded(N.binomial_loglikelihood(A.site_counts(spark, d), ["species", "sample"], "alt", "depth", F.lit(0.3)), 4)


_FOLD = "hf AS (SELECT species, sample, CAST(FLOOR(f * 10 + 0.5::DOUBLE) AS BIGINT) AS k, COUNT(*) AS n FROM a_sites GROUP BY 1, 2, 3)"


@_query(f"WITH {_FOLD}, fo AS (SELECT species, sample, LEAST(k, 10 - k) AS m, SUM(n) AS n, SUM(CASE WHEN 2 * k <= 10 THEN n ELSE 0 END) AS a FROM hf GROUP BY 1, 2, 3) SELECT species, sample, ROUND(SUM(LGAMMA(n + 1.0::DOUBLE) - LGAMMA(a + 1.0::DOUBLE) - LGAMMA(n - a + 1.0::DOUBLE) + n * LN(0.5::DOUBLE)), 5) AS loglikelihood FROM fo WHERE 2 * m < 10 GROUP BY 1, 2")
def reversal_loglikelihoods(spark, d):
    return rounded(N.reversal_loglikelihood(snps.naive_spectrum(A.annotated(spark, d)), ["species", "sample"], "k", "n", 10), 5)


@_query(f"WITH {_FOLD}, x AS (SELECT species, sample, ROUND(k / 10.0::DOUBLE, 9) AS x, n AS a, n AS b FROM hf UNION ALL SELECT species, sample, ROUND(1 - k / 10.0::DOUBLE, 9), 0, n FROM hf), e AS (SELECT species, sample, x, SUM(a) AS a, SUM(b) AS b FROM x GROUP BY 1, 2, 3), g AS (SELECT species, sample, ABS(SUM(a) OVER w::DOUBLE / SUM(a) OVER v - SUM(b) OVER w::DOUBLE / SUM(b) OVER v) AS g FROM e WINDOW w AS (PARTITION BY species, sample ORDER BY x), v AS (PARTITION BY species, sample)) SELECT species, sample, ROUND(MAX(g), 6) AS ks FROM g GROUP BY 1, 2")
def symmetrised_ks(spark, d):
    h = snps.naive_spectrum(A.annotated(spark, d)).withColumn("x", F.col("k") / 10.0)
    return rounded(N.symmetrised_ks(h, ["species", "sample"], "x", "n"))


@_query(f"WITH {_LD}, q AS (SELECT species, p2 - p1 AS dist, (n11 / n - (n11 + n10) / n * (n11 + n01) / n) ** 2 AS num, (n11 + n10) / n * (1 - (n11 + n10) / n) * (n11 + n01) / n * (1 - (n11 + n01) / n) AS den FROM n WHERE n >= 4), b AS (SELECT species, CAST(FLOOR(dist / 3.0::DOUBLE) AS BIGINT) AS bin, SUM(num) / SUM(den) AS ratio FROM q WHERE den > 1e-9::DOUBLE GROUP BY 1, 2) SELECT species, bin, ROUND(ratio, 6) AS ratio, ROUND(CASE WHEN ratio >= 1 THEN 0 ELSE (44 - 260 * ratio + SQRT((260 * ratio - 44) ** 2 - 160 * ratio * (220 * ratio - 220))) / (80 * ratio) END, 5) AS effective FROM b")
def effective_recombination(spark, d):
    bins = linkage.binned(linkage.sigma_squared(linkage.site_pair_counts(A.annotated(spark, d))))
    return bins.select("species", "bin", F.round("ratio", 6).alias("ratio"), (F.round(N.effective_recombination(F.col("ratio")), 5) + F.lit(0.0)).alias("effective"))


@_query(f"WITH {_LD}, q AS (SELECT *, (n11 + n10) / n AS p, (n11 + n01) / n AS q, n11 / n AS pq FROM n WHERE n >= 4), m AS (SELECT * FROM q WHERE LEAST(p, 1 - p) >= 0.2::DOUBLE AND LEAST(q, 1 - q) >= 0.2::DOUBLE) SELECT species, COUNT(*) AS n, ROUND(SUM((pq - p * q) ** 2), 6) AS num, ROUND(SUM(p * (1 - p) * q * (1 - q)), 6) AS den FROM m GROUP BY 1")
def linkage_of_common_alleles(spark, d):
    rows = N.ld_given_freq(linkage.site_pair_counts(A.annotated(spark, d)), 0.2, 0.5)
    return rounded(rows.groupBy("species").agg(F.count(F.lit(1)).alias("n"), F.sum("num").alias("num"), F.sum("den").alias("den")))


@_query("WITH r AS (SELECT *, alt::DOUBLE / depth AS f FROM a_site_counts WHERE depth > 5), k AS (SELECT species, contig, pos FROM r GROUP BY 1, 2, 3 HAVING COUNT(*) / 12.0::DOUBLE >= 0.3::DOUBLE AND MAX(f) >= 0.05::DOUBLE AND MIN(f) <= 0.95::DOUBLE) SELECT species, contig, pos, sample, alt, depth FROM r JOIN k USING (species, contig, pos)")
def phased_tensor(spark, d):
    return N.phased_tensor(A.site_counts(spark, d), cohort=12)


@_query("WITH m AS (SELECT species, sample, pos % 3 AS cluster FROM a_site_counts), n AS (SELECT species, sample, cluster, COUNT(*) AS c FROM m GROUP BY 1, 2, 3), k AS (SELECT species, COUNT(DISTINCT cluster) AS k FROM m GROUP BY 1) SELECT species, sample FROM n JOIN k USING (species) WHERE c >= 30 GROUP BY species, sample, k HAVING COUNT(*) = k")
def common_samples(spark, d):
    return N.common_samples(A.site_counts(spark, d).select("species", "sample", (F.col("pos") % 3).alias("cluster")), 30)


@_query(
    """WITH r AS (SELECT *, alt::DOUBLE / depth AS f FROM a_site_counts WHERE depth > 0), c AS (SELECT species, CAST(pos % 4 AS INTEGER) AS cluster, sample, ROUND(AVG(f), 4) AS cf, ROUND(AVG(depth), 4) AS cd FROM r GROUP BY 1, 2, 3),
       d AS (SELECT species, contig, pos, cluster, 2 * AVG(CASE WHEN (f + cf) * (2 - f - cf) > 0 THEN (depth + cd) * (f - cf) * (f - cf) / ((f + cf) * (2 - f - cf)) ELSE 0 END) AS a,
         2 * AVG(CASE WHEN (1 - f + cf) * (1 + f - cf) > 0 THEN (depth + cd) * (1 - f - cf) * (1 - f - cf) / ((1 - f + cf) * (1 + f - cf)) ELSE 0 END) AS b FROM r JOIN c USING (species, sample) GROUP BY 1, 2, 3, 4)
       SELECT species, contig, pos, MIN(cluster) AS cluster, FIRST(b < a ORDER BY cluster) AS turned FROM d WHERE LEAST(a, b) < 12 GROUP BY 1, 2, 3"""
)
def assigned_snvs(spark, d):
    rows = diversity.with_freq(A.site_counts(spark, d)).filter("depth > 0")
    c = rows.groupBy("species", (F.col("pos") % 4).cast("int").alias("cluster"), "sample").agg(F.round(F.avg("f"), 4).alias("f"), F.round(F.avg("depth"), 4).alias("depth"))
    return N.assigned(rows.select("species", "contig", "pos", "sample", "f", "depth"), c, 12.0)


_STR = "sf AS (SELECT species, CAST(pos % 3 AS INTEGER) AS strain, sample, subject_id, ROUND(AVG(alt::DOUBLE / depth), 9) AS freq FROM a_site_counts JOIN a_samples USING (sample) WHERE NOT (species = 'sp2' AND sample = 'S00') GROUP BY 1, 2, 3, 4)"


@_query(f"WITH {_STR}, i AS (SELECT species, strain, MAX(CASE WHEN sample = 'S00' THEN freq END) AS i FROM sf GROUP BY 1, 2), m AS (SELECT species, strain, AVG(m) AS m FROM (SELECT species, strain, subject_id, AVG(freq) AS m FROM sf WHERE sample <> 'S00' GROUP BY 1, 2, 3) GROUP BY 1, 2) SELECT species, strain, CAST(ROW_NUMBER() OVER (PARTITION BY species ORDER BY COALESCE(i, m, 0) DESC, strain) AS INTEGER) AS place FROM i LEFT JOIN m USING (species, strain)")
def strain_order(spark, d):
    rows = diversity.with_freq(A.site_counts(spark, d)).filter("not (species = 'sp2' and sample = 'S00')").join(A.samples(spark, d).select("sample", "subject_id"), "sample")
    f = rows.groupBy("species", (F.col("pos") % 3).cast("int").alias("strain"), "sample", "subject_id").agg(F.round(F.avg("f"), 9).alias("freq"))
    return N.strain_order(f, "S00")


@_query("WITH w AS (SELECT species, contig, pos, sample, f, COALESCE(MAX(CASE WHEN sample = 'S00' THEN f END) OVER p, AVG(f) OVER p) > 0.5 AS turned FROM a_sites WINDOW p AS (PARTITION BY species, contig, pos)) SELECT species, contig, pos, sample, ROUND(CASE WHEN turned THEN 1 - f ELSE f END, 6) AS f, turned FROM w")
def repolarised_snvs(spark, d):
    s = diversity.with_freq(A.annotated(spark, d)).select("species", "contig", "pos", "sample", "f")
    return rounded(N.repolarised(s, "S00"))


@_query("WITH s AS (SELECT species, contig, pos, sample, f FROM a_sites), l AS (SELECT DISTINCT species, contig, pos FROM s) SELECT l.*, n.sample, ROUND(f, 6) AS f FROM l CROSS JOIN (SELECT sample FROM a_samples) n LEFT JOIN s USING (species, contig, pos, sample)")
def snvs_with_missing_samples(spark, d):
    s = diversity.with_freq(A.annotated(spark, d)).select("species", "contig", "pos", "sample", "f")
    return rounded(N.with_missing_samples(s, A.samples(spark, d)))


@_query("WITH a AS (SELECT species, sample, COUNT(*) AS n_snvs FROM a_site_counts WHERE depth > 60 GROUP BY 1, 2), b AS (SELECT species, sample, COUNT(*) AS n_genes FROM a_gene_counts WHERE depth > 8 GROUP BY 1, 2) SELECT COALESCE(a.species, b.species) AS species, COALESCE(a.sample, b.sample) AS sample, n_snvs, n_genes FROM a FULL JOIN b ON a.species = b.species AND a.sample = b.sample")
def snvs_and_strains(spark, d):
    n = lambda t, c: t.groupBy("species", "sample").agg(F.count(F.lit(1)).alias(c))
    return N.outer(n(A.site_counts(spark, d).filter("depth > 60"), "n_snvs"), n(A.gene_counts(spark, d).filter("depth > 8"), "n_genes"), ["species", "sample"])


@_query("WITH t AS (SELECT subject_id, date, CAST(DENSE_RANK() OVER (PARTITION BY subject_id ORDER BY date) AS INTEGER) AS timepoint FROM (SELECT DISTINCT subject_id, date FROM a_strain_frequency)) SELECT t.subject_id, t.date, s.species, s.region, timepoint FROM (SELECT species, subject_id, date, region FROM a_strain_frequency WHERE n > 60) s RIGHT JOIN t USING (subject_id, date)")
def rows_by_timepoint(spark, d):
    from pyspark.sql import Window

    s = A.strain_frequency(spark, d)
    t = s.select("subject_id", "date").distinct().withColumn("timepoint", F.dense_rank().over(Window.partitionBy("subject_id").orderBy("date")))
    return N.by_timepoint(t, s.filter("n > 60").select("species", "subject_id", "date", "region"))


@_query(f"WITH {_NCH} SELECT species, gene_id, sample, reads FROM a_gene_counts WHERE (species, sample) IN (SELECT species, sample_1 FROM nc WHERE n > 3)")
def eligible_genes(spark, d):
    return N.eligible(A.gene_counts(spark, d).select("species", "gene_id", "sample", "reads"), _counts(spark, d).filter("n > 3").select("species", F.col("sample_1").alias("sample")), ["species", "sample"])


_THIN = "z AS (SELECT species, contig, pos, sample, CASE WHEN (pos + CAST(SUBSTR(sample, 2) AS INTEGER)) % 3 = 0 THEN 0 ELSE depth END AS depth FROM a_site_counts)"


@_query(f"WITH {_THIN}, q AS (SELECT *, COUNT(*) OVER p AS n, AVG(CASE WHEN depth > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) OVER p AS s FROM z WINDOW p AS (PARTITION BY species, contig, pos)) SELECT species, sample, COUNT(*) AS n, CAST(SUM(depth) AS BIGINT) AS depth FROM q WHERE s >= LEAST(2.0::DOUBLE / n, 0.7::DOUBLE) GROUP BY 1, 2")
def prevalent_sites_with_gaps(spark, d):
    c = A.site_counts(spark, d)
    gap = (F.col("pos") + F.substring("sample", 2, 9).cast("int")) % 3 == 0
    kept = snps.prevalent_only(c.withColumn("depth", F.when(gap, 0).otherwise(F.col("depth"))), 2, 0.7)
    return kept.groupBy("species", "sample").agg(F.count(F.lit(1)).alias("n"), F.sum("depth").alias("depth"))
