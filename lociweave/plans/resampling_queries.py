"""Draws, greedy clusterings and permutation tests as queries over the benchmark tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lociweave.functions import expr
from lociweave.operators import analyses as N
from lociweave.operators import changes, diversity, ecology, genes, inference, linkage, pairs, ranks, references, snps
from lociweave.operators import resampling as R
from lociweave.plans.analysis_queries import _SUBS, _rates
from lociweave.plans.queries import _FLIPS, _HAP, _PI, _copies, _query, rounded
from lociweave.sources import adapters as A

_H32 = "CAST(('0x' || SUBSTR(md5({}), 1, 8)) AS BIGINT)"


@_query(
    """WITH r AS (SELECT region, species || '|' || subject_id || '|' || CAST(date AS VARCHAR) AS id, species = 'sp1' AS label, ROUND(freq, 6) AS v FROM a_strain_frequency), s AS (SELECT region, SUM(CAST(label AS INTEGER)) AS n1, COUNT(*) AS n, SUM(v) AS t, ABS(AVG(CASE WHEN label THEN v END) - AVG(CASE WHEN NOT label THEN v END)) AS gap FROM r GROUP BY 1),
       e AS (SELECT r.region, trial, v, n1, ROW_NUMBER() OVER (PARTITION BY r.region, trial ORDER BY md5('1|' || id || '|' || CAST(trial AS VARCHAR)), id) AS k FROM r JOIN s USING (region), (SELECT UNNEST(range(1, 100)) AS trial)),
       b AS (SELECT region, trial, SUM(v) AS sv FROM e WHERE k <= n1 GROUP BY 1, 2) SELECT region, ROUND(gap, 6) AS gap, (SUM(CASE WHEN ABS(sv / n1 - (t - sv) / (n - n1)) >= gap - 1e-9::DOUBLE THEN 1 ELSE 0 END) + 1) / 100.0::DOUBLE AS pvalue FROM b JOIN s USING (region) GROUP BY region, gap"""
)
def region_permutation_tests(spark, d):
    rows = A.strain_frequency(spark, d).select("region", F.concat_ws("|", "species", "subject_id", F.col("date").cast("string")).alias("id"), (F.col("species") == "sp1").alias("label"), F.round("freq", 6).alias("v"))
    return rounded(R.permutation_test(rows, ["region"], "label", "v", "id", trials=99, seed=1))


@_query(f"WITH g AS (SELECT DISTINCT CAST(SPLIT_PART(gene_id, '.', 4) AS BIGINT) AS gene_number FROM a_site_info), p AS (SELECT gene_number AS control, ROW_NUMBER() OVER (ORDER BY gene_number) - 1 AS k FROM g), a AS (SELECT gene_number, CAST(draw AS INTEGER) AS draw, {_H32.format("'4|' || CAST(gene_number AS VARCHAR) || '|' || CAST(draw AS VARCHAR)")} % (SELECT COUNT(*) FROM g) AS k FROM g, (SELECT UNNEST(range(1, 11)) AS draw)) SELECT gene_number, draw, control FROM a JOIN p USING (k) WHERE ABS(gene_number - control) > 5")
def control_genes(spark, d):
    g = A.site_info(spark, d).select(expr.gene_number(F.col("gene_id")).alias("gene_number")).distinct()
    return R.control_genes(g, seed=4)


@_query("WITH r AS (SELECT c_mktsegment AS clade, c_acctbal > 5000 AS f FROM customer), k AS (SELECT clade, SUM(CAST(f AS INTEGER))::DOUBLE AS k, COUNT(*)::DOUBLE AS n FROM r GROUP BY 1), t AS (SELECT SUM(k) AS tk, SUM(n) AS tn FROM k) SELECT clade, CAST(k AS BIGINT) AS k, CAST(n AS BIGINT) AS n, ROUND(2 * (k * LN(k / n) + (n - k) * LN(1 - k / n) + (tk - k) * LN((tk - k) / (tn - n)) + (tn - n - tk + k) * LN(1 - (tk - k) / (tn - n)) - tk * LN(tk / tn) - (tn - tk) * LN(1 - tk / tn)), 5) AS lrt FROM k, t")
def clade_enrichment(spark, d):
    rows = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_mktsegment").alias("clade"), (F.col("c_acctbal") > 5000).alias("f"))
    return rounded(R.clade_enrichment(rows, "clade", "f"), 5)


@_query(
    f"""WITH {_FLIPS}, pp AS (SELECT species, contig, pos, AVG(CASE WHEN 2 * alt >= depth THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS p FROM a_site_counts WHERE depth > 0 GROUP BY 1, 2, 3),
        q AS (SELECT fl.*, CASE WHEN pos % 5 = 0 THEN 0 ELSE COALESCE(p, 0) END AS p FROM fl LEFT JOIN (SELECT * FROM pp WHERE p <> 0) USING (species, contig, pos)) SELECT species, contig, pos, sample_1, sample_2, ROUND(CASE WHEN kind = 'reversion' THEN 1 - p ELSE p END, 6) AS prevalence FROM q"""
)
def sweep_prevalences(spark, d):
    c = A.site_counts(spark, d)
    f = changes.flips(c, with_freqs=True)
    rows = f.drop("kind")
    private = f.filter("pos % 5 = 0").select("species", "contig", "pos")
    return rounded(R.sweep_prevalence(rows, references.population_freqs(snps.prevalence(c)), private).drop("f1", "f2"))


@_query(
    f"""WITH {_SUBS}, r AS (SELECT species, sample_1, sample_2, CAST(mo + ro AS BIGINT) AS n FROM su WHERE type = '4D'), w AS (SELECT r.*, UNNEST(range(0, CAST(GREATEST(CEIL(n / 32.0), 1) AS BIGINT))) AS k FROM r)
        SELECT species, sample_1, sample_2, n, CAST(SUM(CASE WHEN n > 0 THEN BIT_COUNT({_H32.format("'2|' || species || '|' || sample_1 || '|' || sample_2 || '|' || CAST(k AS VARCHAR)")} & ((1::BIGINT << LEAST(32, n - 32 * k)) - 1)) ELSE 0 END) AS BIGINT) AS half_1,
          n - CAST(SUM(CASE WHEN n > 0 THEN BIT_COUNT({_H32.format("'2|' || species || '|' || sample_1 || '|' || sample_2 || '|' || CAST(k AS VARCHAR)")} & ((1::BIGINT << LEAST(32, n - 32 * k)) - 1)) ELSE 0 END) AS BIGINT) AS half_2 FROM w GROUP BY 1, 2, 3, 4"""
)
def split_half_counts(spark, d):
    rows = _rates(spark, d).filter("type = '4D'").select(*N.PAIR, (F.col("mut_opportunities") + F.col("rev_opportunities")).cast("bigint").alias("n"))
    return R.halves(rows, "n", seed=2)


@_query()
def linkage_window_intervals(spark, d):
    return rounded(R.window_intervals(linkage.binned(linkage.sigma_squared(linkage.site_pair_counts(A.annotated(spark, d)))), 0, 4))


@_query()
def timepoint_anova(spark, d):
    rows = A.strain_frequency(spark, d).select("species", "subject_id", F.col("date").cast("string").alias("date"), "region", "freq")
    return rounded(inference.sequential_anova(rows, ["species", "subject_id"], "freq", ["date", "region"]))


@_query()
def clades_within_clades(spark, d):
    m = diversity.pi_matrix(A.annotated(spark, d))
    outer = A.site_counts(spark, d).select("species", "sample").distinct().withColumn("clade", F.substring("sample", 2, 9).cast("int") % 3)
    return R.clades_within(m, outer, "pi_between", 0.42)


@_query()
def clumped_haplotypes(spark, d):
    return R.clumped(linkage.haplotype_counts(linkage.haplotypes(A.annotated(spark, d))))


@_query()
def clumped_homozygosity(spark, d):
    return rounded(linkage.homozygosity(R.clumped(linkage.haplotype_counts(linkage.haplotypes(A.annotated(spark, d))))))


@_query()
def description_clusters(spark, d):
    return R.clustered_descriptions(A.pangenome(spark, d), "species")


@_query()
def community_scaling(spark, d):
    return rounded(R.metric_scaling(ecology.bray_curtis(A.species_profile(spark, d)), "bray_curtis"), 4)


@_query()
def balanced_centroids(spark, d):
    rows = diversity.with_freq(A.site_counts(spark, d)).filter("depth > 0")
    return rounded(R.balanced_centroids(rows.groupBy("species", (F.col("pos") % 3).cast("bigint").alias("cluster"), "sample").agg(F.avg("f").alias("f"))))


@_query("SELECT species, sample, ROUND(CASE WHEN sample = 'N1' THEN coverage / SUM(CASE WHEN sample = 'N1' THEN coverage END) OVER () ELSE coverage END, 6) AS coverage FROM a_species_profile")
def normalised_inoculum(spark, d):
    return rounded(ecology.normalised_sample(A.species_profile(spark, d), "N1", "coverage").select("species", "sample", "coverage"))


@_query("WITH q AS (SELECT species, contig, pos, ROW_NUMBER() OVER (PARTITION BY species ORDER BY contig, pos) AS r FROM (SELECT DISTINCT species, contig, pos FROM a_site_counts)) SELECT species, contig, pos FROM q WHERE r <= 25")
def first_sites(spark, d):
    return N.first_rows(A.site_counts(spark, d).select("species", "contig", "pos").distinct(), ["species"], ["contig", "pos"], 25)


@_query(
    """WITH r AS (SELECT species, sample, AVG(2 * rf * (1 - rf)) AS pi FROM a_sites WHERE depth >= 4 GROUP BY 1, 2), w AS (SELECT *, CASE WHEN pi < 0.35::DOUBLE THEN 'single' ELSE 'mixed' END AS class FROM r),
       x AS (SELECT class, RANK() OVER (PARTITION BY class ORDER BY ROUND(pi, 9)) + (COUNT(*) OVER (PARTITION BY class, ROUND(pi, 9)) - 1) / 2.0::DOUBLE AS a, RANK() OVER (PARTITION BY class ORDER BY sample) + (COUNT(*) OVER (PARTITION BY class, sample) - 1) / 2.0::DOUBLE AS b FROM w) SELECT class, ROUND(CORR(a, b), 6) AS rho, COUNT(*) AS n FROM x GROUP BY 1"""
)
def pi_rank_correlation_by_class(spark, d):
    p = diversity.pi_summary(diversity.site_pi(A.annotated(spark, d), method="regular")).select("species", "sample", F.col("mean_pi").alias("pi"))
    rows = p.withColumn("class", F.when(F.col("pi") < 0.35, "single").otherwise("mixed")).withColumn("pi", F.round("pi", 9))
    return rounded(ranks.rank_correlation(rows, "pi", "sample", ["class"]))


@_query("WITH t AS (SELECT species, a.sample AS sample_1, b.sample AS sample_2, COUNT(*) AS o, SUM(CASE WHEN b.f <= 0.2::DOUBLE THEN 1 ELSE 0 END) AS r FROM a_sites a JOIN a_sites b USING (species, contig, pos) WHERE a.sample <> b.sample AND a.f >= 0.8::DOUBLE AND (b.f >= 0.8::DOUBLE OR b.f <= 0.2::DOUBLE) AND a.depth >= 5 AND b.depth >= 5 AND pos % 2 = 0 GROUP BY 1, 2, 3) SELECT species, sample_1, sample_2, ROUND(1 - r::DOUBLE / o, 6) AS shared FROM t")
def shared_private_snvs(spark, d):
    c = A.annotated(spark, d)
    return rounded(N.shared_fraction(changes.tracked_private(c, c.filter("pos % 2 = 0").select("species", "contig", "pos").distinct())))


@_query(
    """WITH m AS (SELECT species, contig, pos, FLOOR(QUANTILE_CONT(depth, 0.5)) AS cap FROM a_site_counts WHERE sample < 'S06' GROUP BY 1, 2, 3)
       SELECT species, sample, CAST(SUM(CASE WHEN sample IN ('S06', 'S07') THEN CASE WHEN COALESCE(cap, 0) < 4 THEN 0 ELSE LEAST(cap, depth) END ELSE depth END) AS BIGINT) AS depth FROM a_site_counts LEFT JOIN m USING (species, contig, pos) GROUP BY 1, 2"""
)
def capped_depths(spark, d):
    from lociweave.operators import coverage

    got = coverage.median_capped(A.site_counts(spark, d), [f"S{k:02d}" for k in range(6)], ["S06", "S07"])
    return got.groupBy("species", "sample").agg(F.sum("depth").alias("depth"))


@_query(f"WITH {_HAP}, m AS (SELECT species, gene_id, sample FROM hp) SELECT a.species, a.gene_id, a.sample AS sample_1, b.sample AS sample_2 FROM m a JOIN m b USING (species, gene_id) WHERE a.sample < b.sample")
def haplotype_sample_pairs(spark, d):
    h = linkage.haplotypes(A.annotated(spark, d)).select("species", "gene_id", "sample")
    a, b = (h.withColumnRenamed("sample", f"sample_{k}") for k in (1, 2))
    return a.join(b, ["species", "gene_id"]).filter("sample_1 < sample_2")
