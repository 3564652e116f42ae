"""The annotated-SNP chain over sites with uncovered samples."""

from __future__ import annotations

from lociweave.operators import chain, snps
from lociweave.plans.queries import _query, rounded
from lociweave.sources import adapters as A

#: A sample's window comes from its nonzero depths, unless more than four fifths are zero.
_CHAIN = """h AS (SELECT species, sample, depth, COUNT(*) AS n FROM a_site_grid GROUP BY 1, 2, 3),
t AS (SELECT species, sample, SUM(n) AS every, SUM(CASE WHEN depth = 0 THEN n ELSE 0 END) AS zero, COUNT(*) AS bins, MAX(depth) AS only_one FROM h GROUP BY 1, 2),
c AS (SELECT species, sample, depth, CAST(SUM(n) OVER (PARTITION BY species, sample ORDER BY depth) AS DOUBLE) / SUM(n) OVER (PARTITION BY species, sample) AS cdf FROM h WHERE depth > 0),
md AS (SELECT t.species, t.sample, CASE WHEN bins = 1 THEN only_one WHEN zero > 0.8::DOUBLE * every THEN 0 ELSE COALESCE(q.m, 0) END AS m
  FROM t LEFT JOIN (SELECT species, sample, MIN(depth) AS m FROM c WHERE cdf >= 0.5::DOUBLE GROUP BY 1, 2) q ON q.species = t.species AND q.sample = t.sample),
ls AS (SELECT species, LEAST(4.0::DOUBLE / COUNT(*), 0.5::DOUBLE) AS least_share FROM md GROUP BY 1),
us AS (SELECT species, sample, FLOOR(0.3::DOUBLE * m) - 0.5::DOUBLE AS lower, CEIL(3.0::DOUBLE * m) + 0.5::DOUBLE AS upper FROM md WHERE m >= 5),
po AS (SELECT species, contig, pos, AVG(CASE WHEN 2 * alt >= depth THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS alt_freq FROM a_site_grid WHERE depth > 0 GROUP BY 1, 2, 3),
pt AS (SELECT k, depth, CASE WHEN k = 0 THEN 1 ELSE GREATEST(1 - LIST_SUM(list_transform(range(0, k), lambda j: EXP(LGAMMA(depth + 1.0::DOUBLE) - LGAMMA(j + 1.0::DOUBLE) - LGAMMA(depth - j + 1.0::DOUBLE) + j * LN(0.01::DOUBLE) + (depth - j) * LN(0.99::DOUBLE)))), 0) END AS p
  FROM (SELECT DISTINCT LEAST(alt, depth - alt) AS k, depth FROM a_site_grid WHERE depth > 0)),
pv AS (SELECT species, contig, pos, LEAST(MIN(p) * COUNT(*), 1) AS pvalue FROM a_site_grid g JOIN pt ON pt.k = LEAST(g.alt, g.depth - g.alt) AND pt.depth = g.depth WHERE g.depth > 0 GROUP BY 1, 2, 3),
w AS (SELECT g.species, g.contig, g.pos, g.sample, gene_id, variant_type, g.depth BETWEEN lower AND upper AS inside, g.depth, g.alt, least_share,
  AVG(CASE WHEN g.depth BETWEEN lower AND upper THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) OVER (PARTITION BY g.species, g.contig, g.pos) AS share
  FROM a_site_grid g JOIN a_site_info i ON i.contig = g.contig AND i.pos = g.pos JOIN us ON us.species = g.species AND us.sample = g.sample JOIN ls ON ls.species = g.species WHERE variant_type IN ('1D', '2D', '3D', '4D')),
z AS (SELECT w.species, w.contig, w.pos, w.sample, gene_id, variant_type, CASE WHEN COALESCE(alt_freq, 0) > 0.5 THEN 'A' ELSE 'R' END AS polarization, COALESCE(pvalue, 1) AS pvalue,
  CASE WHEN inside THEN depth ELSE 0 END AS depth, CASE WHEN NOT inside THEN 0 WHEN COALESCE(alt_freq, 0) > 0.5 THEN depth - alt ELSE alt END AS alt
  FROM w LEFT JOIN po ON po.species = w.species AND po.contig = w.contig AND po.pos = w.pos LEFT JOIN pv ON pv.species = w.species AND pv.contig = w.contig AND pv.pos = w.pos WHERE share >= least_share),
an AS (SELECT *, pvalue < 0.05::DOUBLE AND MAX(CASE WHEN depth > 0 AND alt > CEIL(0.05::DOUBLE * depth) + 0.5::DOUBLE THEN 1 ELSE 0 END) OVER (PARTITION BY species, contig, pos) = 1 AS called,
  depth > 0 AND (alt = 0 OR alt = depth OR (alt > 1 AND depth - alt > 1)) AS supported FROM z)"""


def chained(spark, d):
    """The chain over the benchmark's sites; a site needs 4 samples."""
    grid = A.site_grid(spark, d)
    return chain.annotated_sites(grid, A.site_info(spark, d), snps.prevalence(grid), chain.site_pvalues(grid), least_samples=4)


@_query(f"WITH {_CHAIN} SELECT species, contig, pos, gene_id, variant_type, polarization, ROUND(pvalue, 6) AS pvalue, sample, depth, alt, called, supported FROM an")
def annotated_site_chain(spark, d):
    return rounded(chained(spark, d))


@_query(f"WITH {_CHAIN} SELECT species, gene_id, variant_type, COUNT(*) AS sites, CAST(SUM(CASE WHEN c THEN 1 ELSE 0 END) AS BIGINT) AS called FROM (SELECT species, contig, pos, gene_id, variant_type, MAX(called) AS c FROM an GROUP BY 1, 2, 3, 4, 5) GROUP BY 1, 2, 3")
def called_sites_by_gene(spark, d):
    return chain.called_by_gene(chained(spark, d))


@_query("WITH h AS (SELECT species, sample, depth, COUNT(*) AS n FROM a_site_grid GROUP BY 1, 2, 3) SELECT * FROM h")
def coverage_hist_with_zeros(spark, d):
    from lociweave.operators import coverage

    return coverage.depth_histogram(A.site_grid(spark, d))
