"""Strains: links between SNVs, clusters, and the chain from counts to ordered strains.

The benchmark's frequencies are noise, so SNVs are linked at a larger distance than in real data.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from lociweave.operators import strains
from lociweave.plans.queries import _query, rounded
from lociweave.sources import adapters as A

NEAR, LEAST = 8.0, 3


def _vectors(spark, d):
    return strains.snv_vectors(strains.strain_sites(A.site_counts(spark, d)))


@_query("WITH m AS (SELECT species, contig, pos, AVG(depth) AS mean FROM a_site_counts WHERE depth >= 5 GROUP BY 1, 2, 3) SELECT species, contig, pos, ROUND(mean, 6) AS mean FROM m QUALIFY ROW_NUMBER() OVER (PARTITION BY species ORDER BY mean DESC, contig, pos) <= 300")
def best_covered_sites(spark, d):
    return rounded(strains.best_covered(A.site_counts(spark, d).filter("depth >= 5"), 300))


@_query(
    f"""WITH r AS (SELECT species, contig, pos, sample, alt::DOUBLE / depth AS f, depth::DOUBLE AS d FROM a_site_counts WHERE depth >= 5), na AS (SELECT DISTINCT species, sample FROM r), si AS (SELECT DISTINCT species, contig, pos FROM r),
    nu AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY species ORDER BY contig, pos) AS k FROM si),
    v AS (SELECT nu.species, nu.contig, k, LIST(COALESCE(r.f, 0) ORDER BY na.sample) AS f, LIST(COALESCE(r.d, 0) ORDER BY na.sample) AS d FROM nu JOIN na ON na.species = nu.species LEFT JOIN r ON r.species = nu.species AND r.contig = nu.contig AND r.pos = nu.pos AND r.sample = na.sample GROUP BY 1, 2, 3),
    p AS (SELECT a.species, a.contig AS contig_1, b.contig AS contig_2, 2 * LIST_AVG(list_transform(range(1, len(a.f) + 1), lambda i: CASE WHEN a.f[i] + b.f[i] > 0 AND a.f[i] + b.f[i] < 2 THEN (a.d[i] + b.d[i]) * (a.f[i] - b.f[i]) ** 2 / ((a.f[i] + b.f[i]) * (2 - a.f[i] - b.f[i])) END)) AS x,
      2 * LIST_AVG(list_transform(range(1, len(a.f) + 1), lambda i: CASE WHEN 1 - a.f[i] + b.f[i] > 0 AND 1 - a.f[i] + b.f[i] < 2 THEN (a.d[i] + b.d[i]) * (1 - a.f[i] - b.f[i]) ** 2 / ((1 - a.f[i] + b.f[i]) * (1 + a.f[i] - b.f[i])) END)) AS y FROM v a JOIN v b ON a.species = b.species AND a.k <= b.k)
    SELECT species, contig_1, contig_2, COUNT(*) AS links, CAST(SUM(CASE WHEN y < x THEN 1 ELSE 0 END) AS BIGINT) AS turned FROM p WHERE LEAST(x, y) < {NEAR}::DOUBLE - 1e-9::DOUBLE GROUP BY 1, 2, 3"""
)
def strain_links(spark, d):
    found = strains.links(_vectors(spark, d), NEAR - 1e-9)
    # by contig, the first one by name first
    one, two = F.least("contig_1", "contig_2"), F.greatest("contig_1", "contig_2")
    return found.groupBy("species", one.alias("contig_1"), two.alias("contig_2")).agg(F.count(F.lit(1)).alias("links"), F.sum(F.col("turned").cast("bigint")).alias("turned"))


@_query()
def strain_clusters(spark, d):
    return strains.snv_clusters(_vectors(spark, d), near=NEAR, least=LEAST)


@_query()
def strain_inference(spark, d):
    return rounded(strains.strains(A.site_counts(spark, d), near=NEAR, least=LEAST))


@_query()
def strain_chain(spark, d):
    return rounded(strains.strain_chain(A.site_counts(spark, d), A.samples(spark, d), "S00", near=NEAR, least=LEAST))


@_query()
def strains_by_subject(spark, d):
    rows = A.site_counts(spark, d).join(A.samples(spark, d).select("sample", "subject_id"), "sample")
    return rounded(strains.strains(rows.withColumn("species", F.concat_ws("/", "species", "subject_id")).drop("subject_id")))
