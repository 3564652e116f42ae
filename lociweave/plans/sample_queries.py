"""Sample metadata, visits and cohorts as queries over the benchmark tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lociweave.operators import coverage, samples, snps
from lociweave.operators import pairs as P
from lociweave.plans.queries import _CDF, _RATES, _query, rounded
from lociweave.sources import adapters as A


@_query("SELECT subject_id, sample, STRING_AGG(DISTINCT accession, ',' ORDER BY accession) AS accessions FROM a_metadata GROUP BY 1, 2")
def subject_sample_map(spark, d):
    return samples.accessions(A.metadata(spark, d))


@_query("SELECT DISTINCT sample, subject_id FROM a_metadata")
def sample_subject_map(spark, d):
    return samples.subject_of(A.metadata(spark, d))


@_query("SELECT subject_id, STRING_AGG(DISTINCT sample, ',' ORDER BY sample) AS samples, STRING_AGG(DISTINCT accession, ',' ORDER BY accession) AS accessions FROM a_metadata GROUP BY 1")
def flattened_subjects(spark, d):
    return samples.samples_of_subjects(A.metadata(spark, d))


@_query("SELECT DISTINCT subject_id, visit, sample, CAST(0 AS INTEGER) AS day FROM a_metadata")
def subject_visits(spark, d):
    return samples.visits(A.metadata(spark, d))


_VISITS = "v AS (SELECT DISTINCT subject_id, visit, sample, 0 AS day FROM a_metadata)"
_ONE = f"{_VISITS}, o AS (SELECT subject_id, visit, CASE WHEN COUNT(*) > 1 THEN MIN(sample) || 'c' ELSE MIN(sample) END AS sample, CAST(0 AS INTEGER) AS day, COUNT(*) AS n FROM v GROUP BY 1, 2)"


@_query(f"WITH {_ONE} SELECT * FROM o")
def collapsed_visits(spark, d):
    return samples.collapsed_visits(samples.visits(A.metadata(spark, d)))


@_query(f"WITH {_VISITS}, c AS (SELECT sample, MAX(coverage) AS coverage FROM a_metadata GROUP BY 1) SELECT subject_id, visit, FIRST(sample ORDER BY coverage DESC, sample) AS sample, ROUND(MAX(coverage), 6) AS coverage FROM v JOIN c USING (sample) WHERE coverage > 0 GROUP BY 1, 2")
def pruned_visits(spark, d):
    m = A.metadata(spark, d)
    return rounded(samples.best_covered(samples.visits(m), m.groupBy("sample").agg(F.max("coverage").alias("coverage"))))


def _pairs_sql(on: str) -> str:
    return f"WITH {_ONE} SELECT subject_id, a.sample AS sample_1, b.sample AS sample_2, a.visit AS visit_1, b.visit AS visit_2, b.day - a.day AS days FROM o a JOIN o b USING (subject_id) WHERE {on}"


@_query(_pairs_sql("a.visit = 1 AND b.visit <> 1"))
def visit_pairs_from_first(spark, d):
    return samples.first_visit_pairs(samples.collapsed_visits(samples.visits(A.metadata(spark, d))))


@_query(_pairs_sql("a.visit < b.visit"))
def visit_pairs_all(spark, d):
    return samples.all_visit_pairs(samples.collapsed_visits(samples.visits(A.metadata(spark, d))))


@_query(_pairs_sql("a.visit = 1 AND b.visit IN (2, 3)"))
def visit_pairs_early(spark, d):
    return samples.early_visit_pairs(samples.collapsed_visits(samples.visits(A.metadata(spark, d))))


@_query("SELECT * FROM a_metadata WHERE continent = 'ASIA'")
def samples_of_continent(spark, d):
    return samples.by_field(A.metadata(spark, d), "continent", "ASIA")


@_query("SELECT sample, MIN(country) AS country FROM a_metadata GROUP BY 1")
def sample_countries(spark, d):
    return samples.attribute(A.metadata(spark, d), "country")


@_query("SELECT sample, MIN(continent) AS continent FROM a_metadata GROUP BY 1")
def sample_continents(spark, d):
    return samples.attribute(A.metadata(spark, d), "continent")


@_query("WITH c AS (SELECT sample, MIN(country) AS country FROM a_metadata GROUP BY 1) SELECT sample || 'c' AS sample, country IN ('NATION_3', 'NATION_7') AS allowed FROM c")
def samples_in_countries(spark, d):
    m = A.metadata(spark, d)
    merged = m.select(F.concat("sample", F.lit("c")).alias("sample")).distinct()
    return samples.in_countries(merged, samples.attribute(m, "country"), ["NATION_3", "NATION_7"])


@_query("SELECT DISTINCT sample, subject_id FROM a_samples WHERE subject_id <> (SELECT MIN(subject_id) FROM a_samples WHERE sample = 'S03')")
def samples_of_other_subjects(spark, d):
    return samples.other_subjects(A.samples(spark, d), "S03")


@_query("SELECT a.sample, b.subject_id AS subject, a.subject_id = b.subject_id AS own FROM a_samples a, (SELECT DISTINCT subject_id FROM a_samples) b")
def sample_subject_matrix(spark, d):
    return samples.incidence(A.samples(spark, d))


_PLACES = "f AS (SELECT sample, ROW_NUMBER() OVER (ORDER BY sample) - 1 AS place FROM a_samples), t AS (SELECT sample, ROW_NUMBER() OVER (ORDER BY sample DESC) - 1 AS place FROM a_samples WHERE ord > 1)"


def _lists(spark, d):
    from pyspark.sql import Window

    s = A.samples(spark, d)
    place = lambda t, *o: t.select("sample", (F.row_number().over(Window.orderBy(*o)) - 1).cast("bigint").alias("place"))
    return place(s, "sample"), place(s.filter("ord > 1"), F.desc("sample"))


@_query(f"WITH {_PLACES} SELECT sample, f.place AS from_index, t.place AS to_index FROM f JOIN t USING (sample)")
def sample_index_map(spark, d):
    return samples.index_map(*_lists(spark, d))


@_query(f"WITH {_PLACES} SELECT f.place AS from_index, t.place AS to_index FROM f JOIN t USING (sample) WHERE f.place % 2 = 1")
def remapped_indices(spark, d):
    a, b = _lists(spark, d)
    return samples.remapped(a.filter("place % 2 = 1").select(F.col("place").alias("from_index")), samples.index_map(a, b))


@_query(f"WITH {_PLACES} SELECT SUBSTR(sample, 1, 2) AS prefix, FIRST(sample ORDER BY place) AS sample FROM f GROUP BY 1")
def samples_by_prefix(spark, d):
    a, _ = _lists(spark, d)
    return samples.by_prefix(a, a.select(F.substring("sample", 1, 2).alias("prefix")).distinct())


@_query(f"WITH {_PLACES} SELECT cage AS grouping, STRING_AGG(CAST(place AS VARCHAR), ',' ORDER BY place) AS places FROM f JOIN a_samples USING (sample) GROUP BY 1")
def grouping_places(spark, d):
    a, _ = _lists(spark, d)
    return samples.grouping_places(A.samples(spark, d).withColumnRenamed("cage", "grouping"), a)


@_query("SELECT s.*, accession FROM a_samples s LEFT JOIN (SELECT DISTINCT 'S' || LPAD(CAST(visit * 3 AS VARCHAR), 2, '0') AS sample, 'R' || CAST(visit AS VARCHAR) AS accession FROM a_metadata) USING (sample)")
def samples_with_runs(spark, d):
    runs = A.metadata(spark, d).select(F.concat(F.lit("S"), F.lpad((F.col("visit") * 3).cast("string"), 2, "0")).alias("sample"), F.concat(F.lit("R"), F.col("visit").cast("string")).alias("accession")).distinct()
    return samples.with_runs(A.samples(spark, d), runs)


@_query("SELECT sample, CASE WHEN continent = 'ASIA' THEN 'isolate' ELSE 'mixture' END AS kind, sample AS subject_id FROM (SELECT sample, MIN(continent) AS continent FROM a_metadata GROUP BY 1)")
def isolates_and_mixtures(spark, d):
    c = samples.attribute(A.metadata(spark, d), "continent")
    return samples.of_kinds(c.filter("continent = 'ASIA'"), c.filter("continent <> 'ASIA'"))


@_query("WITH t AS (SELECT sample, 1 AS priority, country FROM a_metadata UNION ALL SELECT sample, 2, continent FROM a_metadata WHERE visit = 2) SELECT sample, CAST(MAX(priority) AS INTEGER) AS priority, MIN(CASE WHEN priority = p THEN country END) AS country FROM (SELECT *, MAX(priority) OVER (PARTITION BY sample) AS p FROM t) GROUP BY sample")
def merged_cohorts(spark, d):
    m = A.metadata(spark, d)
    a = samples.attribute(m, "country").withColumn("priority", F.lit(1))
    b = samples.attribute(m.filter("visit = 2"), "continent").select("sample", F.col("continent").alias("country"), F.lit(2).alias("priority"))
    return samples.merged_cohorts(a.unionByName(b))


_COVERED = f"{_CDF}, q AS (SELECT species, sample, MIN(depth) AS median FROM c WHERE cdf >= 0.5::DOUBLE GROUP BY 1, 2 HAVING median >= 25)"


def _covered(spark, d):
    return snps.high_coverage(coverage.nonzero_median(coverage.depth_histogram(A.site_counts(spark, d)), ["species", "sample"]), 25)


@_query(f"WITH {_COVERED}, pr AS (SELECT sample AS sample_1, LEAD(sample) OVER (PARTITION BY subject_id ORDER BY ord, sample) AS sample_2 FROM a_samples), g AS (SELECT x.species, sample_1, sample_2 FROM pr JOIN q x ON x.sample = sample_1 JOIN q y ON y.sample = sample_2 AND x.species = y.species) SELECT species, sample_1 AS sample FROM g UNION SELECT species, sample_2 FROM g")
def temporal_samples(spark, d):
    return samples.temporal_samples(_covered(spark, d), P.consecutive(A.samples(spark, d)))


@_query(f"WITH {_COVERED}, g AS (SELECT x.species, x.sample AS s1, y.sample AS s2, z.sample AS s3 FROM q x JOIN q y USING (species) JOIN q z USING (species) JOIN a_samples a ON a.sample = x.sample JOIN a_samples b ON b.sample = y.sample JOIN a_samples e ON e.sample = z.sample WHERE a.subject_id = b.subject_id AND b.subject_id = e.subject_id AND a.ord = 1 AND b.ord = 2 AND e.ord = 3) SELECT species, s1 AS sample FROM g UNION SELECT species, s2 FROM g UNION SELECT species, s3 FROM g")
def triple_temporal_samples(spark, d):
    return samples.temporal_samples(_covered(spark, d), P.triplets(A.samples(spark, d)))


@_query("SELECT DISTINCT 'H' || CAST(CAST(SUBSTR(sample, 2) AS INTEGER) % 4 AS VARCHAR) AS subject_id, species FROM a_species_profile WHERE coverage >= 2")
def host_species_union(spark, d):
    profile = A.species_profile(spark, d)
    hosts = profile.select("sample", F.concat(F.lit("H"), (F.substring("sample", 2, 9).cast("int") % 4).cast("string")).alias("subject_id")).distinct()
    return samples.species_union(profile, hosts, 2.0)


@_query("SELECT sample, species, ROUND(coverage, 6) AS coverage FROM a_species_profile WHERE coverage >= 3")
def covered_species(spark, d):
    return rounded(samples.covered_species(A.species_profile(spark, d)))


@_query("SELECT n_name AS species, r_name AS phylum, SUBSTR(r_name, 1, 2) AS class FROM nation JOIN region ON n_regionkey = r_regionkey")
def species_taxonomy(spark, d):
    n, r = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("nation", "region"))
    genomes = n.select(F.col("n_name").alias("species"), F.col("n_regionkey").alias("genome"))
    return samples.taxonomy(genomes.select("species"), genomes, r.select(F.col("r_regionkey").alias("genome"), F.col("r_name").alias("phylum"), F.substring("r_name", 1, 2).alias("class")))


@_query("SELECT c_custkey AS code, CASE WHEN COUNT(*) OVER (PARTITION BY c_mktsegment, CAST(FLOOR(c_acctbal) AS BIGINT)) > 1 THEN c_mktsegment || CAST(CAST(FLOOR(c_acctbal) AS BIGINT) AS VARCHAR) || '_' || CAST(c_custkey AS VARCHAR) ELSE c_mktsegment || CAST(CAST(FLOOR(c_acctbal) AS BIGINT) AS VARCHAR) END AS name FROM customer")
def species_codes(spark, d):
    c = spark.read.parquet(f"{d}/customer.parquet")
    return samples.unique_codes(c.select(F.col("c_custkey").alias("code"), F.concat("c_mktsegment", F.floor("c_acctbal").cast("string")).alias("name")))


@_query(
    """WITH s AS (SELECT n_name AS species, r_name AS phylum, n_nationkey % 2 AS class, (n_nationkey * 7) % 25 AS seen FROM nation JOIN region ON n_regionkey = r_regionkey),
       f AS (SELECT *, MIN(seen) OVER (PARTITION BY phylum) AS f0, MIN(seen) OVER (PARTITION BY phylum, class) AS f1 FROM s)
       SELECT species, CAST(ROW_NUMBER() OVER (ORDER BY CASE WHEN species = 'NATION_4' THEN 0 ELSE 1 END, f0, f1, species) AS INTEGER) AS place FROM f"""
)
def species_in_phylogenetic_order(spark, d):
    n, r = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("nation", "region"))
    s = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("species"), F.col("r_name").alias("phylum"), (F.col("n_nationkey") % 2).alias("class"), ((F.col("n_nationkey") * 7) % 25).alias("seen"))
    return samples.phylogenetic_order(s, ["phylum", "class"], "NATION_4")


@_query("SELECT sample, subject_id, cage, NULL::VARCHAR AS species, 0 AS part FROM a_samples UNION ALL SELECT sample, NULL, NULL, species, 1 FROM a_species_profile")
def stacked_tables(spark, d):
    return samples.union_tables([A.samples(spark, d).drop("ord"), A.species_profile(spark, d).select("sample", "species")])


@_query()
def disjoint_mouse_pairs(spark, d):
    a = P.same_cage(A.samples(spark, d)).select("cage", F.col("sample_1").alias("mouse_1"), F.col("sample_2").alias("mouse_2"))
    return samples.disjoint_pairs(a, "cage")


@_query("SELECT a.species, a.cage AS cage_1, b.cage AS cage_2 FROM (SELECT DISTINCT species, cage FROM a_site_counts JOIN a_samples USING (sample)) a JOIN (SELECT DISTINCT species, cage FROM a_site_counts JOIN a_samples USING (sample)) b ON a.species = b.species AND a.cage < b.cage")
def cage_pairs(spark, d):
    rows = A.site_counts(spark, d).join(F.broadcast(A.samples(spark, d).select("sample", "cage")), "sample")
    return P.cages(rows)


@_query("SELECT CAST(l_suppkey AS VARCHAR) AS sample, ROUND(SUM(l_quantity) / 2, 6) AS mapped_pairs, COUNT(DISTINCT l_returnflag) AS n_species, ROUND(SUM(l_quantity) / 2 / MAX(l_extendedprice), 6) AS rate FROM lineitem GROUP BY 1")
def mapping_rates(spark, d):
    rows = spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_suppkey").cast("string").alias("sample"), F.col("l_quantity").alias("mapped_reads"), F.col("l_returnflag").alias("species"), F.col("l_extendedprice").alias("total_pairs"))
    return rounded(samples.mapping_rates(rows))


@_query("SELECT sample FROM a_mouse_samples WHERE SUBSTR(sample, 1, 2) IN ('M1', 'M4', 'M7')")
def samples_of_mice(spark, d):
    return samples.of_mice(A.mouse_samples(spark, d).select("sample"), [1, 4, 7])


@_query("SELECT sample, species FROM a_species_profile WHERE coverage >= 3")
def species_above_coverage(spark, d):
    return samples.species_above(A.species_profile(spark, d), 3.0)


@_query(f"WITH {_RATES} WHERE variant_type = '4D' GROUP BY 1, 2), h AS (SELECT species, within <= 0.1::DOUBLE * between AS haploid FROM q), c AS (SELECT species, CASE WHEN haploid THEN 'QP' ELSE 'Not QP' END AS ploidy, COUNT(*) AS n FROM h GROUP BY 1, 2) SELECT * FROM c WHERE species IN (SELECT species FROM c GROUP BY 1 HAVING SUM(n) >= 2)")
def ploidy_counts(spark, d):
    return samples.ploidy_counts(snps.ploidy(snps.spectrum(A.annotated(spark, d))))


@_query("WITH c AS (SELECT DISTINCT subject_id AS clade, sample FROM a_samples), n AS (SELECT DISTINCT sample FROM a_samples) SELECT k.clade, n.sample, c.sample IS NOT NULL AS inside FROM (SELECT DISTINCT clade FROM c) k CROSS JOIN n LEFT JOIN c ON c.clade = k.clade AND c.sample = n.sample")
def clade_members(spark, d):
    s = A.samples(spark, d)
    return samples.clade_members(s, s.select(F.col("subject_id").alias("clade"), "sample"))


@_query("SELECT DISTINCT genome, species FROM a_pangenome WHERE CONTAINS(description, 'an')")
def panel_genomes(spark, d):
    from lociweave.operators import references

    return references.panel_genomes(A.pangenome(spark, d).select("genome", "species", "description"), "description", "an")


@_query(
    """WITH pc AS (SELECT a.sample AS sample_1, b.sample AS sample_2 FROM a_samples a JOIN a_samples b ON a.subject_id = b.subject_id AND b.ord = a.ord + 1),
    g AS (SELECT *, alt::DOUBLE / NULLIF(depth, 0) AS f FROM a_site_grid), ho AS (SELECT species, contig, pos, subject_id, MAX(CASE WHEN f <= 0.2::DOUBLE THEN 0 WHEN f >= 0.8::DOUBLE THEN 1 END) AS g FROM g JOIN a_samples s ON s.sample = g.sample WHERE depth > 0 AND (f <= 0.2::DOUBLE OR f >= 0.8::DOUBLE) GROUP BY 1, 2, 3, 4),
    pv AS (SELECT species, contig, pos FROM ho GROUP BY 1, 2, 3 HAVING COUNT(*) >= 4 AND SUM(g) = 1), e AS (SELECT g.* FROM g JOIN pv ON pv.species = g.species AND pv.contig = g.contig AND pv.pos = g.pos),
    c AS (SELECT a.species, sample_1, sample_2, a.f AS f1, b.f AS f2, b.depth AS d2 FROM pc JOIN e a ON a.sample = sample_1 JOIN e b ON b.sample = sample_2 AND b.species = a.species AND b.contig = a.contig AND b.pos = a.pos WHERE a.f >= 0.8::DOUBLE)
    SELECT species, sample_1, sample_2, CAST(SUM(CASE WHEN d2 > 0 AND f2 <= 0.2::DOUBLE THEN 1 ELSE 0 END) AS BIGINT) AS reversions, CAST(COUNT(*) - SUM(CASE WHEN d2 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS opportunities FROM c GROUP BY 1, 2, 3"""
)
def private_reversions(spark, d):
    from lociweave.operators import analyses, changes

    grid, s = A.site_grid(spark, d), A.samples(spark, d)
    found = changes.private_changes(grid, snps.private_snvs(grid, s), P.consecutive(s)).filter("f1 >= 0.8")
    totals = found.groupBy(*analyses.PAIR).agg(F.count(F.lit(1)).alias("opportunities"))
    return analyses.private_reversions(found, totals)


@_query()
def region_signed_rank(spark, d):
    from lociweave.operators import inference

    s = A.strain_frequency(spark, d).groupBy("species", "date", "region").agg(F.avg("freq").alias("freq"))
    a, b = (s.filter(F.col("region") == r).select("species", "date", F.col("freq").alias(f"f{k}")) for k, r in ((1, "click"), (2, "view")))
    return rounded(inference.signed_rank_tests(a.join(b, ["species", "date"]), ["species"], "f1", "f2"))
