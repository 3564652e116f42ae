"""Gene references and packed text formats as queries over the benchmark tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lociweave.operators import changes, coverage, diversity, genes, linkage, references, snps
from lociweave.plans.queries import _CDF, _COPY, _FLIPS, _HIST, _LD, _SFS, _copies, _query, rounded
from lociweave.sources import adapters as A
from lociweave.sources import midas, packed

_REF = "rg AS (SELECT species, MIN(genome) AS genome FROM a_pangenome GROUP BY 1), rf AS (SELECT p.* FROM a_pangenome p JOIN rg USING (species, genome))"
_NAMES = f"{_REF}, nm AS (SELECT p.centroid_95 AS centroid, LAST(p.gene_id ORDER BY (rf.gene_id IS NOT NULL), p.line) AS name FROM a_pangenome p LEFT JOIN rf USING (gene_id) GROUP BY 1)"


def _names(spark, d):
    g = A.pangenome(spark, d)
    return g, references.centroid_names(g, references.reference_genes(g))


@_query(f"WITH {_NAMES} SELECT * FROM nm")
def centroid_names(spark, d):
    return _names(spark, d)[1]


@_query(f"WITH {_NAMES} SELECT gene_id, centroid_95 AS centroid, name FROM a_pangenome JOIN nm ON centroid_95 = centroid")
def gene_centroids(spark, d):
    return references.gene_centroids(*_names(spark, d))


@_query("SELECT centroid_95 AS centroid, STRING_AGG(DISTINCT gene_id, ',' ORDER BY gene_id) AS genes, COUNT(*) AS n FROM a_pangenome GROUP BY 1")
def centroid_members(spark, d):
    return references.centroid_members(A.pangenome(spark, d))


@_query(f"WITH {_NAMES} SELECT DISTINCT species, name AS gene_id FROM a_pangenome JOIN nm ON centroid_95 = centroid")
def renamed_pangenome_genes(spark, d):
    g, n = _names(spark, d)
    return references.renamed(g.select("species", "gene_id"), references.gene_centroids(g, n)).distinct()


@_query(f"WITH {_REF} SELECT DISTINCT species, gene_id FROM rf")
def reference_genes(spark, d):
    return references.reference_genes(A.pangenome(spark, d))


@_query(f"WITH {_REF} SELECT DISTINCT species, gene_id FROM rf WHERE line % 3 = 0")
def listed_reference_genes(spark, d):
    g = A.pangenome(spark, d)
    return references.only(references.reference_genes(g), g.filter("line % 3 = 0").select("gene_id")).select("species", "gene_id")


@_query(f"WITH {_REF} SELECT DISTINCT species, gene_id FROM rf WHERE kind IN ('kind 0', 'kind 2')")
def marker_genes(spark, d):
    g = A.pangenome(spark, d)
    return references.marker_genes(g, g.select("species", "gene_id", F.col("kind").alias("marker")), ["kind 0", "kind 2"], references.reference_genes(g))


@_query("SELECT DISTINCT species, genome, genome = MIN(genome) OVER (PARTITION BY species) AS representative FROM a_pangenome")
def species_genomes(spark, d):
    return references.representatives(A.pangenome(spark, d))


@_query("SELECT species, COUNT(DISTINCT genome) AS n_genomes, COUNT(DISTINCT gene_id) AS n_genes FROM a_pangenome GROUP BY 1")
def genomes_per_species(spark, d):
    return references.genome_counts(A.pangenome(spark, d))


@_query("SELECT genome, gene_id, centroid_99, centroid_95 FROM a_pangenome")
def pangenome_map(spark, d):
    return A.pangenome(spark, d).select("genome", "gene_id", "centroid_99", "centroid_95")


@_query("SELECT DISTINCT species FROM a_pangenome UNION ALL SELECT 'new_species'")
def pangenome_species(spark, d):
    return references.with_new_species(A.pangenome(spark, d))


@_query(
    f"""WITH {_COPY}, w AS (SELECT k.*, subject_id FROM k JOIN a_samples USING (sample) WHERE mc >= 5), f AS (SELECT species, subject_id, MIN(sample) AS sample FROM w GROUP BY 1, 2),
        p AS (SELECT species, gene_id, AVG(CASE WHEN cn >= 0.3::DOUBLE THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS prevalence FROM w JOIN f USING (species, sample) GROUP BY 1, 2)
        SELECT species, gene_id, ROUND(prevalence, 6) AS prevalence FROM p WHERE prevalence >= 0.9::DOUBLE AND CAST(SPLIT_PART(gene_id, '.', 4) AS INTEGER) % 2 = 0"""
)
def core_of_hosts(spark, d):
    reference = A.site_info(spark, d).select("gene_id").distinct().filter(F.element_at(F.split("gene_id", r"\."), -1).cast("int") % 2 == 0)
    return rounded(references.core_of_hosts(_copies(spark, d), A.samples(spark, d), reference, marker_least=5.0))


@_query("WITH r AS (SELECT DISTINCT gene_id FROM a_site_info), s AS (SELECT DISTINCT sample FROM a_gene_counts), c AS (SELECT gene_id, sample, SUM(reads) AS reads FROM a_gene_counts GROUP BY 1, 2) SELECT sample, '1.1' AS genome, CAST(COALESCE(SUM(reads), 0) AS BIGINT) AS reads FROM r CROSS JOIN s LEFT JOIN c USING (gene_id, sample) GROUP BY 1")
def reads_per_genome(spark, d):
    return references.reads_per_genome(A.gene_counts(spark, d), A.site_info(spark, d))


@_query("WITH l AS (SELECT DISTINCT centroid_95 AS c FROM a_pangenome WHERE line % 7 = 0) SELECT gene_id FROM a_pangenome WHERE centroid_95 IN (SELECT c FROM l) UNION SELECT c FROM l")
def genes_shared_between_species(spark, d):
    g = A.pangenome(spark, d)
    return references.shared_between_species(g, g.filter("line % 7 = 0").select(F.col("centroid_95").alias("centroid")))


_ANN = "an AS (SELECT centroid_95 AS gene_id, LAST(kind ORDER BY line) AS property, LAST(description ORDER BY line) AS product FROM a_pangenome GROUP BY 1)"


def _annotations(spark, d):
    return A.pangenome(spark, d).select(F.col("centroid_95").alias("gene_id"), F.col("kind").alias("property"), F.col("description").alias("product"), "line")


@_query(f"WITH {_ANN} SELECT * FROM an")
def gene_properties(spark, d):
    return references.with_property(_annotations(spark, d))


@_query(f"WITH {_ANN} SELECT * FROM an WHERE property = 'kind 1'")
def genes_with_property(spark, d):
    return references.with_property(_annotations(spark, d), "kind 1")


@_query("SELECT gene_id, description, 'CDS' AS feature FROM a_pangenome WHERE kind = 'kind 0' UNION ALL SELECT gene_id, NULL, 'RNA' FROM a_pangenome WHERE kind = 'kind 1'")
def merged_features(spark, d):
    g = A.pangenome(spark, d)
    return references.merged_features(g.filter("kind = 'kind 0'").select("gene_id", "description"), g.filter("kind = 'kind 1'").select("gene_id"))


@_query("SELECT gene_id, description FROM a_pangenome WHERE CONTAINS(description, 'ring')")
def genes_by_annotation(spark, d):
    return references.mentioning(A.pangenome(spark, d).select("gene_id", "description"), "description", "ring")


@_query(f"WITH {_COPY}, p AS (SELECT species, gene_id, AVG(CASE WHEN cn >= 0.3::DOUBLE THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS prevalence FROM k GROUP BY 1, 2), g AS (SELECT DISTINCT gene_id FROM a_site_info UNION SELECT DISTINCT 'x' || gene_id FROM a_site_info) SELECT s.species, g.gene_id, ROUND(COALESCE(prevalence, 0), 6) AS prevalence FROM g CROSS JOIN (SELECT DISTINCT species FROM p) s LEFT JOIN p ON p.species = s.species AND p.gene_id = g.gene_id")
def pangenome_prevalence(spark, d):
    own = A.site_info(spark, d).select("gene_id").distinct()
    every = own.union(own.select(F.concat(F.lit("x"), "gene_id")))
    known = genes.prevalence(_copies(spark, d)).select("species", "gene_id", "prevalence")
    return rounded(references.filled_prevalence(every, known))


_POP = "pp AS (SELECT species, contig, pos, AVG(CASE WHEN 2 * alt >= depth THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS p FROM a_site_counts WHERE depth > 0 GROUP BY 1, 2, 3)"


@_query(f"WITH {_POP} SELECT species, contig, pos, ROUND(p, 6) AS freq FROM pp WHERE p <> 0")
def population_freqs(spark, d):
    return rounded(references.population_freqs(snps.prevalence(A.site_counts(spark, d))))


@_query(f"WITH {_POP} SELECT species, contig, pos, ROUND(LEAST(p, 1 - p), 6) AS freq FROM pp WHERE LEAST(p, 1 - p) <> 0")
def population_freqs_by_consensus(spark, d):
    return rounded(references.population_freqs(snps.prevalence(A.site_counts(spark, d)), by_consensus=True))


@_query("SELECT DISTINCT species, CASE species WHEN 'sp1' THEN 0.02::DOUBLE ELSE 0.01::DOUBLE END AS threshold FROM a_site_counts")
def clade_thresholds(spark, d):
    return references.clade_thresholds(A.site_counts(spark, d).select("species").distinct(), {"sp1": 0.02})


@_query(
    """WITH s AS (SELECT contig, pos, CASE WHEN pos % 50 < 3 THEN 'non coding' ELSE gene_id END AS gene_id FROM a_site_info), b AS (SELECT *, COALESCE(gene_id <> LAG(gene_id) OVER (PARTITION BY contig ORDER BY pos), TRUE) AS starts FROM s)
       SELECT *, SUM(CAST(starts AS INTEGER)) OVER (PARTITION BY contig ORDER BY pos) AS run FROM b"""
)
def gene_breaks(spark, d):
    s = A.site_info(spark, d).select("contig", "pos", F.when(F.col("pos") % 50 >= 3, F.col("gene_id")).alias("gene_id"))
    return references.gene_breaks(s)


@_query("WITH e AS (SELECT contig, MAX(pos) AS e FROM a_site_info GROUP BY 1), b AS (SELECT contig, COALESCE(SUM(e) OVER (ORDER BY contig ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM e) SELECT contig, pos, CAST(pos + b AS BIGINT) AS coordinate FROM a_site_info JOIN b USING (contig)")
def genome_coordinates(spark, d):
    return references.genome_coordinates(A.site_info(spark, d).select("contig", "pos"))


@_query("SELECT species, gene_id, sample, reads FROM a_gene_counts WHERE sample IN ('S01', 'S02') AND CAST(SPLIT_PART(gene_id, '.', 4) AS INTEGER) % 5 <> 0")
def allowed_pangenome(spark, d):
    g = A.gene_counts(spark, d).filter(F.col("sample").isin("S01", "S02"))
    bad = g.select("gene_id").distinct().filter(F.element_at(F.split("gene_id", r"\."), -1).cast("int") % 5 == 0)
    return references.without(g, bad).select("species", "gene_id", "sample", "reads")


@_query(f"WITH {_COPY} SELECT DISTINCT species, gene_id FROM k GROUP BY 1, 2 HAVING MAX(cn) > 3 UNION SELECT 'sp9', gene_id FROM a_site_info")
def shared_genes_with_external(spark, d):
    return references.with_external_union(genes.shared(_copies(spark, d)), A.site_info(spark, d).select(F.lit("sp9").alias("species"), "gene_id"))


# packed formats: what is written and read back is the table itself ------------------


@_query(f"WITH {_HIST} SELECT * FROM h")
def packed_histogram(spark, d):
    lines = packed.cells(coverage.depth_histogram(A.site_counts(spark, d)), ["species", "sample"], ["depth", "n"])
    return packed.from_cells(lines, ["species", "sample"], {"depth": "bigint", "n": "bigint"})


@_query("SELECT sample, gene_id, pos, SUM(depth) AS depth FROM a_sites GROUP BY 1, 2, 3")
def packed_gene_depths(spark, d):
    rows = A.annotated(spark, d).groupBy("sample", "gene_id", "pos").agg(F.sum("depth").alias("depth"))
    return packed.from_cells(packed.cells(rows, ["sample", "gene_id"], ["pos", "depth"]), ["sample", "gene_id"], {"pos": "bigint", "depth": "bigint"})


@_query(f"WITH {_SFS} SELECT species, sample, variant_type, depth, alt, n FROM s")
def packed_spectrum(spark, d):
    by = ["species", "sample", "variant_type"]
    return packed.from_cells(packed.cells(snps.spectrum(A.annotated(spark, d)), by, ["depth", "alt", "n"]), by, {"depth": "bigint", "alt": "bigint", "n": "bigint"})


@_query(f"WITH {_LD}, q AS (SELECT species, p2 - p1 AS dist, (n11 / n - (n11 + n10) / n * (n11 + n01) / n) ** 2 AS num, (n11 + n10) / n * (1 - (n11 + n10) / n) * (n11 + n01) / n * (1 - (n11 + n01) / n) AS den FROM n WHERE n >= 4) SELECT species, CAST(FLOOR(dist / 3.0::DOUBLE) AS BIGINT) AS bin, ROUND(SUM(num), 6) AS num, ROUND(SUM(den), 6) AS den, COUNT(*) AS n FROM q WHERE den > 1e-9::DOUBLE GROUP BY 1, 2")
def packed_linkage(spark, d):
    rows = linkage.binned(linkage.sigma_squared(linkage.site_pair_counts(A.annotated(spark, d)))).select("species", "bin", "num", "den", "n")
    return rounded(packed.from_ratio_cells(packed.ratio_cells(rows, ["species"], "bin"), ["species"], "bin"))


@_query("SELECT species, contig, pos, ROUND(AVG(CASE WHEN alt::DOUBLE / depth > 0.1::DOUBLE THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS prevalence FROM a_site_counts GROUP BY 1, 2, 3 HAVING prevalence > 0")
def packed_prevalence(spark, d):
    return rounded(packed.from_contig_lists(packed.contig_lists(snps.preexisting(A.site_counts(spark, d)))))


@_query(f"WITH {_COPY} SELECT species, gene_id FROM k GROUP BY 1, 2 HAVING AVG(CASE WHEN cn >= 0.3::DOUBLE THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) >= 0.9::DOUBLE")
def gene_set_lines(spark, d):
    lines = packed.set_lines(genes.core(_copies(spark, d)), "species", "gene_id")
    return packed.from_set_lines(lines.union(spark.createDataFrame([("none: N/A",), ("# note",)], "value string")), "species", "gene_id")


@_query("SELECT DISTINCT species AS name FROM a_pangenome")
def species_list_lines(spark, d):
    s = A.pangenome(spark, d).select(F.concat(F.lit("  "), "species", F.lit(" ")).alias("value")).distinct()
    return packed.names(s.union(spark.createDataFrame([("",), ("   ",)], "value string")))


@_query(f"WITH {_COPY} SELECT species, gene_id, ROUND(AVG(CASE WHEN cn >= 0.3::DOUBLE THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS prevalence FROM k GROUP BY 1, 2")
def gene_frequency_lines(spark, d):
    rows = genes.prevalence(_copies(spark, d)).select("species", "gene_id", "prevalence")
    return rounded(packed.from_csv(packed.csv_lines(rows).union(spark.createDataFrame([("species,gene_id,prevalence",)], "value string")), "species string, gene_id string, prevalence double"))


@_query("WITH q AS (SELECT *, AVG(CASE WHEN 2 * alt >= depth THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) OVER (PARTITION BY species, contig, pos) AS p FROM a_site_counts WHERE depth > 0) SELECT species, contig, pos, ROUND(MIN(p), 6) AS alt_freq, ROUND(AVG(CASE WHEN (CASE WHEN p > 0.5 THEN depth - alt ELSE alt END) >= CEIL(depth * 0.1::DOUBLE) + 0.5::DOUBLE THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS snp_freq FROM q GROUP BY 1, 2, 3")
def prevalence_lines(spark, d):
    rows = snps.prevalence(A.site_counts(spark, d)).select("species", "contig", "pos", "alt_freq", "snp_freq")
    return rounded(packed.from_csv(packed.csv_lines(rows), "species string, contig string, pos bigint, alt_freq double, snp_freq double"))


_RAGGED = f"{_FLIPS}, op AS (SELECT species, a.sample AS sample_1, b.sample AS sample_2, COUNT(*) AS n_opportunities FROM a_site_counts a JOIN a_site_counts b USING (species, contig, pos) WHERE a.sample < b.sample AND a.depth > 0 AND b.depth >= 20 GROUP BY 1, 2, 3)"
_BY = ["species", "sample_1", "sample_2"]


def _change_lines(spark, d):
    c = A.site_counts(spark, d)
    totals = changes.opportunities(c).filter("sample_1 < sample_2").select(*_BY, F.col("n_sites").alias("n_opportunities"), F.lit(0.25).alias("error"))
    lines = packed.ragged(changes.flips(c), totals, _BY, ["contig", "pos", "kind"])
    return packed.from_ragged(lines, _BY, {"contig": "string", "pos": "bigint", "kind": "string"})


@_query(f"WITH {_RAGGED} SELECT species, contig, pos, sample_1, sample_2, kind FROM fl JOIN op USING (species, sample_1, sample_2)")
def change_lines(spark, d):
    return _change_lines(spark, d)[1]


@_query(f"WITH {_RAGGED} SELECT *, 0.25::DOUBLE AS error FROM op")
def opportunity_lines(spark, d):
    return _change_lines(spark, d)[0]


@_query("SELECT species, contig, pos, gene_id, variant_type, sample, alt, depth FROM a_sites WHERE pos % 10 < 5")
def annotated_snp_lines(spark, d):
    sites = A.annotated(spark, d).withColumn("pvalue", F.when(F.col("pos") % 10 < 5, 0.01).otherwise(0.2))
    return packed.from_snp_lines(packed.snp_lines(sites))


@_query("SELECT species, sample, ROUND(coverage, 6) AS coverage FROM a_species_profile")
def wide_matrix(spark, d):
    rows = A.species_profile(spark, d)
    # the table's samples are the nations' numbers: the header of a matrix is named, not looked up
    names = sorted(f"N{k}" for k in range(25))
    return rounded(midas.long(packed.wide(rows, "species", "sample", "coverage", names), "species", "coverage").select("species", "sample", "coverage"))


@_query("SELECT c_custkey AS id, PRINTF('%g', c_acctbal) AS text FROM customer")
def general_numbers(spark, d):
    c = spark.read.parquet(f"{d}/customer.parquet")
    return c.select(F.col("c_custkey").alias("id"), packed.general(F.col("c_acctbal")).alias("text"))


# gene filters and names of the diversity scan ------------------------------------------


@_query("SELECT species, sample, COUNT(*) AS n_sites, SUM(depth)::BIGINT AS depth FROM a_sites WHERE CAST(SPLIT_PART(gene_id, '.', 4) AS INTEGER) % 3 <> 0 GROUP BY 1, 2")
def sites_without_listed_genes(spark, d):
    sites = A.annotated(spark, d)
    bad = A.site_info(spark, d).select("gene_id").distinct().filter(F.element_at(F.split("gene_id", r"\."), -1).cast("int") % 3 == 0)
    return diversity.without_genes(sites, bad).groupBy("species", "sample").agg(F.count(F.lit(1)).alias("n_sites"), F.sum("depth").cast("bigint").alias("depth"))


@_query("SELECT CASE WHEN CAST(SPLIT_PART(gene_id, '.', 4) AS INTEGER) % 2 = 0 THEN 'c' || CAST(CAST(SPLIT_PART(gene_id, '.', 4) AS INTEGER) % 4 AS VARCHAR) ELSE gene_id END AS gene_id, COUNT(*) AS n_sites FROM a_sites GROUP BY 1")
def sites_by_gene_alias(spark, d):
    number = F.element_at(F.split("gene_id", r"\."), -1).cast("int")
    alias = A.site_info(spark, d).select("gene_id").distinct().filter(number % 2 == 0).select("gene_id", F.concat(F.lit("c"), (number % 4).cast("string")).alias("alias_of"))
    return diversity.renamed_genes(A.annotated(spark, d), alias).groupBy("gene_id").agg(F.count(F.lit(1)).alias("n_sites"))


@_query("SELECT DISTINCT sample FROM a_metadata")
def unmerged_names(spark, d):
    from lociweave.functions import expr

    return A.metadata(spark, d).select(expr.unmerged(F.concat(F.lit(" "), "sample", F.lit("c "))).alias("sample")).distinct()


@_query("SELECT species, contig, pos, sample, CAST(ROUND_EVEN(rf * depth, 0) AS BIGINT) AS rounded, CAST(FLOOR(rf * depth) AS BIGINT) AS truncated FROM a_sites")
def reference_reads(spark, d):
    from lociweave.functions import expr

    s = diversity.with_freq(A.annotated(spark, d))
    return s.select("species", "contig", "pos", "sample", expr.ref_count_rounded(F.col("rf"), F.col("depth")).cast("bigint").alias("rounded"), expr.ref_count(F.col("rf"), F.col("depth")).cast("bigint").alias("truncated"))


@_query("WITH s AS (SELECT species, contig, pos FROM a_site_counts GROUP BY 1, 2, 3 HAVING SUM(CASE WHEN alt > CEIL(0.05::DOUBLE * depth) + 0.5::DOUBLE THEN 1 ELSE 0 END) > 0) SELECT species, sample, COUNT(*) AS n, CAST(SUM(alt) AS BIGINT) AS alt FROM a_site_counts JOIN s USING (species, contig, pos) GROUP BY 1, 2")
def called_site_counts(spark, d):
    return changes.called_counts(A.site_counts(spark, d)).groupBy("species", "sample").agg(F.count(F.lit(1)).alias("n"), F.sum("alt").cast("bigint").alias("alt"))
