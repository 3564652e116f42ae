"""Reference genomes and gene annotations: which gene stands for which, and which genes count."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lociweave.functions import expr
from lociweave.operators.snps import SITE

#: Fixed value: the divergence that parts clades of species without a threshold of their own.
CLADE_THRESHOLD = 0.01


def centroid_names(genes: DataFrame, reference: DataFrame, centroid: str = "centroid_95") -> DataFrame:
    """(centroid, name): a reference gene of the centroid, else its last gene in file order; of several the last."""
    own = reference.select("gene_id").distinct().withColumn("_ref", F.lit(1))
    rows = genes.join(own, "gene_id", "left").withColumn("_ref", F.coalesce("_ref", F.lit(0)))
    return rows.groupBy(F.col(centroid).alias("centroid")).agg(F.max_by("gene_id", F.struct("_ref", "line")).alias("name"))


def gene_centroids(genes: DataFrame, names: DataFrame, centroid: str = "centroid_95") -> DataFrame:
    """(gene_id, centroid, name) of every gene."""
    return genes.select("gene_id", F.col(centroid).alias("centroid")).join(names, "centroid")


def centroid_members(genes: DataFrame, centroid: str = "centroid_95") -> DataFrame:
    return genes.groupBy(F.col(centroid).alias("centroid")).agg(F.array_join(F.array_sort(F.collect_set("gene_id")), ",").alias("genes"), F.count(F.lit(1)).alias("n"))


def renamed(rows: DataFrame, names: DataFrame) -> DataFrame:
    """``rows`` by gene with their gene's name in place of its id, where it has one."""
    known = names.select(F.col("gene_id").alias("_g"), "name").dropDuplicates(["_g"])
    return rows.join(known, F.col("gene_id") == F.col("_g"), "left").withColumn("gene_id", F.coalesce("name", "gene_id")).drop("_g", "name")


def without(rows: DataFrame, genes: DataFrame) -> DataFrame:
    return rows.join(genes.select("gene_id").distinct(), "gene_id", "left_anti")


def only(rows: DataFrame, genes: DataFrame) -> DataFrame:
    return rows.join(genes.select("gene_id").distinct(), "gene_id", "left_semi")


def representatives(genes: DataFrame) -> DataFrame:
    """(species, genome, representative): the genomes of each species, the first of them standing for it."""
    rows = genes.select("species", "genome").distinct()
    return rows.withColumn("representative", F.col("genome") == F.min("genome").over(Window.partitionBy("species")))


def reference_genes(genes: DataFrame) -> DataFrame:
    """The genes of each species' representative genome."""
    one = representatives(genes).filter("representative").select("species", "genome")
    return genes.join(one, ["species", "genome"], "left_semi").select("species", "gene_id").distinct()


def genome_counts(genes: DataFrame) -> DataFrame:
    return genes.groupBy("species").agg(F.countDistinct("genome").alias("n_genomes"), F.countDistinct("gene_id").alias("n_genes"))


def with_new_species(genes: DataFrame, extra: str = "new_species") -> DataFrame:
    """The species that have a pangenome, and a name for those to come."""
    return genes.select("species").distinct().unionByName(genes.sparkSession.createDataFrame([(extra,)], "species string"))


def marker_genes(genes: DataFrame, markers: DataFrame, kinds: list[str], reference: DataFrame | None = None) -> DataFrame:
    """Genes of the marker kinds, and of the reference where it is given."""
    hits = markers.filter(F.col("marker").isin(*kinds)).join(genes.select("species", "gene_id").distinct(), ["species", "gene_id"], "left_semi").select("species", "gene_id").distinct()
    return hits if reference is None else hits.join(reference.select("species", "gene_id"), ["species", "gene_id"], "left_semi")


def core_of_hosts(copies: DataFrame, samples: DataFrame, reference: DataFrame, least: float = 0.3, share: float = 0.9, marker_least: float = 20.0) -> DataFrame:
    """Reference genes present in ``share`` of the well covered samples, the first of each subject."""
    covered = copies.filter(F.col("marker_coverage") >= marker_least).join(samples.select("sample", "subject_id"), "sample")
    first = covered.groupBy("species", "subject_id").agg(F.min("sample").alias("sample")).select("species", "sample")
    rows = covered.join(first, ["species", "sample"], "left_semi")
    kept = rows.groupBy("species", "gene_id").agg(F.avg(F.when(F.col("copynum") >= least, 1.0).otherwise(0.0)).alias("prevalence")).filter(F.col("prevalence") >= share)
    return only(kept, reference)


def reads_per_genome(counts: DataFrame, genes: DataFrame) -> DataFrame:
    """Reads of each sample on each genome; genes of a genome without reads count 0."""
    samples = counts.agg(F.collect_set("sample").alias("_all"))
    grid = genes.select("gene_id").distinct().join(F.broadcast(samples), F.lit(True)).select("gene_id", F.explode("_all").alias("sample"))
    reads = counts.groupBy("gene_id", "sample").agg(F.sum("reads").alias("reads"))
    return grid.join(reads, ["gene_id", "sample"], "left").groupBy("sample", expr.genome_of(F.col("gene_id")).alias("genome")).agg(F.coalesce(F.sum("reads"), F.lit(0)).alias("reads"))


def shared_between_species(genes: DataFrame, centroids: DataFrame, centroid: str = "centroid_95") -> DataFrame:
    """The listed centroids and all genes in them."""
    listed = centroids.select("centroid").distinct()
    members = genes.select(F.col(centroid).alias("centroid"), "gene_id").join(listed, "centroid", "left_semi").select("gene_id")
    return members.union(listed.select(F.col("centroid").alias("gene_id"))).distinct()


def with_property(annotations: DataFrame, name: str | None = None) -> DataFrame:
    """(gene_id, property, product) of each gene, the last line of a gene counting; those of one property if it is named."""
    last = annotations.groupBy("gene_id").agg(F.max_by(F.struct("property", "product"), "line").alias("a")).select("gene_id", "a.property", "a.product")
    return last if name is None else last.filter(F.col("property") == name)


def merged_features(coding: DataFrame, rna: DataFrame) -> DataFrame:
    return coding.withColumn("feature", F.lit("CDS")).unionByName(rna.withColumn("feature", F.lit("RNA")), allowMissingColumns=True)


def mentioning(rows: DataFrame, column: str, text: str) -> DataFrame:
    return rows.filter(F.col(column).contains(text))


def filled_prevalence(genes: DataFrame, prevalence: DataFrame) -> DataFrame:
    """Every gene of the pangenome with its prevalence in each species, 0 for genes that no sample has."""
    every = genes.select("gene_id").distinct().join(F.broadcast(prevalence.agg(F.collect_set("species").alias("_s"))), F.lit(True)).select("gene_id", F.explode("_s").alias("species"))
    return every.join(prevalence, ["species", "gene_id"], "left").select("species", "gene_id", F.coalesce("prevalence", F.lit(0.0)).alias("prevalence"))


def population_freqs(prevalence: DataFrame, by_consensus: bool = False) -> DataFrame:
    """Alternate frequency of the sites that vary; by consensus the rarer allele's."""
    f = expr.folded(F.col("alt_freq")) if by_consensus else F.col("alt_freq")
    return prevalence.select(*SITE, f.alias("freq")).filter("freq <> 0")


def clade_thresholds(species: DataFrame, known: dict[str, float]) -> DataFrame:
    held = F.try_element_at(F.create_map(*[F.lit(x) for kv in known.items() for x in kv]), F.col("species")) if known else F.lit(None)
    return species.select("species", F.coalesce(held.cast("double"), F.lit(CLADE_THRESHOLD)).alias("threshold"))


def gene_breaks(sites: DataFrame) -> DataFrame:
    """Sites with their gene ('non coding' where there is none) and the number of its run along the contig."""
    gene = F.coalesce("gene_id", F.lit("non coding"))
    w = Window.partitionBy("contig").orderBy("pos")
    rows = sites.withColumn("gene_id", gene).withColumn("starts", F.coalesce(F.col("gene_id") != F.lag("gene_id").over(w), F.lit(True)))
    return rows.withColumn("run", F.sum(F.col("starts").cast("int")).over(w))


def genome_coordinates(sites: DataFrame) -> DataFrame:
    """Sites with their place along all contigs, one after the other by name."""
    ends = sites.groupBy("contig").agg(F.max("pos").alias("_end"))
    before = F.coalesce(F.sum("_end").over(Window.orderBy("contig").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return sites.join(F.broadcast(ends.select("contig", before.alias("_before"))), "contig").withColumn("coordinate", F.col("pos") + F.col("_before")).drop("_before")


def with_external_union(own: DataFrame, external: DataFrame) -> DataFrame:
    return own.union(external).distinct()


def panel_genomes(genomes: DataFrame, annotation: str, text: str) -> DataFrame:
    """Genomes whose annotation names a reference panel, each once; rows without an annotation are left out."""
    return genomes.filter(F.col(annotation).contains(text)).drop(annotation).distinct()
