"""Gene copy number, prevalence, gains and losses, and gene sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lociweave.functions import expr
from lociweave.operators.blocks import counted, opposed_pairs, pair_sums

GENE = ("species", "gene_id")


def copy_number(genes: DataFrame, marker: DataFrame) -> DataFrame:
    """Depth over the sample's marker depth, which counts as 1 at least."""
    joined = genes.join(marker.select("species", "sample", "marker_coverage"), ["species", "sample"])
    return joined.withColumn("copynum", F.col("depth") / F.greatest(F.col("marker_coverage"), F.lit(1.0)))


def marker_coverage(genes: DataFrame) -> DataFrame:
    """Median gene depth of a sample, where no marker genes are known."""
    return genes.groupBy("species", "sample").agg(F.percentile("depth", 0.5).alias("marker_coverage"))


def prevalence(copies: DataFrame, least: float = 0.3) -> DataFrame:
    flag = F.when(F.col("copynum") >= least, 1).otherwise(0)
    return copies.groupBy(*GENE).agg(F.sum(flag).alias("n_present"), F.avg(flag.cast("double")).alias("prevalence"))


def genes_per_sample(copies: DataFrame, least: float = 0.5) -> DataFrame:
    return copies.groupBy("species", "sample").agg(F.sum(F.when(F.col("copynum") >= least, 1).otherwise(0)).alias("n_genes"))


def gain_loss(copies: DataFrame, absent: float = 0.05, low: float = 0.6, high: float = 1.2) -> DataFrame:
    """Gains, losses and opportunities of each pair; a normal gene lies strictly between ``low`` and ``high``."""
    state = F.when(F.col("copynum") <= absent, F.lit(0)).when((F.col("copynum") > low) & (F.col("copynum") < high), F.lit(1))
    rows = copies.withColumn("state", state).filter("state is not null")
    has, lacks = F.col("state"), 1 - F.col("state")
    sums = {"opportunities": [(1.0, "n", "n")], "gains": [(1.0, "lacks", "has")], "losses": [(1.0, "has", "lacks")]}
    got = pair_sums(rows, {"n": F.lit(1), "has": has, "lacks": lacks}, sums, "opportunities", site=GENE)
    return got.select("species", "sample_1", "sample_2", counted("gains"), counted("losses"), counted("opportunities"))


def core(copies: DataFrame, least: float = 0.3, share: float = 0.9, marker_least: float | None = None) -> DataFrame:
    """Genes present in at least ``share`` of the well covered samples."""
    rows = copies if marker_least is None else copies.filter(F.col("marker_coverage") >= marker_least)
    return prevalence(rows, least).filter(F.col("prevalence") >= share).select(*GENE)


def shared(copies: DataFrame, most: float = 3.0) -> DataFrame:
    """Genes whose copy number in some sample says they are shared between species."""
    return copies.groupBy(*GENE).agg(F.max("copynum").alias("_m")).filter(F.col("_m") > most).select(*GENE)


def stringent(copies: DataFrame, least: float = 0.3) -> DataFrame:
    """Genes absent in no sample."""
    return copies.groupBy(*GENE).agg(F.min("copynum").alias("_m")).filter(F.col("_m") >= least).select(*GENE)


def personal_core(core_genes: DataFrame, shared_genes: DataFrame) -> DataFrame:
    return core_genes.join(shared_genes, list(GENE), "left_anti")


def with_external(own: DataFrame, external: DataFrame) -> DataFrame:
    """The intersection with an external set, or the own set where the external one is empty."""
    return own.intersect(external) if external.limit(1).count() else own


def changed_genes(copies: DataFrame, absent: float = 0.05, low: float = 0.6, high: float = 1.2) -> DataFrame:
    """Genes that appear or vanish between two samples."""
    state = F.when(F.col("copynum") <= absent, F.lit(0)).when((F.col("copynum") > low) & (F.col("copynum") < high), F.lit(1))
    pairs = opposed_pairs(copies.withColumn("state", state).filter("state is not null"), F.col("state") == 1, ("state",), GENE)
    return pairs.select(*GENE, "sample_1", "sample_2", F.when(F.col("state_1") == 0, "gain").otherwise("loss").alias("kind"))


def merged_nearby(changes: DataFrame, most: int = 5) -> DataFrame:
    """Changed genes of a pair as runs of genes at most ``most`` numbers apart."""
    by = ["species", "sample_1", "sample_2", F.substring_index("gene_id", ".", 2)]
    n = expr.gene_number(F.col("gene_id"))
    w = Window.partitionBy(*by).orderBy(n, "gene_id")
    fresh = F.when(n - F.lag(n).over(w) <= most, 0).otherwise(1)
    run = changes.withColumn("_new", fresh).withColumn("run", F.sum("_new").over(w))
    return run.groupBy("species", "sample_1", "sample_2", F.substring_index("gene_id", ".", 2).alias("genome"), "run").agg(F.count(F.lit(1)).alias("n_genes"), F.min(n).alias("first_gene"), F.max(n).alias("last_gene"))


def neighbours(genes: DataFrame, spacing: int = 1) -> DataFrame:
    """Existing genes within ``spacing`` numbers of each gene; the band becomes an equality by listing its numbers."""
    g = genes.select("gene_id").distinct().select("gene_id", F.substring_index("gene_id", ".", 2).alias("_g"), F.regexp_extract("gene_id", r"^\d+\.\d+\.([a-z]+)\.", 1).alias("_k"), expr.gene_number(F.col("gene_id")).alias("_n"))
    asked = g.select("gene_id", "_g", "_k", F.explode(F.array(*[F.col("_n") + k for k in range(-spacing, spacing + 1) if k])).alias("_n"))
    return asked.join(g.withColumnRenamed("gene_id", "neighbour"), ["_g", "_k", "_n"]).select("gene_id", "neighbour")


def pathway_histogram(prev: DataFrame, pathways: DataFrame) -> DataFrame:
    """Genes of each pathway by prevalence class; genes without a pathway are left out."""
    bins = F.when(F.col("prevalence") < 0.1, "0-0.1").when(F.col("prevalence") < 0.5, "0.1-0.5").when(F.col("prevalence") < 0.9, "0.5-0.9").otherwise("0.9-1")
    return prev.join(pathways, "gene_id").withColumn("bin", bins).groupBy("species", "pathway", "bin").agg(F.count(F.lit(1)).alias("n_genes"))
