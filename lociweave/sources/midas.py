"""Readers for merged metagenomic profiles: wide text matrices in, long tables out.

Every matrix has a key column and one column a sample; sample names come from the
header. Rows are matched by key, never by line, and the key of a site is split
here. Spark reads plain, gzip and bzip2 text; LZ4 frames go through ``lz4_lines``.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


class Layout(NamedTuple):
    """Where a version of the profile keeps variant type and gene in its site table (columns from 0)."""

    variant_type: int
    gene: int
    suffix: str


#: The two layouts in use.
V1 = Layout(5, 6, ".txt.bz2")
V3 = Layout(15, 14, ".tsv.lz4")


def lz4_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of LZ4-framed text, a file a task; the codec comes with the Arrow library."""
    import pyarrow as pa

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column(0):
                stream = pa.input_stream(pa.BufferReader(raw.as_py()), compression="lz4")
                rest = b""
                while chunk := stream.read(1 << 24):
                    *full, rest = (rest + chunk).split(b"\n")
                    yield pa.RecordBatch.from_arrays([pa.array([x.decode() for x in full], pa.string())], names=["value"])
                if rest:
                    yield pa.RecordBatch.from_arrays([pa.array([rest.decode()], pa.string())], names=["value"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(lines, "value string")


def wide(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    return spark.read.csv(path, sep=sep, header=True)


def long(matrix: DataFrame, key: str, value: str, kind: str = "double") -> DataFrame:
    """(key, sample, value) of a wide matrix; empty cells are dropped."""
    first, *samples = matrix.columns
    out = matrix.unpivot([F.col(f"`{first}`").alias(key)], [f"`{s}`" for s in samples], "sample", value)
    return out.select(key, "sample", F.col(value).cast(kind).alias(value)).filter(F.col(value).isNotNull())


def unique_keys(rows: DataFrame, key: str) -> DataFrame:
    """``rows``, failing where a key occurs twice."""
    n = F.count(F.lit(1)).over(Window.partitionBy(key))
    return rows.withColumn("_n", n).withColumn(key, F.when(F.col("_n") > 1, F.raise_error(F.concat(F.lit("duplicate key "), F.col(key)))).otherwise(F.col(key))).drop("_n")


def split_site(site: Column) -> tuple[Column, Column]:
    """Contig and position of ``contig|pos...`` or ``accn|contig|pos...``."""
    parts = F.split(site, r"\|")
    shift = F.when(F.get(parts, F.lit(0)) == "accn", F.lit(1)).otherwise(F.lit(0))
    contig = F.when(shift == 1, F.concat(F.lit("accn|"), F.get(parts, F.lit(1)))).otherwise(F.get(parts, F.lit(0)))
    return contig, F.get(parts, shift + 1).cast("bigint")


def site_counts(spark: SparkSession, folder: str, species: str, suffix: str = V1.suffix) -> DataFrame:
    """(species, contig, pos, sample, depth, alt) of a species' SNP matrices; alt by half-even rounding."""
    depth = long(unique_keys(wide(spark, f"{folder}/snps_depth{suffix}"), "site_id"), "site_id", "depth", "bigint")
    freq = long(wide(spark, f"{folder}/snps_ref_freq{suffix}"), "site_id", "ref_freq")
    contig, pos = split_site(F.col("site_id"))
    both = depth.join(freq, ["site_id", "sample"])
    alt = F.col("depth") - F.bround(F.col("ref_freq") * F.col("depth")).cast("bigint")
    return both.select(F.lit(species).alias("species"), contig.alias("contig"), pos.alias("pos"), "sample", "depth", alt.alias("alt"))


def site_info(spark: SparkSession, folder: str, layout: Layout = V1) -> DataFrame:
    """(contig, pos, variant_type, gene_id); a missing gene is null, as for sites between genes."""
    rows = spark.read.text(f"{folder}/snps_info{layout.suffix}") if layout is V1 else lz4_lines(spark, f"{folder}/snps_info{layout.suffix}")
    parts = F.split("value", "\t")
    contig, pos = split_site(F.get(parts, F.lit(0)))
    gene = F.nullif(F.nullif(F.trim(F.get(parts, F.lit(layout.gene))), F.lit("")), F.lit("NA"))
    return rows.filter(~F.col("value").startswith("site_id")).select(contig.alias("contig"), pos.alias("pos"), F.get(parts, F.lit(layout.variant_type)).alias("variant_type"), gene.alias("gene_id"))


def gene_counts(spark: SparkSession, folder: str, species: str, suffix: str = V1.suffix) -> DataFrame:
    """(species, gene_id, sample, reads, depth, marker_coverage) of a species' pangenome matrices."""
    reads = long(wide(spark, f"{folder}/genes_reads{suffix}"), "gene_id", "reads", "bigint")
    depth = long(wide(spark, f"{folder}/genes_depth{suffix}"), "gene_id", "depth")
    summary = spark.read.csv(f"{folder}/genes_summary.txt", sep="\t", header=True)
    marker = summary.select(F.col(f"`{summary.columns[0]}`").alias("sample"), F.col(f"`{summary.columns[5]}`").cast("double").alias("marker_coverage"))
    return reads.join(depth, ["gene_id", "sample"]).join(marker, "sample").select(F.lit(species).alias("species"), "gene_id", "sample", "reads", "depth", "marker_coverage")


def species_profile(spark: SparkSession, path: str, value: str = "coverage") -> DataFrame:
    return long(wide(spark, path), "species", value).select("species", "sample", value)


def packed_cells(lines: DataFrame, names: list[str], values: list[str], sep: str = "\t") -> DataFrame:
    """Long rows of lines whose first fields are ``names`` and whose others are cells ``a,b,...``."""
    parts = F.split("value", sep)
    # split before the cells are made rows: beside the generator a line would be split again for each
    made = lines.select(*[F.get(parts, F.lit(k)).alias(n) for k, n in enumerate(names)], F.slice(parts, len(names) + 1, F.greatest(F.size(parts) - len(names), F.lit(0))).alias("_cells"))
    cells = made.select(*names, F.explode("_cells").alias("_c"))
    inner = F.split("_c", ",")
    return cells.filter(F.col("_c").contains(",")).select(*names, *[F.get(inner, F.lit(k)).cast("double").alias(v) for k, v in enumerate(values)])


def gene_sets(spark: SparkSession, path: str, name: str) -> DataFrame:
    """(species, set_name, gene_id) of lines ``species: gene, gene``; N/A stands for an empty set."""
    parts = F.split("value", ":", 2)
    genes = F.explode(F.split(F.get(parts, F.lit(1)), ","))
    return spark.read.text(path).filter(F.col("value").contains(":")).select(F.trim(F.get(parts, F.lit(0))).alias("species"), F.lit(name).alias("set_name"), genes.alias("gene_id")).withColumn("gene_id", F.trim("gene_id")).filter("gene_id not in ('', 'N/A')")


def centroid_map(spark: SparkSession, path: str, reference: DataFrame | None = None) -> DataFrame:
    """(gene_id, genome, centroid_99, centroid_95) with a name for each centroid: a reference gene if there is one, else the largest id."""
    t = spark.read.csv(path, sep="\t", header=True)
    rows = t.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(t.columns, ("gene_id", "genome", "centroid_99", "centroid_95"), strict=False)])
    known = rows.withColumn("_r", F.lit(False)) if reference is None else rows.join(reference.select("gene_id").distinct().withColumn("_r", F.lit(True)), "gene_id", "left").withColumn("_r", F.coalesce("_r", F.lit(False)))
    w = Window.partitionBy("centroid_95")
    return known.withColumn("name", F.max_by("gene_id", F.struct("_r", "gene_id")).over(w)).drop("_r")


def pathways(spark: SparkSession, path: str) -> DataFrame:
    """(gene_id, pathway, description) of lines whose last ``|`` field is the gene and whose others are ``id|desc;id|desc``."""
    head = F.regexp_extract("value", r"^(.*)\t", 1)
    gene = F.regexp_extract("value", r"\|([^|\t]+)\t[^\t]*$", 1)
    entries = F.explode(F.split(F.regexp_extract("value", r"\t([^\t]*)$", 1), ";"))
    return spark.read.text(path).filter(head != "").select(gene.alias("gene_id"), entries.alias("_e")).filter(F.col("_e").contains("|")).select("gene_id", F.substring_index("_e", "|", 1).alias("pathway"), F.substring_index("_e", "|", -1).alias("description"))


def fasta(spark: SparkSession, path: str) -> DataFrame:
    """(name, sequence); records are split where the file is read, so a file may be of any size."""
    records = spark.read.text(path, lineSep="\n>").select(F.regexp_replace("value", "^>", "").alias("r")).filter("trim(r) <> ''")
    name = F.get(F.split(F.substring_index("r", "\n", 1), r"\s+"), F.lit(0))
    return records.select(name.alias("name"), F.regexp_replace(F.regexp_replace("r", r"^[^\n]*\n?", ""), r"\s", "").alias("sequence"))


def manual_clades(spark: SparkSession, path: str) -> DataFrame:
    """(species, clade_id, sample): a line names a species, lines of dashes part its clades, others are ``number sample``."""
    whole = spark.read.text(path, wholetext=True)
    lines = whole.select(F.posexplode(F.split("value", "\n")).alias("k", "x")).withColumn("x", F.trim("x")).filter("x <> ''")
    member = F.col("x").rlike(r"^\d+\s+\S+$")
    dash = F.col("x").startswith("-")
    w = Window.orderBy("k")
    marked = lines.withColumn("species", F.last(F.when(~member & ~dash, F.col("x")), ignorenulls=True).over(w)).withColumn("_b", F.sum(F.when(dash, 1).otherwise(0)).over(w)).filter(member)
    return marked.select("species", F.dense_rank().over(Window.partitionBy("species").orderBy("_b")).alias("clade_id"), F.regexp_extract("x", r"^\d+\s+(\S+)$", 1).alias("sample"))


def metadata(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    """Sample metadata with the order of the gut site; an unknown site fails."""
    from lociweave.functions import expr

    rows = spark.read.csv(path, sep=sep, header=True)
    order = expr.lookup(expr.SITE_ORDER, F.col("tissue_type"))
    return rows.withColumn("ord", F.when(order.isNull(), F.raise_error(F.concat(F.lit("unknown site "), F.coalesce("tissue_type", F.lit("null")))).cast("int")).otherwise(order))


def cohorts(tables: list[DataFrame], key: str = "sample") -> DataFrame:
    """Union of metadata tables, of which a later one overrides an earlier by ``key``."""
    tagged = [t.withColumn("_p", F.lit(k)) for k, t in enumerate(tables)]
    out = tagged[0]
    for t in tagged[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("_p")))).filter("_n = 1").drop("_p", "_n")


def newick_leaves(text: str) -> list[str]:
    """Leaf names in order of a tree in bracket notation."""
    import re

    return [m[1] for m in re.finditer(r"(?<=[(,])\s*([^(),:;]+)", text)]


def private_snvs(spark: SparkSession, path: str) -> DataFrame:
    """(contig, pos, gene_id, variant_type, host) of a table of private SNVs with a header; fields may stand between blanks."""
    rows = spark.read.csv(path, header=True, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    kinds = ("string", "bigint", "string", "string", "string")
    return rows.select(*[F.col(f"`{c}`").cast(t).alias(n) for c, n, t in zip(rows.columns, ("contig", "pos", "gene_id", "variant_type", "host"), kinds, strict=False)])


def haplotypes(spark: SparkSession, path: str, samples: list[str] | None = None) -> DataFrame:
    """(contig, gene_id, pos, variant_type, sample, allele) of wide haplotype tables, of which ``path`` may name many by a pattern.

    All tables must have one header, else reading fails; ``samples`` takes these columns alone, and an empty cell is no row.
    """
    rows = spark.read.csv(path, header=True, enforceSchema=False)
    site, own = rows.columns[:4], [c for c in rows.columns[4:] if samples is None or c in samples]
    out = rows.unpivot([F.col(f"`{c}`").alias(n) for c, n in zip(site, ("contig", "gene_id", "pos", "variant_type"), strict=True)], [f"`{c}`" for c in own], "sample", "allele")
    return out.select("contig", "gene_id", F.col("pos").cast("bigint").alias("pos"), "variant_type", "sample", F.col("allele").cast("int").alias("allele")).filter("allele is not null")
