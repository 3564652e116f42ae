"""Benchmark tables seen as population-genetics tables, so that every query can run on them.

An order line's return flag plays the alternate allele, orders modulo 12 the
samples, parts the sites, and 20 parts a gene; no biology is in the numbers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _coded(prefix: str, number) -> F.Column:
    return F.concat(F.lit(prefix), number.cast("string"))


def site_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(species, contig, pos, sample, depth, alt)"""
    keys = [
        _coded("sp", F.col("l_suppkey") % 3).alias("species"), _coded("contig", F.col("l_partkey") % 3).alias("contig"), F.col("l_partkey").alias("pos"),
        F.concat(F.lit("S"), F.lpad((F.col("l_orderkey") % 12).cast("string"), 2, "0")).alias("sample"),
    ]
    rows = _read(spark, sf_dir, "lineitem").select(*keys, "l_quantity", "l_returnflag")
    return rows.groupBy("species", "contig", "pos", "sample").agg(
        F.sum("l_quantity").cast("bigint").alias("depth"), F.coalesce(F.sum(F.when(F.col("l_returnflag") == "R", F.col("l_quantity"))), F.lit(0)).cast("bigint").alias("alt")
    )


def site_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``site_counts`` with a row for every sample at every site, of depth 0 where nothing was read, as a wide matrix has it."""
    counts = site_counts(spark, sf_dir)
    every = F.array_sort(F.collect_set("sample"))
    names = counts.agg(every.alias("_all"))
    held = counts.groupBy("species", "contig", "pos").agg(F.map_from_entries(F.collect_list(F.struct("sample", F.struct("depth", "alt")))).alias("_m"))
    # one row of sample names beside each site
    grid = held.join(F.broadcast(names), F.lit(True)).select("species", "contig", "pos", "_m", F.explode("_all").alias("sample"))
    own = F.try_element_at("_m", F.col("sample"))
    zero = F.lit(0).cast("bigint")
    return grid.select("species", "contig", "pos", "sample", F.coalesce(own["depth"], zero).alias("depth"), F.coalesce(own["alt"], zero).alias("alt"))


def site_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(contig, pos, gene_id, variant_type)"""
    p = _read(spark, sf_dir, "part")
    gene = _coded("1.1.peg.", F.floor(F.col("p_partkey") / 20))
    return p.select(_coded("contig", F.col("p_partkey") % 3).alias("contig"), F.col("p_partkey").alias("pos"), gene.alias("gene_id"), F.concat((1 + F.col("p_size") % 4).cast("string"), F.lit("D")).alias("variant_type"))


def annotated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Site counts with gene and variant type; the small side of the join is planned by size."""
    return site_counts(spark, sf_dir).join(site_info(spark, sf_dir), ["contig", "pos"])


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sample, subject_id, cage, ord)"""
    k = F.col("o_orderkey") % 12
    return (
        _read(spark, sf_dir, "orders")
        .select(F.concat(F.lit("S"), F.lpad(k.cast("string"), 2, "0")).alias("sample"), _coded("H", k % 5).alias("subject_id"), _coded("C", k % 2).alias("cage"), (1 + F.floor(k / 5)).alias("ord"))
        .distinct()
    )


def gene_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(species, gene_id, sample, depth, reads)"""
    rows = annotated(spark, sf_dir).groupBy("species", "gene_id", "sample")
    return rows.agg((F.sum("depth").cast("double") / 20.0).alias("depth"), F.count(F.lit(1)).alias("reads"))


def species_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(species, sample, coverage)"""
    o, c = _read(spark, sf_dir, "orders"), _read(spark, sf_dir, "customer")
    joined = o.select("o_custkey", "o_totalprice").join(c.select("c_custkey", "c_mktsegment", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    return joined.groupBy(F.col("c_mktsegment").alias("species"), _coded("N", F.col("c_nationkey")).alias("sample")).agg((F.sum("o_totalprice").cast("double") / 1e6).alias("coverage"))


def strain_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(species, subject_id, region, date, freq, n)"""
    e = _read(spark, sf_dir, "events")
    keys = [_coded("sp", F.col("user_id") % 3).alias("species"), _coded("H", F.col("user_id") % 5).alias("subject_id"), F.col("event_type").alias("region"), F.col("ts").cast("date").alias("date")]
    return e.groupBy(*keys).agg(F.avg(F.when(F.col("value") > 50, 1.0).otherwise(0.0)).alias("freq"), F.count(F.lit(1)).alias("n"))


def metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sample, subject_id, accession, visit, country, continent, coverage): one row a run"""
    c, n, r = (_read(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    k = F.col("c_custkey")
    rows = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.select(
        _coded("M", F.floor(k / 2)).alias("sample"), _coded("H", F.floor(k / 2) % 40).alias("subject_id"), _coded("R", k).alias("accession"), (1 + F.floor(k / 80) % 4).alias("visit"),
        F.col("n_name").alias("country"), F.col("r_name").alias("continent"), (F.col("c_acctbal") / 100.0).alias("coverage"),
    )


def mouse_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sample, value): names of the samples of 8 mice at 5 sites, and the inoculum"""
    k = F.col("c_custkey")
    code = F.element_at(F.array(*[F.lit(x) for x in ("Co", "Ce", "I", "J", "D")]), (F.floor(k / 8) % 5 + 1).cast("int"))
    name = F.when(k % 41 == 40, F.lit("TL1gDNAshort")).otherwise(F.concat(F.lit("M"), (1 + k % 8).cast("string"), code))
    return _read(spark, sf_dir, "customer").groupBy(name.alias("sample")).agg(F.sum("c_acctbal").alias("value"))


def pangenome(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(species, genome, gene_id, centroid_99, centroid_95, line, kind, description)"""
    k = F.col("p_partkey")
    genome = F.concat(F.lit("1."), (k % 5).cast("string"))
    return _read(spark, sf_dir, "part").select(
        F.col("p_type").alias("species"), genome.alias("genome"), F.concat(genome, F.lit(".peg."), k.cast("string")).alias("gene_id"), _coded("c99.", F.floor(k / 2)).alias("centroid_99"), _coded("c95.", F.floor(k / 4)).alias("centroid_95"),
        k.alias("line"), F.concat(F.lit("kind "), (F.col("p_size") % 3).cast("string")).alias("kind"), F.col("p_name").alias("description"),
    )


#: The same views as SQL common table expressions.
SQL_VIEWS = """
a_site_counts AS (
  SELECT CONCAT('sp', CAST(l_suppkey % 3 AS VARCHAR)) AS species, CONCAT('contig', CAST(l_partkey % 3 AS VARCHAR)) AS contig, l_partkey AS pos,
         CONCAT('S', LPAD(CAST(l_orderkey % 12 AS VARCHAR), 2, '0')) AS sample, CAST(SUM(l_quantity) AS BIGINT) AS depth,
         CAST(SUM(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) AS BIGINT) AS alt
  FROM lineitem GROUP BY 1, 2, 3, 4),
a_site_grid AS (
  SELECT s.species, s.contig, s.pos, n.sample, COALESCE(c.depth, 0) AS depth, COALESCE(c.alt, 0) AS alt
  FROM (SELECT DISTINCT species, contig, pos FROM a_site_counts) s CROSS JOIN (SELECT DISTINCT sample FROM a_site_counts) n
  LEFT JOIN a_site_counts c ON c.species = s.species AND c.contig = s.contig AND c.pos = s.pos AND c.sample = n.sample),
a_site_info AS (
  SELECT CONCAT('contig', CAST(p_partkey % 3 AS VARCHAR)) AS contig, p_partkey AS pos,
         CONCAT('1.1.peg.', CAST(CAST(FLOOR(CAST(p_partkey AS DOUBLE) / 20) AS BIGINT) AS VARCHAR)) AS gene_id, CONCAT(CAST(1 + p_size % 4 AS VARCHAR), 'D') AS variant_type
  FROM part),
a_sites AS (SELECT c.*, gene_id, variant_type, CAST(depth - alt AS DOUBLE) / depth AS rf, CAST(alt AS DOUBLE) / depth AS f FROM a_site_counts c JOIN a_site_info USING (contig, pos)),
a_samples AS (
  SELECT DISTINCT CONCAT('S', LPAD(CAST(o_orderkey % 12 AS VARCHAR), 2, '0')) AS sample, CONCAT('H', CAST((o_orderkey % 12) % 5 AS VARCHAR)) AS subject_id,
         CONCAT('C', CAST((o_orderkey % 12) % 2 AS VARCHAR)) AS cage, 1 + CAST(FLOOR(CAST(o_orderkey % 12 AS DOUBLE) / 5) AS BIGINT) AS ord
  FROM orders),
a_gene_counts AS (SELECT species, gene_id, sample, CAST(SUM(depth) AS DOUBLE) / CAST(20 AS DOUBLE) AS depth, COUNT(*) AS reads FROM a_sites GROUP BY 1, 2, 3),
a_metadata AS (
  SELECT CONCAT('M', CAST(CAST(FLOOR(c_custkey / 2.0) AS BIGINT) AS VARCHAR)) AS sample, CONCAT('H', CAST(CAST(FLOOR(c_custkey / 2.0) AS BIGINT) % 40 AS VARCHAR)) AS subject_id, CONCAT('R', CAST(c_custkey AS VARCHAR)) AS accession,
         1 + CAST(FLOOR(c_custkey / 80.0) AS BIGINT) % 4 AS visit, n_name AS country, r_name AS continent, c_acctbal / 100.0::DOUBLE AS coverage
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
a_mouse_samples AS (
  SELECT CASE WHEN c_custkey % 41 = 40 THEN 'TL1gDNAshort' ELSE CONCAT('M', CAST(1 + c_custkey % 8 AS VARCHAR), ['Co', 'Ce', 'I', 'J', 'D'][CAST(FLOOR(c_custkey / 8.0) AS BIGINT) % 5 + 1]) END AS sample, SUM(c_acctbal) AS value
  FROM customer GROUP BY 1),
a_pangenome AS (
  SELECT p_type AS species, CONCAT('1.', CAST(p_partkey % 5 AS VARCHAR)) AS genome, CONCAT('1.', CAST(p_partkey % 5 AS VARCHAR), '.peg.', CAST(p_partkey AS VARCHAR)) AS gene_id,
         CONCAT('c99.', CAST(CAST(FLOOR(p_partkey / 2.0) AS BIGINT) AS VARCHAR)) AS centroid_99, CONCAT('c95.', CAST(CAST(FLOOR(p_partkey / 4.0) AS BIGINT) AS VARCHAR)) AS centroid_95, p_partkey AS line,
         CONCAT('kind ', CAST(p_size % 3 AS VARCHAR)) AS kind, p_name AS description
  FROM part),
a_species_profile AS (
  SELECT c_mktsegment AS species, CONCAT('N', CAST(c_nationkey AS VARCHAR)) AS sample, CAST(SUM(o_totalprice) AS DOUBLE) / CAST(1000000 AS DOUBLE) AS coverage
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
a_strain_frequency AS (
  SELECT CONCAT('sp', CAST(user_id % 3 AS VARCHAR)) AS species, CONCAT('H', CAST(user_id % 5 AS VARCHAR)) AS subject_id, event_type AS region, CAST(ts AS DATE) AS date,
         AVG(CAST(CASE WHEN value > 50 THEN 1 ELSE 0 END AS DOUBLE)) AS freq, COUNT(*) AS n
  FROM events GROUP BY 1, 2, 3, 4)
"""


def sql(query: str) -> str:
    """``query`` with the views it may name; it starts with its own common table expressions or with SELECT."""
    query = query.strip()
    return f"WITH {SQL_VIEWS.strip()}{', ' + query[5:] if query.startswith('WITH ') else chr(10) + query}"
