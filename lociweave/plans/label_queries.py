"""Labels and tables of comparisons as queries over the benchmark tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lociweave.functions import expr
from lociweave.operators import changes, ecology, labels, pairs
from lociweave.plans.queries import _FLIPS, _query, rounded
from lociweave.sources import adapters as A

_MICE = """x AS (SELECT sample, value, CASE WHEN sample = 'TL1gDNAshort' THEN 'Inoculum' ELSE SUBSTR(sample, 2, 1) END AS mouse, SUBSTR(sample, 3) AS code FROM a_mouse_samples),
ms AS (SELECT sample, value, mouse, CASE WHEN mouse = 'Inoculum' THEN 'Inoculum' WHEN code = 'Co' THEN 'Colon' WHEN code = 'Ce' THEN 'Cecum' WHEN code = 'I' THEN 'Ileum' WHEN code = 'J' THEN 'Jejunum' ELSE 'Duodenum' END AS site,
  CASE WHEN mouse = 'Inoculum' THEN 'Inoculum' WHEN code IN ('Co', 'Ce') THEN 'Lower gut' ELSE 'Upper gut' END AS region,
  CASE WHEN mouse = 'Inoculum' THEN 'Human diet' WHEN mouse IN ('1', '2', '3') THEN 'Control diet' ELSE 'Guar gum diet' END AS diet,
  CASE WHEN mouse = 'Inoculum' THEN 'Inoculum' WHEN mouse IN ('1', '2', '3') THEN 'Cage 1' WHEN mouse IN ('4', '5') THEN 'Cage 2' ELSE 'Cage 3' END AS cage FROM x)"""


@_query(f"WITH {_MICE} SELECT sample, mouse, site, region, diet, cage FROM ms")
def mouse_sample_labels(spark, d):
    return labels.annotated(A.mouse_samples(spark, d).select("sample"))


def _told(c: str, same: str, other: str) -> str:
    return f"CASE WHEN a.mouse = 'Inoculum' OR b.mouse = 'Inoculum' THEN 'Inoculum' WHEN a.{c} = b.{c} THEN '{same}' ELSE '{other}' END AS {'host' if c == 'mouse' else c}_orientation"


_ORIENTED = f"""{_MICE}, od AS (SELECT a.sample AS sample_1, b.sample AS sample_2, {_told('mouse', 'Within host', 'Between hosts')}, {_told('site', 'Same site', 'Different site')}, {_told('region', 'Same region', 'Different region')},
  {_told('diet', 'Same diet', 'Different diet')}, {_told('cage', 'Same cage', 'Different cage')} FROM ms a JOIN ms b ON a.sample < b.sample)"""


def _oriented(spark, d):
    s = A.mouse_samples(spark, d).select("sample")
    return labels.oriented(pairs.unordered(s.withColumn("subject_id", F.lit(""))), s)


@_query(f"WITH {_ORIENTED} SELECT * FROM od")
def mouse_pair_orientations(spark, d):
    return _oriented(spark, d)


@_query(
    f"""WITH {_ORIENTED} SELECT sample_1, sample_2, CASE WHEN host_orientation = 'Inoculum' THEN 'Inoculum' WHEN host_orientation = 'Within host' AND region_orientation = 'Same region' THEN 'Within host, same region'
        WHEN host_orientation = 'Within host' THEN 'Within host, between regions' WHEN cage_orientation = 'Same cage' THEN 'Between hosts, same cage' WHEN diet_orientation = 'Same diet' THEN 'Between cages, same diet' ELSE 'Between diets' END AS label FROM od"""
)
def mouse_pair_labels(spark, d):
    label = labels.pair_label(*[F.col(f"{c}_orientation") for c in ("host", "cage", "diet", "region")])
    return _oriented(spark, d).select("sample_1", "sample_2", label.alias("label"))


@_query(
    f"""WITH {_MICE} SELECT a.sample AS sample_1, b.sample AS sample_2, CASE WHEN a.mouse = b.mouse THEN a.diet WHEN a.diet = b.diet THEN a.diet || ' only' ELSE LEAST(a.diet, b.diet) || ' and ' || GREATEST(a.diet, b.diet) END AS diets,
        CASE WHEN a.diet = b.diet THEN 'Same diet' ELSE 'Different diet' END AS diet, CASE WHEN a.site = b.site THEN 'Same tissue' ELSE 'Different tissue' END AS tissue FROM ms a JOIN ms b ON a.sample < b.sample"""
)
def mouse_pair_diets(spark, d):
    s = labels.annotated(A.mouse_samples(spark, d).select("sample"))
    a, b = (s.select(*[F.col(c).alias(f"{c}_{k}") for c in ("sample", "mouse", "site", "diet")]) for k in (1, 2))
    host = F.when(F.col("mouse_1") == F.col("mouse_2"), "Within host").otherwise("Between hosts")
    two = F.col("diet_1"), F.col("diet_2")
    return a.join(b, F.col("sample_1") < F.col("sample_2")).select("sample_1", "sample_2", labels.diet_pair(*two, host).alias("diets"), labels.same_or_different(*two, "diet").alias("diet"), labels.same_or_different(F.col("site_1"), F.col("site_2"), "tissue").alias("tissue"))


@_query(f"WITH {_FLIPS}, df AS (SELECT DISTINCT species, sample_1, sample_2 FROM fl WHERE kind = 'mutation'), p AS (SELECT DISTINCT species, sample_2 AS sample_1, sample_1 AS sample_2 FROM fl) SELECT p.*, CASE WHEN df.species IS NULL THEN 'Same strain' ELSE 'Different strain' END AS strain FROM p LEFT JOIN df ON p.species = df.species AND p.sample_1 = df.sample_2 AND p.sample_2 = df.sample_1")
def strain_orientation(spark, d):
    f = changes.flips(A.site_counts(spark, d))
    return labels.strain_orientation(f.select("species", F.col("sample_2").alias("sample_1"), F.col("sample_1").alias("sample_2")).distinct(), f.filter("kind = 'mutation'"))


@_query(
    """WITH t AS (SELECT sample, SUM(coverage) AS t FROM a_species_profile GROUP BY 1), l AS (SELECT x.sample AS s1, y.sample AS s2, SUM(LEAST(x.coverage, y.coverage)) AS l FROM a_species_profile x JOIN a_species_profile y ON x.species = y.species AND x.sample < y.sample WHERE x.coverage > 0 AND y.coverage > 0 GROUP BY 1, 2)
       SELECT b.sample AS sample_1, a.sample AS sample_2, ROUND(1 - 2 * COALESCE(l, 0) / (a.t + b.t), 5) AS bray_curtis FROM t a JOIN t b ON a.sample < b.sample LEFT JOIN l ON s1 = a.sample AND s2 = b.sample"""
)
def pairs_with_distance(spark, d):
    bc = ecology.bray_curtis(A.species_profile(spark, d))
    return rounded(labels.with_distance(bc.select(F.col("sample_2").alias("sample_1"), F.col("sample_1").alias("sample_2")), bc, "bray_curtis"), 5)


@_query(f"WITH {_FLIPS} SELECT DISTINCT species, LEAST(sample_1, sample_2) AS sample_1, GREATEST(sample_1, sample_2) AS sample_2 FROM fl")
def unordered_changed_pairs(spark, d):
    f = changes.flips(A.site_counts(spark, d)).select("species", "sample_1", "sample_2")
    return labels.unordered_pairs(f.unionByName(f.select("species", F.col("sample_2").alias("sample_1"), F.col("sample_1").alias("sample_2"))))


_SITES = """st AS (SELECT * FROM (VALUES (0, 'Duodenum', 'D'), (1, 'Jejunum', 'J'), (2, 'Ileum', 'I'), (3, 'Cecum', 'Ce'), (4, 'Colon', 'Co')) t(k, site, code)),
sm AS (SELECT st.k, st.site, CAST(SUBSTR(sample, 2, 1) AS INTEGER) AS mouse, sample FROM a_mouse_samples JOIN st ON code = SUBSTR(sample, 3) WHERE SUBSTR(sample, 2, 1) BETWEEN '1' AND '6')"""


@_query(f"WITH {_SITES} SELECT DISTINCT mouse, CASE WHEN mouse <= 3 THEN 'CD' ELSE 'GG' END AS diet FROM sm")
def diet_codes(spark, d):
    return labels.diet_codes(A.mouse_samples(spark, d))


@_query(f"WITH {_SITES} SELECT site, mouse, sample FROM sm")
def site_samples(spark, d):
    return labels.site_samples(A.mouse_samples(spark, d))


@_query(f"WITH {_SITES} SELECT a.site, a.sample AS sample_1, b.sample AS sample_2 FROM sm a JOIN sm b ON a.site = b.site AND a.mouse < b.mouse")
def same_site_pairs(spark, d):
    return labels.same_site_pairs(A.mouse_samples(spark, d))


@_query(f"WITH {_SITES}, u AS (SELECT DISTINCT st.* FROM st JOIN sm ON sm.site = st.site) SELECT a.code || '-' || b.code AS short, a.site || ' v. ' || b.site AS label FROM u a JOIN u b ON a.k < b.k")
def site_pair_labels(spark, d):
    return labels.site_pairs(labels.site_samples(A.mouse_samples(spark, d)), labels.ordered(labels.SITES, F.col("site")))


@_query("WITH r AS (SELECT r_regionkey AS k, r_name AS n FROM region) SELECT a.n || '-' || b.n AS short, a.n || ' v. ' || b.n AS label FROM r a JOIN r b ON a.k < b.k")
def given_site_pairs(spark, d):
    return labels.site_pairs(spark.read.parquet(f"{d}/region.parquet").select(F.col("r_name").alias("site"), "r_regionkey"), F.col("r_regionkey"))


@_query(
    f"""WITH {_SITES}, u AS (SELECT DISTINCT k, site, CASE WHEN mouse <= 3 THEN 'control' ELSE 'treated' END AS t FROM sm)
        SELECT a.site || ' ' || a.t AS first, b.site || ' ' || b.t AS second FROM u a JOIN u b ON (a.k = b.k AND a.t = 'control' AND b.t = 'treated') OR (a.k < b.k AND a.t = b.t)"""
)
def site_treatment_comparisons(spark, d):
    return labels.comparisons(A.mouse_samples(spark, d))


@_query(f"WITH {_MICE} SELECT a.sample AS sample_1, b.sample AS sample_2, a.site AS site_1, b.site AS site_2 FROM ms a JOIN ms b ON a.mouse <> b.mouse AND a.site <> b.site")
def other_host_other_site(spark, d):
    return labels.other_host_other_site(A.mouse_samples(spark, d))


_TREATED = f"{_SITES}, rk AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY site, mouse > 3 ORDER BY mouse) AS r, mouse > 3 AS treated FROM sm), ct AS (SELECT a.site, CASE WHEN a.site IN ('Duodenum', 'Jejunum', 'Ileum') THEN 'Upper gut' ELSE 'Lower gut' END AS region, a.sample AS sample_1, b.sample AS sample_2, a.r AS r1, b.r AS r2 FROM rk a JOIN rk b ON a.site = b.site AND NOT a.treated AND b.treated)"


@_query(f"WITH {_TREATED} SELECT site, region, sample_1, sample_2 FROM ct")
def control_against_treated(spark, d):
    return labels.control_against_treated(A.mouse_samples(spark, d))


@_query(f"WITH {_TREATED} SELECT site, region, sample_1, sample_2 FROM ct WHERE r1 = r2")
def control_against_treated_once(spark, d):
    return labels.control_against_treated(A.mouse_samples(spark, d), once=True)


@_query("SELECT sample, CAST(COALESCE(LIST_POSITION(['Duodenum', 'Jejunum', 'Ileum', 'Cecum', 'Colon'], c_name) - 1, 5) AS INTEGER) AS place FROM (SELECT c_custkey AS sample, CASE c_custkey % 4 WHEN 0 THEN 'Colon' WHEN 1 THEN 'Ileum' WHEN 2 THEN 'Duodenum' ELSE 'Stool' END AS c_name FROM customer)")
def ordered_sites(spark, d):
    k = F.col("c_custkey")
    site = F.when(k % 4 == 0, "Colon").when(k % 4 == 1, "Ileum").when(k % 4 == 2, "Duodenum").otherwise("Stool")
    return spark.read.parquet(f"{d}/customer.parquet").select(k.alias("sample"), labels.ordered(labels.SITES, site).alias("place"))


@_query("WITH g AS (SELECT gene_id, centroid_95 AS centroid, line, description FROM a_pangenome), ds AS (SELECT gene_id, description FROM g WHERE line % 3 = 0 UNION ALL SELECT DISTINCT centroid, 'of ' || centroid FROM g WHERE line % 16 < 4) SELECT g.gene_id, COALESCE(a.description, b.description, '') AS description FROM g LEFT JOIN ds a ON a.gene_id = g.gene_id LEFT JOIN ds b ON b.gene_id = g.centroid")
def gene_descriptions(spark, d):
    g = A.pangenome(spark, d)
    own = g.filter("line % 3 = 0").select("gene_id", "description")
    more = g.filter("line % 16 < 4").select(F.col("centroid_95").alias("gene_id"), F.concat(F.lit("of "), "centroid_95").alias("description")).distinct()
    return labels.gene_descriptions(g.select("gene_id"), own.unionByName(more), g.select("gene_id", F.col("centroid_95").alias("centroid")))


@_query("SELECT c_custkey AS id, c_mktsegment || '_x_' || CAST(c_custkey AS VARCHAR) AS species, CAST(c_nationkey AS VARCHAR) AS sample FROM customer")
def names_from_files(spark, d):
    path = F.concat(F.lit("/out/pi_"), "c_mktsegment", F.lit("_x_"), F.col("c_custkey").cast("string"), F.lit("_sample_"), F.col("c_nationkey").cast("string"), F.lit("_regular.csv.bz2"))
    return spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("id"), *[v.alias(n) for n, v in labels.from_filename(path).items()])


@_query("SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment || ' sp. ' || CAST(c_custkey AS VARCHAR) ELSE c_mktsegment || ' epithet' END AS label, REPLACE(c_mktsegment || '.' || CAST(c_custkey AS VARCHAR), '.', '-') AS dashed FROM customer")
def cleaned_labels(spark, d):
    k = F.col("c_custkey")
    name = F.concat("c_mktsegment", F.when(k % 2 == 0, "_sp._").otherwise("_epithet_"), k.cast("string"))
    return spark.read.parquet(f"{d}/customer.parquet").select(k.alias("id"), labels.clean_label(name).alias("label"), labels.dashed(F.concat("c_mktsegment", F.lit("."), k.cast("string"))).alias("dashed"))


@_query("SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment || ' sp.' WHEN c_custkey % 3 = 1 THEN c_mktsegment || ' sp.' ELSE c_mktsegment || ' coli' END AS taxon FROM customer")
def taxa_of_lineages(spark, d):
    k = F.col("c_custkey")
    s = F.when(k % 3 == 0, F.lit("")).when(k % 3 == 1, F.concat("c_mktsegment", F.lit(" sp12"))).otherwise(F.concat("c_mktsegment", F.lit(" coli")))
    lineage = F.concat(F.lit("d__Bacteria;f__Family;g__"), "c_mktsegment", F.lit(";s__"), s)
    return spark.read.parquet(f"{d}/customer.parquet").select(k.alias("id"), labels.taxon(lineage).alias("taxon"))


@_query("SELECT event_id, CAST(YEAR(ts) AS INTEGER) AS year, CAST(MONTH(ts) AS INTEGER) AS month, CAST(DAY(ts) AS INTEGER) AS day, CAST(HOUR(ts) AS INTEGER) AS hour, CAST(MINUTE(ts) AS INTEGER) AS minute FROM events")
def event_time_parts(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    return e.select("event_id", *[v.alias(n) for n, v in labels.time_parts(F.col("ts")).items()])


@_query(
    """WITH e AS (SELECT event_id, user_id, ts, CAST(1 + event_id % 4 AS VARCHAR) AS number, CASE WHEN event_id % 3 = 0 THEN 'Stool' ELSE 'Capsule ' || CAST(1 + event_id % 4 AS VARCHAR) END AS kind FROM events)
       SELECT event_id, CASE number WHEN '1' THEN 0 WHEN '2' THEN 6 WHEN '3' THEN 24 ELSE 30 END AS hours, CASE kind WHEN 'Stool' THEN 'Stool' WHEN 'Capsule 1' THEN 'Proximal' WHEN 'Capsule 2' THEN 'Jejunum' WHEN 'Capsule 3' THEN 'Ileum' ELSE 'Ascending colon' END AS location,
         STRFTIME(CASE WHEN kind = 'Stool' THEN ts ELSE ts - INTERVAL 1 DAY END, '%Y-%m-%d') AS date,
         CASE WHEN event_id % 2 = user_id % 2 THEN 'Within timepoint' ELSE 'Between timepoints' END || ', ' || CASE WHEN event_id % 4 = user_id % 4 THEN 'same device' ELSE 'different device' END AS orientation FROM e"""
)
def device_labels(spark, d):
    k, u = F.col("event_id"), F.col("user_id")
    number = (1 + k % 4).cast("string")
    kind = F.when(k % 3 == 0, "Stool").otherwise(F.concat(F.lit("Capsule "), number))
    text = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    at = labels.sampled_at(kind, expr.instant(text), expr.instant(text) - F.expr("INTERVAL 1 DAY"))
    return spark.read.parquet(f"{d}/events.parquet").select(
        "event_id", labels.set_hours(number).alias("hours"), labels.gut_location(kind).alias("location"), F.date_format(at, "yyyy-MM-dd").alias("date"), labels.timepoint_orientation(k % 2, u % 2, k % 4, u % 4).alias("orientation")
    )


@_query(f"WITH {_FLIPS}, p AS (SELECT species, a.sample AS sample_1, b.sample AS sample_2 FROM (SELECT DISTINCT species FROM a_site_counts), a_samples a JOIN a_samples b ON a.sample < b.sample), n AS (SELECT species, sample_1, sample_2, COUNT(*) AS n FROM fl GROUP BY 1, 2, 3) SELECT p.*, COALESCE(n, 0) AS n_changes FROM p LEFT JOIN n USING (species, sample_1, sample_2)")
def change_totals(spark, d):
    c = A.site_counts(spark, d)
    each = pairs.unordered(A.samples(spark, d)).select("sample_1", "sample_2").join(F.broadcast(c.agg(F.collect_set("species").alias("s"))), F.lit(True)).select(F.explode("s").alias("species"), "sample_1", "sample_2")
    return labels.change_totals(each, changes.flips(c))


@_query("SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 'Finished' WHEN 'O' THEN 'Open' ELSE o_orderstatus END AS label FROM orders")
def recoded_labels(spark, d):
    return spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("id"), labels.recoded({"F": "Finished", "O": "Open"}, F.col("o_orderstatus")).alias("label"))
