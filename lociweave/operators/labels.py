"""Labels of samples, sites and pairs, and the tables of comparisons built from them."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lociweave.functions import expr

#: Sites from the mouth on with their short codes, mice of the two treatments, device types with their place in the gut.
SITES = ("Duodenum", "Jejunum", "Ileum", "Cecum", "Colon")
CODES = {"Duodenum": "D", "Jejunum": "J", "Ileum": "I", "Cecum": "Ce", "Colon": "Co"}
CONTROL, TREATED = (1, 2, 3), (4, 5, 6)
DIET_CODES = {1: "CD", 2: "CD", 3: "CD", 4: "GG", 5: "GG", 6: "GG"}
DEVICES = {"Capsule 1": "Proximal", "Capsule 2": "Jejunum", "Capsule 3": "Ileum", "Capsule 4": "Ascending colon", "Stool": "Stool", "Saliva": "Saliva"}
SET_HOURS = {"1": 0, "2": 6, "3": 24, "4": 30}


def ordered(values: tuple, column: Column) -> Column:
    """The place of a value in an explicit order; others come last."""
    return F.coalesce(expr.lookup({v: k for k, v in enumerate(values)}, column), F.lit(len(values)))


def annotated(samples: DataFrame) -> DataFrame:
    """Samples with mouse, site, region, diet and cage from their names."""
    s = F.col("sample")
    return samples.withColumns({"mouse": expr.mouse_number(s), "site": expr.gut_site(s), "region": expr.gut_region(expr.gut_site(s)), "diet": expr.diet(s), "cage": expr.cage(s)})


def oriented(pairs: DataFrame, samples: DataFrame) -> DataFrame:
    """Pairs (sample_1, sample_2) with their orientation by host, region, diet, cage and inoculum."""
    a, b = (annotated(samples.select("sample")).select(F.col("sample").alias(f"sample_{k}"), *[F.col(c).alias(f"{c}_{k}") for c in ("mouse", "site", "region", "diet", "cage")]) for k in (1, 2))
    both = pairs.select("sample_1", "sample_2").join(a, "sample_1").join(b, "sample_2")
    inoculum = (F.col("mouse_1") == "Inoculum") | (F.col("mouse_2") == "Inoculum")
    told = lambda c, same, other: F.when(inoculum, F.lit("Inoculum")).when(F.col(f"{c}_1") == F.col(f"{c}_2"), F.lit(same)).otherwise(F.lit(other))
    made = {
        "host": told("mouse", "Within host", "Between hosts"), "site": told("site", "Same site", "Different site"), "region": told("region", "Same region", "Different region"),
        "diet": told("diet", "Same diet", "Different diet"), "cage": told("cage", "Same cage", "Different cage"),
    }
    return both.select("sample_1", "sample_2", *[v.alias(f"{k}_orientation") for k, v in made.items()])


def pair_label(host: Column, cage: Column, diet: Column, gut: Column) -> Column:
    """One label of a pair from its orientations; the first that tells it apart counts."""
    inoculum = host == "Inoculum"
    return (
        F.when(inoculum, F.lit("Inoculum"))
        .when((host == "Within host") & (gut == "Same region"), F.lit("Within host, same region"))
        .when(host == "Within host", F.lit("Within host, between regions"))
        .when(cage == "Same cage", F.lit("Between hosts, same cage"))
        .when(diet == "Same diet", F.lit("Between cages, same diet"))
        .otherwise(F.lit("Between diets"))
    )


def diet_pair(a: Column, b: Column, host: Column) -> Column:
    """The two diets of a pair between hosts in order, the one diet of a pair within a host."""
    return F.when(host == "Within host", a).when(a == b, F.concat(a, F.lit(" only"))).otherwise(F.concat(F.least(a, b), F.lit(" and "), F.greatest(a, b)))


def same_or_different(a: Column, b: Column, what: str) -> Column:
    return F.when(a == b, F.lit(f"Same {what}")).otherwise(F.lit(f"Different {what}"))


def strain_orientation(pairs: DataFrame, different: DataFrame) -> DataFrame:
    """Whether a pair, in either order, is listed as one of different strains."""
    key = lambda a, b: [F.least(a, b).alias("_lo"), F.greatest(a, b).alias("_hi")]
    listed = different.select("species", *key("sample_1", "sample_2")).distinct().withColumn("_in", F.lit(True))
    rows = pairs.select("*", *key("sample_1", "sample_2")).join(listed, ["species", "_lo", "_hi"], "left")
    return rows.withColumn("strain", F.when(F.col("_in"), F.lit("Different strain")).otherwise(F.lit("Same strain"))).drop("_lo", "_hi", "_in")


def with_distance(pairs: DataFrame, distances: DataFrame, value: str) -> DataFrame:
    """Pairs with ``value`` of the edge list, in whichever order it names them."""
    edges = distances.select(F.least("sample_1", "sample_2").alias("_a"), F.greatest("sample_1", "sample_2").alias("_b"), value).distinct()
    return pairs.join(edges, (F.least("sample_1", "sample_2") == F.col("_a")) & (F.greatest("sample_1", "sample_2") == F.col("_b")), "left").drop("_a", "_b")


def unordered_pairs(pairs: DataFrame) -> DataFrame:
    """Each species and pair once, names sorted."""
    return pairs.select("species", F.least("sample_1", "sample_2").alias("sample_1"), F.greatest("sample_1", "sample_2").alias("sample_2")).distinct()


# tables of comparisons --------------------------------------------------------


def _mice(samples: DataFrame) -> DataFrame:
    """(site, mouse, sample) of the samples of mice; the inoculum and other names are left out."""
    at = F.regexp_extract("sample", r"^M(\d)(Co|Ce|I|J|D)$", 1)
    code = F.regexp_extract("sample", r"^M(\d)(Co|Ce|I|J|D)$", 2)
    rows = samples.select("sample").distinct().withColumn("mouse", F.try_to_number(F.nullif(at, F.lit("")), F.lit("9")).cast("int")).filter("mouse is not null")
    return rows.select(expr.lookup(expr.SITES, code).alias("site"), "mouse", "sample")


def diet_codes(samples: DataFrame) -> DataFrame:
    """(mouse, diet) of the mice in a table of samples that had one of the two treatments."""
    diet = expr.lookup(DIET_CODES, F.col("mouse"))
    return _mice(samples).select("mouse").distinct().withColumn("diet", diet).filter("diet is not null")


def site_samples(samples: DataFrame) -> DataFrame:
    """(site, mouse, sample) of the six mice of the two treatments."""
    return _mice(samples).filter(F.col("mouse").isin(*CONTROL, *TREATED))


def same_site_pairs(samples: DataFrame) -> DataFrame:
    """(site, sample_1, sample_2) of every two mice."""
    a, b = (site_samples(samples).select("site", F.col("mouse").alias(f"mouse_{k}"), F.col("sample").alias(f"sample_{k}")) for k in (1, 2))
    return a.join(b, "site").filter("mouse_1 < mouse_2").select("site", "sample_1", "sample_2")


def site_pairs(sites: DataFrame, place: Column) -> DataFrame:
    """(short, label): every two of the table's sites in the order of their place, as codes where there are any and in full; some dozen sites."""
    code = F.coalesce(expr.lookup(CODES, F.col("site")), F.col("site"))
    s = sites.select("site", code.alias("code"), place.alias("place")).distinct()
    a, b = (s.select(*[F.col(c).alias(f"{c}_{k}") for c in s.columns]) for k in (1, 2))
    return a.join(b, F.col("place_1") < F.col("place_2")).select(F.concat_ws("-", "code_1", "code_2").alias("short"), F.concat_ws(" v. ", "site_1", "site_2").alias("label"))


def comparisons(samples: DataFrame) -> DataFrame:
    """(first, second): a site across the treatments, and two sites within one, of those that the samples come from."""
    s = site_samples(samples).select("site", F.when(F.col("mouse").isin(*CONTROL), "control").otherwise("treated").alias("t"), ordered(SITES, F.col("site")).alias("place")).distinct()
    a, b = (s.select(*[F.col(c).alias(f"{c}_{k}") for c in s.columns]) for k in (1, 2))
    across = (F.col("site_1") == F.col("site_2")) & (F.col("t_1") == "control") & (F.col("t_2") == "treated")
    within = (F.col("t_1") == F.col("t_2")) & (F.col("place_1") < F.col("place_2"))
    return a.join(b, across | within).select(F.concat_ws(" ", "site_1", "t_1").alias("first"), F.concat_ws(" ", "site_2", "t_2").alias("second"))


def other_host_other_site(samples: DataFrame) -> DataFrame:
    """Ordered pairs of samples of different mice at different sites."""
    s = annotated(samples.select("sample")).select("sample", "mouse", "site")
    a, b = (s.select(*[F.col(c).alias(f"{c}_{k}") for c in s.columns]) for k in (1, 2))
    return a.join(b, (F.col("mouse_1") != F.col("mouse_2")) & (F.col("site_1") != F.col("site_2"))).select("sample_1", "sample_2", "site_1", "site_2")


def control_against_treated(samples: DataFrame, once: bool = False) -> DataFrame:
    """(site, region, sample_1, sample_2): control and treated mice at one site; with ``once`` a mouse is in one pair of a site."""
    s = site_samples(samples)
    rank = F.row_number().over(Window.partitionBy("site").orderBy("mouse"))
    side = lambda mice, k: s.filter(F.col("mouse").isin(*mice)).withColumn("_r", rank).select("site", F.col("sample").alias(f"sample_{k}"), F.col("_r").alias(f"_r{k}"))
    both = side(CONTROL, 1).join(side(TREATED, 2), "site")
    both = both.filter("_r1 = _r2") if once else both
    return both.select("site", expr.gut_region(F.col("site")).alias("region"), "sample_1", "sample_2")


# other text and time labels ---------------------------------------------------


def gene_descriptions(genes: DataFrame, descriptions: DataFrame, centroids: DataFrame) -> DataFrame:
    """Genes with their description, else that of their centroid, else the empty string."""
    own = descriptions.select(F.col("gene_id").alias("_g"), F.col("description").alias("_own"))
    of = centroids.select("gene_id", F.col("centroid").alias("_c")).dropDuplicates(["gene_id"])
    other = descriptions.select(F.col("gene_id").alias("_h"), F.col("description").alias("_other"))
    rows = genes.join(own, F.col("gene_id") == F.col("_g"), "left").join(of, "gene_id", "left").join(other, F.col("_c") == F.col("_h"), "left")
    return rows.select(*genes.columns, F.coalesce("_own", "_other", F.lit("")).alias("description"))


def from_filename(path: Column) -> dict[str, Column]:
    """Species and sample of a result file ``..._Genus_species_number_..._sample_NAME_...``."""
    name = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\..*$", "")
    return {"species": F.concat_ws("_", F.slice(F.split(name, "_"), 2, 3)), "sample": F.regexp_extract(name, r"_sample_([^_]+)", 1)}


def clean_label(species: Column) -> Column:
    """Two words of a species name, three where the second is a placeholder."""
    words = F.split(F.regexp_replace(species, "_", " "), " ")
    return F.concat_ws(" ", F.when(F.get(words, F.lit(1)).rlike(r"^(sp|cf)\.?$"), F.slice(words, 1, 3)).otherwise(F.slice(words, 1, 2)))


def dashed(name: Column) -> Column:
    return F.translate(name, ".", "-")


def taxon(lineage: Column) -> Column:
    """The species of a ``d__...;g__...;s__...`` string, or its genus where the epithet is a placeholder."""
    part = lambda r: F.regexp_extract(lineage, rf"{r}__([^;]*)", 1)
    epithet = F.element_at(F.split(part("s"), " "), -1)
    return F.when((part("s") == "") | epithet.rlike(r"^sp\d+$"), F.concat(part("g"), F.lit(" sp."))).otherwise(part("s"))


def time_parts(at: Column) -> dict[str, Column]:
    return {"year": F.year(at), "month": F.month(at), "day": F.dayofmonth(at), "hour": F.hour(at), "minute": F.minute(at)}


def sampled_at(kind: Column, collected: Column, swallowed: Column) -> Column:
    """When a sample was in the gut: devices from swallowing on, others when collected."""
    return F.when(kind.startswith("Capsule"), swallowed).otherwise(collected)


def set_hours(number: Column) -> Column:
    got = expr.lookup(SET_HOURS, number)
    return F.when(got.isNull() & number.isNotNull(), F.raise_error(F.concat(F.lit("unknown set "), number)).cast("int")).otherwise(got)


def gut_location(kind: Column) -> Column:
    return expr.lookup(DEVICES, kind)


def timepoint_orientation(t1: Column, t2: Column, device1: Column, device2: Column) -> Column:
    return F.concat(F.when(t1 == t2, F.lit("Within timepoint")).otherwise(F.lit("Between timepoints")), F.lit(", "), F.when(device1 == device2, F.lit("same device")).otherwise(F.lit("different device")))


def change_totals(pairs: DataFrame, changes: DataFrame) -> DataFrame:
    """Pairs with the number of their rows in ``changes``, 0 where there are none."""
    n = changes.groupBy("species", "sample_1", "sample_2").agg(F.count(F.lit(1)).alias("n_changes"))
    return pairs.join(n, ["species", "sample_1", "sample_2"], "left").withColumn("n_changes", F.coalesce("n_changes", F.lit(0)))


def recoded(values: dict, column: Column) -> Column:
    """``column`` with the given labels in place of codes; others stay."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for x in chain(*values.items())]), column), column)
