"""Sample metadata: subjects, visits, cohorts, and filters by them. All small dimensions, joined by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def accessions(metadata: DataFrame) -> DataFrame:
    """(subject_id, sample, accessions): the runs of each sample of a subject, sorted."""
    return metadata.groupBy("subject_id", "sample").agg(F.array_join(F.array_sort(F.collect_set("accession")), ",").alias("accessions"))


def subject_of(metadata: DataFrame) -> DataFrame:
    """The nested map turned round: (sample, subject_id)."""
    return metadata.select("sample", "subject_id").distinct()


def samples_of_subjects(metadata: DataFrame) -> DataFrame:
    """(subject_id, samples, accessions) over all samples of a subject."""
    return metadata.groupBy("subject_id").agg(*[F.array_join(F.array_sort(F.collect_set(c)), ",").alias(n) for c, n in (("sample", "samples"), ("accession", "accessions"))])


def visits(metadata: DataFrame) -> DataFrame:
    """(subject_id, visit, sample, day): each once; the day is unknown and counts as 0."""
    return metadata.select("subject_id", "visit", "sample").distinct().withColumn("day", F.lit(0))


def collapsed_visits(visits_: DataFrame) -> DataFrame:
    """One row a visit: its first sample, marked with a c where there are replicates."""
    got = visits_.groupBy("subject_id", "visit").agg(F.min("sample").alias("first"), F.count(F.lit(1)).alias("n"), F.min("day").alias("day"))
    return got.select("subject_id", "visit", F.when(F.col("n") > 1, F.concat("first", F.lit("c"))).otherwise(F.col("first")).alias("sample"), "day", "n")


def best_covered(visits_: DataFrame, coverage: DataFrame) -> DataFrame:
    """The sample with the highest coverage above 0 of each visit, of equals the first by name."""
    rows = visits_.join(coverage.select("sample", "coverage"), "sample").filter("coverage > 0")
    w = Window.partitionBy("subject_id", "visit").orderBy(F.desc("coverage"), "sample")
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").select("subject_id", "visit", "sample", "coverage")


def first_visit_pairs(visits_: DataFrame) -> DataFrame:
    """Visit 1 with every other visit of a subject."""
    return _visit_pairs(visits_, (F.col("visit_1") == 1) & (F.col("visit_2") != 1))


def all_visit_pairs(visits_: DataFrame) -> DataFrame:
    """Every two visits of a subject in order, with the days between."""
    return _visit_pairs(visits_, F.col("visit_1") < F.col("visit_2"))


def early_visit_pairs(visits_: DataFrame) -> DataFrame:
    """Visit 1 with visits 2 and 3; a subject with both has both pairs."""
    return _visit_pairs(visits_, (F.col("visit_1") == 1) & F.col("visit_2").isin(2, 3))


def _visit_pairs(visits_: DataFrame, on: Column) -> DataFrame:
    a, b = (visits_.select("subject_id", F.col("visit").alias(f"visit_{k}"), F.col("sample").alias(f"sample_{k}"), F.col("day").alias(f"day_{k}")) for k in (1, 2))
    return a.join(b, "subject_id").filter(on).select("subject_id", "sample_1", "sample_2", "visit_1", "visit_2", (F.col("day_2") - F.col("day_1")).alias("days"))


def by_field(metadata: DataFrame, field: str, value: str, compat: bool = False) -> DataFrame:
    """The rows whose ``field`` is ``value``; with ``compat`` all rows, as the filter once had no effect."""
    return metadata if compat else metadata.filter(F.col(field) == value)


def attribute(metadata: DataFrame, name: str) -> DataFrame:
    """(sample, ``name``) of each sample once."""
    return metadata.groupBy("sample").agg(F.min(name).alias(name))


def in_countries(samples: DataFrame, countries: DataFrame, allowed: list[str]) -> DataFrame:
    """Each sample and whether its country is allowed; the c of merged replicates does not count. No allowed countries: all are."""
    known = countries.select(F.col("sample").alias("_s"), "country")
    rows = samples.select("sample").join(known, F.regexp_replace(F.trim("sample"), "c$", "") == F.col("_s"), "left")
    return rows.select("sample", (F.coalesce(F.col("country").isin(*allowed), F.lit(False)) if allowed else F.lit(True)).alias("allowed"))


def other_subjects(metadata: DataFrame, focal: str) -> DataFrame:
    """Samples whose subject is not that of the sample ``focal``."""
    one = metadata.filter(F.col("sample") == focal).select(F.col("subject_id").alias("_focal")).distinct()
    return subject_of(metadata).join(F.broadcast(one.limit(1)), F.col("subject_id") == F.col("_focal"), "left_anti")


def incidence(metadata: DataFrame) -> DataFrame:
    """The sample by subject matrix in long form: every sample with every subject of the cohort, and whether it is its own."""
    own = subject_of(metadata)
    subjects = own.agg(F.array_sort(F.collect_set("subject_id")).alias("all"))
    return own.join(F.broadcast(subjects), F.lit(True)).select("sample", F.explode("all").alias("subject"), "subject_id").select("sample", "subject", (F.col("subject") == F.col("subject_id")).alias("own"))


def index_map(a: DataFrame, b: DataFrame) -> DataFrame:
    """(sample, from_index, to_index) of two ordered lists (sample, place)."""
    return a.select("sample", F.col("place").alias("from_index")).join(b.select("sample", F.col("place").alias("to_index")), "sample")


def remapped(indices: DataFrame, mapping: DataFrame) -> DataFrame:
    """``indices`` (from_index) as places of the other list."""
    return indices.join(mapping.select("from_index", "to_index"), "from_index")


def by_prefix(samples: DataFrame, prefixes: DataFrame) -> DataFrame:
    """For each prefix the first sample of the list (sample, place) that starts with it."""
    hits = prefixes.select("prefix").join(samples, F.col("sample").startswith(F.col("prefix")))
    return hits.groupBy("prefix").agg(F.min_by("sample", "place").alias("sample"))


def grouping_places(groups: DataFrame, samples: DataFrame) -> DataFrame:
    """(grouping, places): the list places of each grouping's samples."""
    return groups.select("grouping", "sample").join(samples.select("sample", "place"), "sample").groupBy("grouping").agg(F.array_join(F.transform(F.array_sort(F.collect_list("place")), lambda x: x.cast("string")), ",").alias("places"))


def with_runs(metadata: DataFrame, runs: DataFrame) -> DataFrame:
    """All metadata with their runs; samples without one keep a null."""
    return metadata.join(runs, "sample", "left")


def of_kinds(isolates: DataFrame, mixtures: DataFrame) -> DataFrame:
    """Isolates and mixtures as one table, told apart by ``kind``; an own subject each."""
    return isolates.select("sample", F.lit("isolate").alias("kind")).unionByName(mixtures.select("sample", F.lit("mixture").alias("kind"))).withColumn("subject_id", F.col("sample"))


def merged_cohorts(tables: DataFrame) -> DataFrame:
    """Of the rows (sample, priority, ...) of one sample that with the highest priority."""
    return tables.withColumn("_n", F.row_number().over(Window.partitionBy("sample").orderBy(F.desc("priority")))).filter("_n = 1").drop("_n")


def temporal_samples(covered: DataFrame, pairs: DataFrame) -> DataFrame:
    """The covered samples that stand in a pair (or triplet) whose samples are all covered."""
    names = [c for c in pairs.columns if c.startswith("sample_")]
    good = pairs.withColumn("_k", F.monotonically_increasing_id()).select("_k", F.explode(F.array(*names)).alias("sample"))
    known = covered.select("species", "sample").distinct()
    both = good.join(known, "sample")
    full = both.groupBy("species", "_k").count().filter(F.col("count") == len(names)).select("species", "_k")
    return both.join(full, ["species", "_k"]).select("species", "sample").distinct()


def species_union(profiles: DataFrame, samples: DataFrame, least: float = 3.0) -> DataFrame:
    """Species with a coverage of ``least`` or more in any sample of a host."""
    return profiles.filter(F.col("coverage") >= least).join(samples.select("sample", "subject_id"), "sample").select("subject_id", "species").distinct()


def covered_species(profiles: DataFrame, least: float = 3.0) -> DataFrame:
    """The species of each sample with a coverage of ``least`` or more."""
    return profiles.filter(F.col("coverage") >= least).select("sample", "species", "coverage")


def taxonomy(species: DataFrame, genomes: DataFrame, ranks: DataFrame) -> DataFrame:
    """Species with their ranks, through the representative genome."""
    return species.join(genomes.select("species", "genome"), "species").join(ranks, "genome").drop("genome")


def unique_codes(species: DataFrame) -> DataFrame:
    """(code, name) with a name each: names that several codes share carry the code."""
    n = F.count(F.lit(1)).over(Window.partitionBy("name"))
    return species.select("code", F.when(n > 1, F.concat_ws("_", "name", "code")).otherwise(F.col("name")).alias("name"))


def phylogenetic_order(species: DataFrame, ranks: list[str], focal: str | None = None) -> DataFrame:
    """(species, place): each rank by the first place it is seen at, then by name; ``focal`` comes first."""
    keys, out = [], species
    for k, r in enumerate(ranks):
        out = out.withColumn(f"_f{k}", F.min("seen").over(Window.partitionBy(*ranks[: k + 1])))
        keys.append(f"_f{k}")
    first = F.when(F.col("species") == focal, 0).otherwise(1) if focal is not None else F.lit(0)
    return out.select("species", F.row_number().over(Window.orderBy(first, *keys, "species")).alias("place"))


def union_tables(tables: list[DataFrame]) -> DataFrame:
    """All tables, told apart by ``part``; columns that one lacks are null."""
    out = tables[0].withColumn("part", F.lit(0))
    for k, t in enumerate(tables[1:], 1):
        out = out.unionByName(t.withColumn("part", F.lit(k)), allowMissingColumns=True)
    return out


def disjoint_pairs(candidates: DataFrame, by: str) -> DataFrame:
    """Pairs (mouse_1, mouse_2) of each ``by``, taken in order, each mouse once; a group is the square of a cohort at most."""
    import pandas as pd

    def greedy(t: pd.DataFrame) -> pd.DataFrame:
        used, rows = set(), []
        for r in t.sort_values(["mouse_1", "mouse_2"]).itertuples(index=False):
            if r.mouse_1 not in used and r.mouse_2 not in used:
                used |= {r.mouse_1, r.mouse_2}
                rows.append((getattr(r, by), r.mouse_1, r.mouse_2))
        return pd.DataFrame(rows, columns=[by, "mouse_1", "mouse_2"])

    return candidates.select(by, "mouse_1", "mouse_2").groupBy(by).applyInPandas(greedy, f"{by} string, mouse_1 string, mouse_2 string")


def mapping_rates(runs: DataFrame) -> DataFrame:
    """(sample, pairs mapped, species, rate): mapped reads count twice."""
    return runs.groupBy("sample").agg((F.sum("mapped_reads") / 2).alias("mapped_pairs"), F.countDistinct("species").alias("n_species"), F.try_divide(F.sum("mapped_reads") / 2, F.max("total_pairs")).alias("rate"))


def of_mice(samples: DataFrame, mice: list[int]) -> DataFrame:
    """Samples whose names have one of the mice; a number stands whole, so mouse 1 is not mouse 10."""
    return samples.filter(F.col("sample").rlike("M(" + "|".join(map(str, mice)) + r")(?!\d)"))


def species_above(profile: DataFrame, least: float = 3.0) -> DataFrame:
    """(sample, species) with a coverage of ``least`` or more."""
    return profile.filter(F.col("coverage") >= least).select("sample", "species")


def ploidy_counts(calls: DataFrame, least: int = 2) -> DataFrame:
    """(species, ploidy, n): samples with one dominant lineage (QP) and others, of species with ``least`` samples or more."""
    kind = F.when(F.col("haploid"), "QP").otherwise("Not QP")
    got = calls.groupBy(F.regexp_replace("species", "_", " ").alias("species"), kind.alias("ploidy")).agg(F.count(F.lit(1)).alias("n"))
    return got.withColumn("_all", F.sum("n").over(Window.partitionBy("species"))).filter(F.col("_all") >= least).drop("_all")


def clade_members(samples: DataFrame, sets: DataFrame) -> DataFrame:
    """(clade, sample, inside) of every sample for each clade of ``sets`` (clade, sample); a cohort by its clades."""
    clades = sets.select("clade").distinct()
    marked = sets.select("clade", "sample").distinct().withColumn("inside", F.lit(True))
    return samples.select("sample").distinct().join(clades, F.lit(True)).join(marked, ["clade", "sample"], "left").select("clade", "sample", F.coalesce("inside", F.lit(False)).alias("inside"))
