"""Generators of sample pairs and triplets; the sample table is a small dimension."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _two(samples: DataFrame, columns: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    return tuple(samples.select(*[F.col(c).alias(f"{c}_{k}") for c in columns]) for k in (1, 2))


def unordered(samples: DataFrame) -> DataFrame:
    """All pairs of names, each once, with whether they share the subject.

    An inequality join over the names of a cohort, whose square is the result.
    """
    a, b = _two(samples, ("sample", "subject_id"))
    return a.join(b, F.col("sample_1") < F.col("sample_2")).withColumn("same_subject", F.col("subject_id_1") == F.col("subject_id_2"))


def consecutive(samples: DataFrame) -> DataFrame:
    """Each sample and the next one of its subject."""
    w = Window.partitionBy("subject_id").orderBy("ord", "sample")
    return samples.select("subject_id", F.col("sample").alias("sample_1"), F.lead("sample").over(w).alias("sample_2")).filter("sample_2 is not null")


def longest(samples: DataFrame) -> DataFrame:
    got = samples.groupBy("subject_id").agg(F.min_by("sample", F.struct("ord", "sample")).alias("sample_1"), F.max_by("sample", F.struct("ord", "sample")).alias("sample_2"))
    return got.filter("sample_1 <> sample_2")


def nonconsecutive(samples: DataFrame) -> DataFrame:
    """All ordered pairs within a subject."""
    a, b = _two(samples, ("sample", "subject_id", "ord"))
    return a.join(b, (F.col("subject_id_1") == F.col("subject_id_2")) & (F.col("ord_1") < F.col("ord_2"))).select(F.col("subject_id_1").alias("subject_id"), "sample_1", "sample_2")


def across_subjects(samples: DataFrame) -> DataFrame:
    """Earliest samples of different subjects."""
    first = samples.groupBy("subject_id").agg(F.min_by("sample", F.struct("ord", "sample")).alias("sample"))
    a, b = _two(first, ("sample", "subject_id"))
    return a.join(b, F.col("subject_id_1") < F.col("subject_id_2"))


def triplets(samples: DataFrame) -> DataFrame:
    """Samples of orders 1, 2 and 3 of a subject."""
    at = [samples.filter(F.col("ord") == k).select("subject_id", F.col("sample").alias(f"sample_{k}")) for k in (1, 2, 3)]
    return at[0].join(at[1], "subject_id").join(at[2], "subject_id")


def unique(samples: DataFrame) -> DataFrame:
    """The first sample of each subject."""
    return samples.groupBy("subject_id").agg(F.min("sample").alias("sample"))


def longitudinal(samples: DataFrame, least: int = 3) -> DataFrame:
    """Subjects with at least ``least`` orders and their samples in order."""
    got = samples.groupBy("subject_id").agg(F.countDistinct("ord").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "sample"))), lambda x: x["sample"]), ",").alias("samples"))
    return got.filter(F.col("n") >= least)


def same_cage(samples: DataFrame) -> DataFrame:
    a, b = _two(samples, ("sample", "subject_id", "cage"))
    return a.join(b, (F.col("cage_1") == F.col("cage_2")) & (F.col("subject_id_1") < F.col("subject_id_2"))).select(F.col("cage_1").alias("cage"), "sample_1", "sample_2")


def cages(rows: DataFrame) -> DataFrame:
    """Every two cages of a species, each pair once."""
    own = rows.select("species", "cage").distinct()
    a, b = (own.select("species", F.col("cage").alias(f"cage_{k}")) for k in (1, 2))
    return a.join(b, "species").filter("cage_1 < cage_2")


def oriented(pairs: DataFrame, samples: DataFrame) -> DataFrame:
    """Pairs with host and cage orientation."""
    a, b = _two(samples, ("sample", "subject_id", "cage"))
    host = F.when(F.col("subject_id_1") == F.col("subject_id_2"), "Within host").otherwise("Between hosts")
    cage = F.when(F.col("cage_1") == F.col("cage_2"), "Same cage").otherwise("Different cage")
    return pairs.select("sample_1", "sample_2").join(a, "sample_1").join(b, "sample_2").select("sample_1", "sample_2", host.alias("host"), cage.alias("cage"))


def nearest(candidates: DataFrame, by: list[str], distance: str, bias: str) -> DataFrame:
    """The candidate at the least distance in each group, of equals the one with the larger ``bias``."""
    w = Window.partitionBy(*by).orderBy(F.col(distance), F.desc(bias))
    return candidates.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
