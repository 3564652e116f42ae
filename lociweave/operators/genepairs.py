"""Linkage within genes, between neighbouring genes and between drawn control genes, as three curves."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lociweave.functions import expr
from lociweave.operators.analyses import drawn
from lociweave.operators.diversity import consensus_genotypes

UNIT = ("species", "contig", "gene_id")
NEAREST = 5
CONTROLS = 10


def polymorphic_genes(sites: DataFrame) -> DataFrame:
    """(species, contig, gene_id, number, cells): each gene's consensus genotypes (pos, sample, genotype) at its polymorphic sites."""
    g = consensus_genotypes(sites).select(*UNIT, "pos", "sample", "genotype")
    by = Window.partitionBy(*UNIT, "pos")
    varied = g.withColumn("_k", F.sum("genotype").over(by)).withColumn("_n", F.count(F.lit(1)).over(by)).filter("_k > 0 and _k < _n")
    return varied.groupBy(*UNIT).agg(F.collect_list(F.struct("pos", "sample", "genotype")).alias("cells")).withColumn("number", expr.gene_number(F.col("gene_id")))


def gene_partners(genes: DataFrame, nearest: int = NEAREST, controls: int = CONTROLS, seed: int = 0) -> DataFrame:
    """(species, contig, gene_id, kind, step, other_contig, other): what each gene is compared with.

    Itself; the genes of its contig whose numbers are 1 to ``nearest`` away; and ``controls``
    genes of its species that are farther, drawn by a hash. Genes in the order of their
    numbers have the near ones in one stretch, so a draw steps over that and none is lost.
    """
    unit = genes.select(*UNIT, "number")
    own = unit.select(*UNIT, F.lit("within").alias("kind"), F.lit(0).alias("step"), F.col("contig").alias("other_contig"), F.col("gene_id").alias("other"))
    asked = unit.select(*UNIT, F.explode(F.array(*[F.lit(k) for k in range(-nearest, nearest + 1) if k])).alias("_step"), "number").withColumn("number", F.col("number") + F.col("_step"))
    there = unit.select("species", "contig", "number", F.col("gene_id").alias("other"))
    near = asked.join(there, ["species", "contig", "number"]).select(*UNIT, F.lit("neighbour").alias("kind"), F.abs("_step").alias("step"), F.col("contig").alias("other_contig"), "other")
    # the genes of a species, some thousands
    by = Window.partitionBy("species")
    up = by.orderBy("number")
    count = lambda last: F.coalesce(F.count(F.lit(1)).over(up.rangeBetween(Window.unboundedPreceding, last)), F.lit(0))
    placed = unit.withColumn("_place", F.row_number().over(by.orderBy("number", "contig")) - 1).withColumn("_before", count(-nearest - 1)).withColumn("_until", count(nearest)).withColumn("_all", F.count(F.lit(1)).over(by))
    free = F.col("_all") - (F.col("_until") - F.col("_before"))
    number = F.conv(F.substring(drawn(*UNIT, "_draw", seed=seed), 1, 8), 16, 10).cast("bigint")
    draws = placed.filter(free > 0).withColumn("_draw", F.explode(F.sequence(F.lit(1), F.lit(controls)))).withColumn("_r", number % free)
    place = F.when(F.col("_r") >= F.col("_before"), F.col("_r") + F.col("_until") - F.col("_before")).otherwise(F.col("_r"))
    target = placed.select("species", F.col("_place").cast("bigint").alias("_r"), F.col("contig").alias("other_contig"), F.col("gene_id").alias("other"))
    far = draws.select(*UNIT, place.cast("bigint").alias("_r")).join(target, ["species", "_r"]).select(*UNIT, F.lit("control").alias("kind"), F.lit(0).alias("step"), "other_contig", "other")
    return own.unionByName(near).unionByName(far)


def unbiased_sums(n11: np.ndarray, n10: np.ndarray, n01: np.ndarray, n00: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unbiased D squared and p1 q1 p2 q2 of site pairs from counts of two-site genotypes; null below four samples."""
    n = n11 + n10 + n01 + n00
    two = lambda a, b: a * (a - 1) * b * (b - 1)
    num = two(n11, n00) - 2 * n11 * n10 * n01 * n00 + two(n10, n01)
    den = two(n10, n01) + two(n11, n00) + 2 * n10 * n01 * n11 * n00
    den += n10 * n01 * n00 * (n01 + n10 + n00 - 3) + n10 * n01 * n11 * (n10 + n01 + n11 - 3) + n11 * n00 * n10 * (n10 + n00 + n11 - 3) + n11 * n00 * n01 * (n01 + n11 + n00 - 3)
    draws = n * (n - 1) * (n - 2) * (n - 3)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(n >= 4, num / draws, np.nan), np.where(n >= 4, den / draws, np.nan)


def _curves(width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def matrix(cells: pa.StructArray, samples: dict[str, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        pos, at = np.unique(cells.field("pos").to_numpy(zero_copy_only=False), return_inverse=True)
        who = np.array([samples.setdefault(s, len(samples)) for s in cells.field("sample").to_pylist()])
        return pos, at, who

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, np.ndarray] = {}
        for b in batches:
            keys = list(zip(b["species"].to_pylist(), b["kind"].to_pylist(), b["step"].to_pylist(), strict=True))
            for r, (species, kind, at) in enumerate(keys):
                samples: dict[str, int] = {}
                sides = []
                for c in ("cells", "other_cells"):
                    cells = b[c][r].values
                    sides.append((*matrix(cells, samples), cells.field("genotype").to_numpy(zero_copy_only=False)))
                dense = []
                for pos, site, who, g in sides:
                    derived, ancestral = np.zeros((len(pos), len(samples))), np.zeros((len(pos), len(samples)))
                    derived[site, who], ancestral[site, who] = g == 1, g == 0
                    dense.append((derived, ancestral))
                (d1, a1), (d2, a2) = dense
                num, den = unbiased_sums(d1 @ d2.T, d1 @ a2.T, a1 @ d2.T, a1 @ a2.T)
                use = den > 1e-9
                if kind == "within":
                    gap = sides[1][0][None, :] - sides[0][0][:, None]
                    use &= gap > 0
                    place = gap // width
                else:
                    place = np.full(num.shape, at)
                for p in np.unique(place[use]):
                    here = use & (place == p)
                    key = (species, kind, int(p))
                    sums[key] = sums.get(key, 0) + np.array([here.sum(), num[here].sum(), den[here].sum()])
        if sums:
            keys, values = zip(*sums.items(), strict=True)
            v = np.array(values)
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys]), pa.array([k[1] for k in keys]), pa.array([k[2] for k in keys], pa.int64()), pa.array(v[:, 0].astype(np.int64)), pa.array(v[:, 1]), pa.array(v[:, 2])], ["species", "kind", "step", "n", "num", "den"])

    return run


def linkage_curves(sites: DataFrame, width: int = 3, nearest: int = NEAREST, controls: int = CONTROLS, seed: int = 0, keep: Column | None = None) -> DataFrame:
    """(species, kind, step, n, num, den, ratio): sums of unbiased D squared over those of p1 q1 p2 q2, for pairs of sites.

    ``within``: of one gene, by distance in steps of ``width``; ``neighbour``: of two genes of a
    contig, by how many numbers they are apart; ``control``: of drawn genes. Genes are joined,
    not sites: the site pairs of two genes are made, summed and forgotten in one task.
    """
    genes = polymorphic_genes(sites if keep is None else sites.filter(keep))
    partners = gene_partners(genes, nearest, controls, seed)
    other = genes.select("species", F.col("contig").alias("other_contig"), F.col("gene_id").alias("other"), F.col("cells").alias("other_cells"))
    both = partners.join(genes.select(*UNIT, "cells"), list(UNIT)).join(other, ["species", "other_contig", "other"])
    parts = both.select("species", "kind", "step", "cells", "other_cells").mapInArrow(_curves(width), "species string, kind string, step bigint, n bigint, num double, den double")
    return parts.groupBy("species", "kind", "step").agg(*[F.sum(c).alias(c) for c in ("n", "num", "den")]).withColumn("ratio", F.try_divide("num", "den"))
