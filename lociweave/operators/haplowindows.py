"""Haplotypes in overlapping windows of a fixed number of SNVs along a contig, over the borders of genes, and their homozygosity."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lociweave.operators.diversity import consensus_genotypes
from lociweave.operators.places import placed, windows_of

WINDOW = ("species", "contig", "window")


def window_haplotypes(counts: DataFrame, size: int = 20, step: int = 10) -> DataFrame:
    """(species, contig, window, first_pos, last_pos, sample, haplotype) of every full window.

    SNVs are the sites at which some sample's consensus is derived and another's is not.
    They are numbered along the contig, each goes to the windows that hold its number, and
    a sample's haplotype is its consensus in their order, N where it has none; a sample
    that has none in a window is not in it.
    """
    g = consensus_genotypes(counts).select("species", "contig", "pos", "sample", "genotype")
    sites = g.groupBy("species", "contig", "pos").agg(F.sum("genotype").alias("_k"), F.count(F.lit(1)).alias("_n"), F.collect_list(F.struct("sample", "genotype")).alias("_s")).filter("_k > 0 and _k < _n")
    numbered = placed(sites.select("species", "contig", "pos", "_s"), ["species", "contig"], "pos")
    each = numbered.withColumn("window", F.explode(windows_of(F.col("place"), size, step))).withColumn("_i", (F.col("place") - F.col("window") * step).cast("int"))
    ends = each.groupBy(*WINDOW).agg(F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"), F.count(F.lit(1)).alias("_n")).filter(F.col("_n") == size).drop("_n")
    cells = each.select(*WINDOW, "_i", F.explode("_s").alias("_s")).select(*WINDOW, "_i", "_s.sample", "_s.genotype")
    own = cells.groupBy(*WINDOW, "sample").agg(F.map_from_entries(F.collect_list(F.struct("_i", F.col("genotype").cast("string").alias("c")))).alias("_m"))
    text = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.coalesce(F.try_element_at("_m", i), F.lit("N"))), "")
    return own.join(ends, list(WINDOW)).select(*WINDOW, "first_pos", "last_pos", "sample", text.alias("haplotype"))


def window_counts(haplotypes: DataFrame) -> DataFrame:
    """(window, first_pos, last_pos, haplotype, n), before any two are put together."""
    return haplotypes.groupBy(*WINDOW, "first_pos", "last_pos", "haplotype").agg(F.count(F.lit(1)).alias("n"))


class Clumps:
    """Clumps found so far, by the segments of their haplotypes.

    Two haplotypes that differ at no more than ``most`` known places agree in one of
    ``most + 1`` segments, but for places where one of them is unknown (N). So a clump is
    held under each of its segments, or, where a segment has an N, in a list of its own
    that is always looked at; and only what is found so is compared whole.
    """

    def __init__(self, length: int, most: int):
        self.most = most
        cuts = np.linspace(0, length, most + 2).astype(int)
        self.spans = [(a, b) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        self.names: list[str] = []
        self.known: list[dict[str, set[int]]] = [{} for _ in self.spans]
        self.open: list[set[int]] = [set() for _ in self.spans]

    def _hold(self, k: int, name: str, on: bool) -> None:
        for (a, b), known, open_ in zip(self.spans, self.known, self.open, strict=True):
            place = open_ if "N" in name[a:b] else known.setdefault(name[a:b], set())
            (place.add if on else place.discard)(k)

    def add(self, name: str) -> int:
        """The first clump that ``name`` belongs to, which it completes, or a new one."""
        found: set[int] = set()
        for (a, b), known, open_ in zip(self.spans, self.known, self.open, strict=True):
            if "N" in name[a:b]:
                found = set(range(len(self.names)))
                break
            found |= known.get(name[a:b], set()) | open_
        for k in sorted(found):
            own = self.names[k]
            if sum(x != y and x != "N" and y != "N" for x, y in zip(own, name, strict=True)) <= self.most:
                full = "".join(y if x == "N" else x for x, y in zip(own, name, strict=True))
                if full != own:
                    self._hold(k, own, False)
                    self.names[k] = full
                    self._hold(k, full, True)
                return k
        self.names.append(name)
        self._hold(len(self.names) - 1, name, True)
        return len(self.names) - 1


def _put_together(names: list[str], sizes: list[int], most: int) -> tuple[list[str], list[int], list[int]]:
    """(haplotype, n, members) of the clumps of one window's haplotypes, the first of which come first."""
    clumps, n, members = Clumps(len(names[0]), most), [], []
    for name, size in zip(names, sizes, strict=True):
        k = clumps.add(name)
        if k == len(n):
            n.append(0)
            members.append(0)
        n[k] += size
        members[k] += 1
    return clumps.names, n, members


def clumped_windows(counts: DataFrame, most: int = 1) -> DataFrame:
    """(window, first_pos, last_pos, haplotype, n, members): each window's haplotypes put together, from the most common on, with the first clump within ``most`` known places; a window has a cohort's haplotypes at most.

    A window is a row with its haplotypes in a list, and Python takes batches of windows:
    a group of its own for each of many small windows costs far more than its clumps.
    """
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("_m"), F.col("haplotype"))))
    held = counts.groupBy(*WINDOW).agg(F.first("first_pos").alias("first_pos"), F.first("last_pos").alias("last_pos"), ordered.alias("_h"))
    held = held.select(*WINDOW, "first_pos", "last_pos", F.transform("_h", lambda x: x["haplotype"]).alias("_names"), F.transform("_h", lambda x: -x["_m"]).alias("_sizes"))

    @F.pandas_udf("array<struct<haplotype:string,n:bigint,members:bigint>>")
    def made(names: pd.Series, sizes: pd.Series) -> pd.Series:
        out = []
        for one, n in zip(names, sizes, strict=True):
            got = _put_together(one.tolist(), n.tolist(), most)
            out.append([{"haplotype": h, "n": k, "members": m} for h, k, m in zip(*got, strict=True)])
        return pd.Series(out, dtype=object)

    clumps = held.select(*WINDOW, "first_pos", "last_pos", made("_names", "_sizes").alias("_c"))
    return clumps.select(*WINDOW, "first_pos", "last_pos", F.explode("_c").alias("_c")).select(*WINDOW, "first_pos", "last_pos", "_c.haplotype", "_c.n", "_c.members")


def window_homozygosity(counts: DataFrame) -> DataFrame:
    """(window, first_pos, last_pos, k, h1, h2, h12, h2_h1) of the haplotypes, or clumps, of each window."""
    by = [*WINDOW, "first_pos", "last_pos"]
    w = Window.partitionBy(*by)
    p = counts.withColumn("_p", F.col("n") / F.sum("n").over(w)).withColumn("_r", F.row_number().over(w.orderBy(F.desc("n"), "haplotype")))
    sq = F.col("_p") * F.col("_p")
    part = lambda c, v: F.coalesce(F.sum(F.when(c, v)), F.lit(0.0))
    got = p.groupBy(*by).agg(F.count(F.lit(1)).alias("k"), F.sum(sq).alias("h1"), part(F.col("_r") > 1, sq).alias("h2"), part(F.col("_r") <= 2, F.col("_p")).alias("_two"), part(F.col("_r") > 2, sq).alias("_rest"))
    return got.select(*by, "k", "h1", "h2", (F.col("_two") * F.col("_two") + F.col("_rest")).alias("h12"), F.try_divide("h2", "h1").alias("h2_h1"))
