"""Sums over sites for every pair of samples, as blocks of a sample-by-sample matrix.

A statistic of two samples that is a sum over sites of products ``a(sample 1) *
b(sample 2)`` is a matrix product of the sites' measures. Each task multiplies the
sites it holds, in blocks, and returns one row a pair of samples; Spark adds these rows
up. So the sites are shuffled once, a site's samples together, and what is shuffled
after that depends on the cohort and the number of tasks, not on the sites: no row a
site and pair is ever made.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SITE = ("species", "contig", "pos")
#: Cells of a dense block of sites by samples, and cells of all matrices that a task holds before it hands them on.
CELLS = 1 << 20
HELD = 1 << 23

#: What is summed: (factor, measure of the first sample, measure of the second).
Terms = list[tuple[float, str, str]]


class _Matrix:
    """The sums of one group so far, with the samples it has seen."""

    def __init__(self, n_products: int):
        self.names: dict[str, int] = {}
        self.sums = np.zeros((n_products, 0, 0))

    def add(self, samples: np.ndarray, sums: np.ndarray) -> int:
        """Adds the matrices over ``samples``; returns by how many cells it grew."""
        at = np.array([self.names.setdefault(s, len(self.names)) for s in samples], dtype=np.int64)
        before, n = self.sums.size, len(self.names)
        if n > self.sums.shape[1]:
            room = np.zeros((len(self.sums), n, n))
            room[:, : self.sums.shape[1], : self.sums.shape[2]] = self.sums
            self.sums = room
        self.sums[:, at[:, None], at[None, :]] += sums
        return self.sums.size - before


def _summer(by: list[str], measures: list[str], products: list[tuple[str, str]], names: list[str], ordered: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    places = [(measures.index(a), measures.index(b)) for a, b in products]

    def told(groups: dict[tuple, _Matrix]) -> Iterator[pa.RecordBatch]:
        for key, m in groups.items():
            labels = np.array(list(m.names), dtype=object)
            i, j = np.nonzero((m.sums != 0).any(axis=0))
            if not ordered:
                first = np.fromiter((a <= b for a, b in zip(labels[i], labels[j], strict=True)), dtype=bool, count=len(i))
                i, j = i[first], j[first]
            yield pa.RecordBatch.from_arrays([*[pa.array([k] * len(i), pa.string()) for k in key], pa.array(labels[i], pa.string()), pa.array(labels[j], pa.string()), *[pa.array(s[i, j], pa.float64()) for s in m.sums]], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[tuple, _Matrix] = {}
        held = 0
        for b in batches:
            if not b.num_rows:
                continue
            lists = b["_s"]
            flat, sizes = lists.flatten(), np.diff(lists.offsets.to_numpy())
            codes = flat.field("sample").dictionary_encode()
            samples, sample = np.array(codes.dictionary.to_pylist(), dtype=object), codes.indices.to_numpy()
            values = np.stack([flat.field(m).to_numpy(zero_copy_only=False) for m in measures])
            keys = list(zip(*[b[k].to_pylist() for k in by], strict=True))
            order: dict[tuple, list[int]] = {}
            for n, k in enumerate(keys):
                order.setdefault(k, []).append(n)
            starts = np.concatenate([[0], np.cumsum(sizes)])
            for key, sites in order.items():
                step = max(1, CELLS // max(1, len(samples)))
                for lo in range(0, len(sites), step):
                    part = np.array(sites[lo : lo + step])
                    rows = np.concatenate([np.arange(starts[n], starts[n + 1]) for n in part])
                    site = np.repeat(np.arange(len(part)), sizes[part])
                    own, at = np.unique(sample[rows], return_inverse=True)
                    dense = np.zeros((len(measures), len(part), len(own)))
                    dense[:, site, at] = values[:, rows]
                    sums = np.stack([dense[a].T @ dense[c] for a, c in places])
                    held += groups.setdefault(key, _Matrix(len(places))).add(samples[own], sums)
            if held > HELD:
                yield from told(groups)
                groups, held = {}, 0
        yield from told(groups)

    return run


def pair_sums(rows: DataFrame, measures: dict[str, Column], sums: dict[str, Terms], support: str, by: tuple[str, ...] = ("species",), site: tuple[str, ...] = SITE, ordered: bool = False, diagonal: bool = False) -> DataFrame:
    """(by, sample_1, sample_2, sums): for every two samples the sums over sites of their terms, where the sum ``support`` is not 0.

    ``rows`` has a row a site and sample; a null measure counts as 0, and so does a
    missing row. ``by`` are string columns. With ``ordered`` every pair comes both ways,
    else with the smaller name first; ``diagonal`` adds each sample with itself.
    """
    keys = [k for k in dict.fromkeys((*by, *site))]
    held = rows.select(*keys, "sample", *[F.coalesce(v.cast("double"), F.lit(0.0)).alias(f"m_{k}") for k, v in measures.items()])
    columns = [f"m_{k}" for k in measures]
    sites = held.groupBy(*keys).agg(F.collect_list(F.struct("sample", *columns)).alias("_s")).select(*by, "_s")
    products = list(dict.fromkeys((f"m_{a}", f"m_{b}") for terms in sums.values() for _, a, b in terms))
    made = [f"p{k}" for k in range(len(products))]
    names = [*by, "sample_1", "sample_2", *made]
    schema = ", ".join([*(f"{n} string" for n in names[: len(by) + 2]), *(f"{p} double" for p in made)])
    cells = sites.mapInArrow(_summer(list(by), columns, products, names, ordered), schema)
    whole = cells.groupBy(*names[: len(by) + 2]).agg(*[F.sum(p).alias(p) for p in made])
    if not diagonal:
        whole = whole.filter(F.col("sample_1") != F.col("sample_2"))

    def total(terms: Terms) -> Column:
        out = F.lit(0.0)
        for factor, a, b in terms:
            out = out + F.lit(factor) * F.col(made[products.index((f"m_{a}", f"m_{b}"))])
        return out

    return whole.select(*names[: len(by) + 2], *[total(t).alias(n) for n, t in sums.items()]).filter(F.col(support) != 0)


def counted(name: str) -> Column:
    """A sum of whole numbers as one."""
    return F.round(name).cast("bigint").alias(name)


def opposed_pairs(rows: DataFrame, side: Column, keep: tuple[str, ...], by: tuple[str, ...]) -> DataFrame:
    """Pairs of samples of which one has ``side`` true and the other false at a site, the smaller name first, with ``keep`` of both.

    The samples of each side are collected and their product is exploded, so there is a row only for what differs.
    """
    held = F.struct("sample", *keep)
    both = rows.groupBy(*by).agg(F.collect_list(F.when(side, held)).alias("_a"), F.collect_list(F.when(~side, held)).alias("_b")).filter((F.size("_a") > 0) & (F.size("_b") > 0))
    two = both.select(*by, "_b", F.explode("_a").alias("_x")).select(*by, "_x", F.explode("_b").alias("_y"))
    swap = F.col("_x.sample") > F.col("_y.sample")
    ends = two.select(*by, F.when(swap, F.col("_y")).otherwise(F.col("_x")).alias("_1"), F.when(swap, F.col("_x")).otherwise(F.col("_y")).alias("_2"))
    return ends.select(*by, F.col("_1.sample").alias("sample_1"), F.col("_2.sample").alias("sample_2"), *[F.col(f"_{k}.{c}").alias(f"{c}_{k}") for k in (1, 2) for c in keep])
