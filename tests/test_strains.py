"""Distributed clusters of SNVs against the kernel that holds the whole matrix."""

import numpy as np
import pytest

from lociweave.functions import kernels as K
from lociweave.operators import strains

COUNTS = "species string, contig string, pos long, sample string, depth long, alt long"


def planted(seed, snvs, samples, gaps, depth=60):
    """SNVs of three strains and noise, some with their alleles turned."""
    rng = np.random.default_rng(seed)
    strain = rng.dirichlet(np.ones(3), samples)
    rows = []
    for p in range(snvs):
        k = rng.integers(0, 5)
        for s in range(samples):
            if rng.random() < gaps:
                continue
            d = int(rng.integers(depth // 2, 2 * depth))
            f = strain[s, k] if k < 3 else rng.random()
            f = 1 - f if p % 3 == 0 else f
            rows.append(("sp", f"c{p % 2}", p, f"s{s:02d}", d, int(rng.binomial(d, f))))
    return rows


def by_kernel(vectors, **options):
    t = vectors.toPandas().sort_values(["mean", "contig", "pos"], ascending=[False, True, True])
    cluster, flipped = K.strain_clusters(np.stack(t["fs"]), np.stack(t["ds"]), **options)
    return {(c, p): (int(k), bool(x)) for c, p, k, x in zip(t["contig"], t["pos"], cluster, flipped, strict=True) if k >= 0}


@pytest.mark.parametrize("snvs,gaps,block", [(2000, 0.0, 400), (300, 0.2, 64), (300, 0.0, 16), (120, 0.0, 2048)])
def test_clusters_are_those_of_the_whole_matrix(spark, monkeypatch, snvs, gaps, block):
    monkeypatch.setattr(strains, "BLOCK", block)
    vectors = strains.snv_vectors(strains.strain_sites(spark.createDataFrame(planted(1, snvs, 12, gaps), COUNTS))).cache()
    got = {(r["contig"], r["pos"]): (r["cluster"], r["turned"]) for r in strains.snv_clusters(vectors).collect()}
    assert got == by_kernel(vectors) and len({k for k, _ in got.values()}) >= 3


def test_blocks_far_apart_are_not_compared(spark, monkeypatch):
    monkeypatch.setattr(strains, "BLOCK", 50)
    vectors = strains.snv_vectors(strains.strain_sites(spark.createDataFrame(planted(2, 600, 6, 0.0, depth=400), COUNTS))).cache()
    rows = strains._blocks(vectors).cache()
    n = rows.select("block").distinct().count()
    tiles = strains._tiles(rows, 3.5).count()
    assert 0 < tiles < 0.6 * n * (n + 1) / 2
    # and what is linked is all that the whole matrix links
    t = vectors.toPandas()
    f, d = np.stack(t["fs"]), np.stack(t["ds"])
    i, j, _ = strains.near_pairs(f, d, f, d, 3.5)
    whole = {frozenset(((t["contig"][a], t["pos"][a]), (t["contig"][b], t["pos"][b]))) for a, b in zip(i, j, strict=True)}
    assert {frozenset(((r[1], r[2]), (r[3], r[4]))) for r in strains.links(vectors).collect()} == whole


def test_near_pairs_are_those_of_the_distances():
    rng = np.random.default_rng(3)
    f, d = rng.choice([0.0, 0.2, 0.9, 1.0], (40, 5)), rng.integers(0, 30, (40, 5)).astype(float)
    i, j, turned = strains.near_pairs(f, d, f, d, 5.0)
    forward, back = K.snv_distances(f, d), K.snv_distances(f, d, True)
    with np.errstate(invalid="ignore"):
        want = np.argwhere(np.fmin(forward, back) < 5.0)
    assert sorted(zip(i, j, strict=True)) == sorted(map(tuple, want.tolist())) and all(t == (back[a, b] < forward[a, b]) for a, b, t in zip(i, j, turned, strict=True))


@pytest.mark.parametrize("most", [1, 7, 40, 1000])
def test_best_covered(spark, most):
    rng = np.random.default_rng(4)
    rows = [("sp", f"c{p % 3}", p, f"s{s}", int(rng.integers(10, 14)), 0) for p in range(60) for s in range(3)]
    got = {(r["contig"], r["pos"]) for r in strains.best_covered(spark.createDataFrame(rows, COUNTS), most).collect()}
    mean = {(f"c{p % 3}", p): np.mean([r[4] for r in rows if r[2] == p]) for p in range(60)}
    assert got == set(sorted(mean, key=lambda k: (-mean[k], *k))[:most])


def test_chain_finds_the_strains(spark):
    rows = planted(5, 400, 10, 0.0)
    samples = spark.createDataFrame([(f"s{k:02d}", f"H{k % 3}") for k in range(10)], "sample string, subject_id string")
    got = strains.strain_chain(spark.createDataFrame(rows, COUNTS), samples, "s00").toPandas()
    sums = got.groupby("sample")["freq"].sum()
    assert got["strain"].nunique() == 3 and (sums - 1).abs().max() < 0.1 and sorted(got.groupby("strain")["place"].first()) == [1, 2, 3]
    first = got[got["sample"] == "s00"].sort_values("place")["freq"].tolist()
    assert first == sorted(first, reverse=True)


def test_frequencies_and_intervals(spark):
    got = strains.strains(spark.createDataFrame(planted(6, 300, 6, 0.0), COUNTS)).collect()
    assert all(r["quantile_25"] <= r["quantile_75"] and r["lower_ci"] <= r["freq"] <= r["upper_ci"] for r in got) and len({r["strain"] for r in got}) == 3


def test_links_leave_tasks_as_bits_and_sparse_cells_share_blocks(spark, monkeypatch):
    # 200 SNVs of few vectors and varied depths: all are linked, and no row of links is made for each two
    rng = np.random.default_rng(7)
    rows = [("sp", "c", p, f"s{s}", int(4 ** (1 + p % 5)) * 5, int(4 ** (1 + p % 5)) * 2) for p in range(200) for s in range(3)]
    vectors = strains.snv_vectors(strains.strain_sites(spark.createDataFrame(rows, COUNTS))).cache()
    assert strains._blocks(vectors).select("block").distinct().count() == 1
    whole, made = strains._link_bits, []
    monkeypatch.setattr(strains, "_link_bits", lambda *x: made.append(whole(*x)) or made[-1])
    monkeypatch.setattr(strains, "links", None)
    got = {(r["contig"], r["pos"]): (r["cluster"], r["turned"]) for r in strains.snv_clusters(vectors).collect()}
    assert got == by_kernel(vectors) and len(got) == 200
    assert made[0].count() == 5
