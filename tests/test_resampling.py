"""Greedy clusterings, draws and labels against plain Python."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lociweave.functions import expr
from lociweave.functions import kernels as K
from lociweave.operators import labels, linkage, strains
from lociweave.operators import resampling as R

MICE = {"1": ("Control diet", "Cage 1"), "2": ("Control diet", "Cage 1"), "3": ("Control diet", "Cage 1"), "4": ("Guar gum diet", "Cage 2"), "5": ("Guar gum diet", "Cage 2"), "6": ("Guar gum diet", "Cage 3"), "7": ("Guar gum diet", "Cage 3"), "8": ("Guar gum diet", "Cage 3")}


def test_diet_and_cage_of_all_mice(spark):
    rows = spark.createDataFrame([(f"M{m}{c}",) for m in MICE for c in ("Co", "Ce", "I", "J", "D")], "sample string")
    for r in labels.annotated(rows).collect():
        assert (r["diet"], r["cage"]) == MICE[r["sample"][1]] and r["mouse"] == r["sample"][1]
        assert r["region"] == ("Lower gut" if r["sample"][2] == "C" else "Upper gut")


@pytest.mark.parametrize("made", [expr.diet, expr.cage, expr.gut_site])
def test_unknown_samples_fail(spark, made):
    with pytest.raises(Exception, match="in sample name M9"):
        spark.createDataFrame([("M9Xx",)], "s string").select(made(F.col("s"))).collect()


def test_clumps():
    assert R.close_haplotypes("01N0", "0110", 0) == "0110" and R.close_haplotypes("0110", "1110", 0) is None and R.close_haplotypes("0110", "1110", 1) == "0110"
    got = R.clump(["0000", "00N1", "1111", "0011"], [5, 3, 2, 1], 1)
    # 00N1 joins 0000, which stays; 0011 is two from 0000, two from 1111
    assert got == [("0000", 8, 2), ("1111", 2, 1), ("0011", 1, 1)]
    assert R.clump(["0N", "01"], [3, 1], 0) == [("01", 4, 2)]


def test_haplotypes_by_hand(spark):
    rng = np.random.default_rng(3)
    rows = [("sp", f"g{p // 4}", p, f"s{k}", int(rng.integers(0, 11)), 10) for p in range(12) for k in range(5) if rng.random() < 0.8]
    got = {(r["gene_id"], r["sample"]): r["haplotype"] for r in linkage.haplotypes(spark.createDataFrame(rows, "species string, gene_id string, pos long, sample string, alt long, depth long")).collect()}
    want = {}
    for g in {r[1] for r in rows}:
        places = sorted({r[2] for r in rows if r[1] == g})
        for s in {r[3] for r in rows if r[1] == g}:
            at = {r[2]: "0" if r[4] <= 2 else "1" if r[4] >= 8 else "N" for r in rows if r[1] == g and r[3] == s}
            want[g, s] = "".join(at.get(p, "N") for p in places)
    assert got == want


def test_balanced_centroids(spark):
    f = np.array([[0.3, 0.6, 0.2], [0.3, 0.6, 0.2], [0.9, 0.9, 0.9]])
    rows = [("sp", c, f"s{s}", float(f[c, s])) for c in range(3) for s in range(3)]
    got = R.balanced_centroids(spark.createDataFrame(rows, "species string, cluster long, sample string, f double")).collect()
    sums = {}
    for r in got:
        sums[r["sample"]] = sums.get(r["sample"], 0) + r["f"]
    every = [np.abs(np.where((np.arange(3)[:, None] & 0) + np.array([[m >> c & 1] for c in range(3)]), 1 - f, f).sum(0) - 1).sum() for m in range(8)]
    assert sum(abs(s - 1) for s in sums.values()) == pytest.approx(min(every))


def test_descriptions(spark):
    rows = [("a", x) for x in ("kinase A", "kinase B", "kinase AB", "transporter", "transportes")]
    got = {r["description"]: r["cluster"] for r in R.clustered_descriptions(spark.createDataFrame(rows, "k string, description string"), "k").collect()}
    assert got == {"kinase A": 0, "kinase AB": 0, "kinase B": 0, "transporter": 1, "transportes": 1}


def test_scaling_finds_a_plane(spark):
    x = np.random.default_rng(5).standard_normal((8, 2))
    rows = [(f"s{i}", f"s{j}", float(np.linalg.norm(x[i] - x[j]))) for i in range(8) for j in range(i + 1, 8)]
    got = {r["sample"]: (r["x"], r["y"], r["stress"]) for r in R.metric_scaling(spark.createDataFrame(rows, "sample_1 string, sample_2 string, d double"), "d", 2000).collect()}
    assert max(abs(np.hypot(got[a][0] - got[b][0], got[a][1] - got[b][1]) - d) for a, b, d in rows) < 0.05


def test_a_species_without_clusters_is_one_strain(spark):
    rng = np.random.default_rng(6)
    rows = [("sp", "c", p, f"s{k}", 200, int(rng.integers(0, 201))) for p in range(8) for k in range(4)]
    got = strains.strains(spark.createDataFrame(rows, "species string, contig string, pos long, sample string, depth long, alt long")).collect()
    assert {(r["sample"], r["freq"]) for r in got} == {(f"s{k}", 1.0) for k in range(4)}


def test_distances_keep_only_what_clusters_need():
    rng = np.random.default_rng(7)
    f, d = rng.random((60, 6)), rng.integers(0, 50, (60, 6)).astype(float)
    forward, back = K.snv_distances(f, d), K.snv_distances(f, d, True)
    want = np.array([[2 * np.nanmean((d[i] + d[j]) * (f[i] - f[j]) ** 2 / ((f[i] + f[j]) * (2 - f[i] - f[j]))) for j in range(60)] for i in range(60)])
    assert np.allclose(forward, want) and np.allclose(back[3], K.snv_distances(np.vstack([1 - f[3:4], f]), np.vstack([d[3:4], d]))[0, 1:])
    near = float(np.median(np.minimum(forward, back)))
    cluster, flipped = K.strain_clusters(f, d, near=near, least=3)
    assert cluster.max() >= 0 and set(np.flatnonzero(flipped)) <= set(np.flatnonzero(cluster >= 0))


def test_halves_are_fair_and_complete(spark):
    rows = [("sp", f"a{k}", f"b{k}", 1000) for k in range(40)]
    got = R.halves(spark.createDataFrame(rows, "species string, sample_1 string, sample_2 string, n long"), "n").collect()
    assert all(r["half_1"] + r["half_2"] == 1000 for r in got) and abs(np.mean([r["half_1"] for r in got]) - 500) < 15
