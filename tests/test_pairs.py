"""Pair statistics, the annotated-SNP chain, axes, bootstraps and haplotype windows against plain loops."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lociweave.functions import kernels as K
from lociweave.operators import axes, blocks, bootstrap, chain, changes, diversity, errors, genepairs, haplowindows, places
from lociweave.operators import resampling as R

COUNTS = "species string, contig string, pos long, sample string, depth long, alt long"


def random_counts(seed, sites=60, samples=7, species=2, gaps=0.2):
    rng = np.random.default_rng(seed)
    rows = []
    for sp, p, s in itertools.product(range(species), range(sites), range(samples)):
        if rng.random() >= gaps:
            d = int(rng.integers(0, 40))
            rows.append((f"sp{sp}", f"c{p % 2}", p, f"s{s}", d, int(rng.integers(0, d + 1)) if rng.random() < 0.5 else int(rng.choice([0, d]))))
    return rows


@pytest.mark.parametrize("cells,held", [(1 << 20, 1 << 23), (40, 10)])
@pytest.mark.parametrize("ordered,diagonal", [(False, False), (True, False), (True, True), (False, True)])
def test_pair_sums(spark, monkeypatch, cells, held, ordered, diagonal):
    monkeypatch.setattr(blocks, "CELLS", cells)
    monkeypatch.setattr(blocks, "HELD", held)
    rows = random_counts(1)
    a, b = {}, {}
    for sp, c, p, s, d, alt in rows:
        a[sp, c, p, s], b[sp, c, p, s] = float(d), float(alt)
    want = {}
    for sp, c, p in {k[:3] for k in a}:
        here = [k[3] for k in a if k[:3] == (sp, c, p)]
        for x, y in itertools.product(here, here):
            if (ordered or x <= y) and (diagonal or x != y):
                v = want.setdefault((sp, x, y), [0.0, 0.0])
                v[0] += 1
                v[1] += 2 * a[sp, c, p, x] * b[sp, c, p, y] - b[sp, c, p, x]
    got = blocks.pair_sums(spark.createDataFrame(rows, COUNTS), {"n": F.lit(1), "a": F.col("depth"), "b": F.col("alt")}, {"n": [(1.0, "n", "n")], "x": [(2.0, "a", "b"), (-1.0, "b", "n")]}, "n", ordered=ordered, diagonal=diagonal)
    assert {(r[0], r[1], r[2]): [r["n"], r["x"]] for r in got.collect()} == {k: pytest.approx(v) for k, v in want.items()}


def test_null_measures_count_as_nothing(spark):
    rows = [("a", "c", 1, "x", 0, 0), ("a", "c", 1, "y", 4, 2), ("a", "c", 1, "z", 4, 0)]
    got = blocks.pair_sums(spark.createDataFrame(rows, COUNTS), {"n": F.lit(1), "f": F.try_divide("alt", F.nullif(F.col("depth"), F.lit(0)))}, {"n": [(1.0, "n", "n")], "f": [(1.0, "f", "n"), (1.0, "n", "f")]}, "n")
    assert {(r["sample_1"], r["sample_2"]): r["f"] for r in got.collect()} == {("x", "y"): 0.5, ("x", "z"): 0.0, ("y", "z"): 0.5}


def test_opposed_pairs(spark):
    rows = [("a", "c", 1, s, d, 0) for s, d in (("x", 1), ("y", 0), ("z", 1), ("w", 0))] + [("a", "c", 2, "x", 1, 0)]
    got = blocks.opposed_pairs(spark.createDataFrame(rows, COUNTS), F.col("depth") > 0, ("depth",), ("species", "contig", "pos"))
    assert sorted((r["sample_1"], r["sample_2"], r["depth_1"], r["depth_2"]) for r in got.collect()) == [("w", "x", 0, 1), ("w", "z", 0, 1), ("x", "y", 1, 0), ("y", "z", 0, 1)]


def test_singletons_and_doubletons(spark):
    # derived in one of five, in two of five, in one of three (too few), and a covered site that is not called
    rows = [("sp", "c", 1, f"s{k}", 10, 10 if k == 0 else 0) for k in range(5)] + [("sp", "c", 2, f"s{k}", 10, 10 if k < 2 else 0) for k in range(5)]
    rows += [("sp", "c", 3, f"s{k}", 10, 10 if k == 0 else 0) for k in range(3)] + [("sp", "c", 4, f"s{k}", 10, 5) for k in range(5)] + [("sp", "c", 5, f"s{k}", 10, 5) for k in range(5)]
    sites = spark.createDataFrame(rows, COUNTS).withColumn("variant_type", F.lit("4D"))
    called = spark.createDataFrame([("sp", "c", p) for p in (1, 2, 3, 5)], "species string, contig string, pos long")
    got = {(r["sample_1"], r["sample_2"]): tuple(r)[3:] for r in changes.pair_singletons(sites, called).collect()}
    # sites 1 and 2 are confident, 3 has too few, 4 is covered and not called, 5 is called and not confident
    assert got["s0", "s1"] == (1, 1, 1, 3) and got["s1", "s0"] == (0, 1, 1, 3) and got["s0", "s4"] == (1, 0, 2, 3) and got["s4", "s0"] == (0, 0, 2, 3) and got["s3", "s4"] == (0, 0, 0, 3)
    assert changes.pair_singletons(sites, called, types=("1D",)).count() == 0


def chain_by_hand(rows, types, population, pvalues, least_samples=2):
    by = {}
    for sp, c, p, s, d, a in rows:
        by.setdefault((sp, s), []).append(d)
    windows = {}
    for k, depths in by.items():
        seen = sorted(d for d in depths if d)
        median = depths[0] if len(set(depths)) == 1 else 0 if depths.count(0) > 0.8 * len(depths) or not seen else next(d for i, d in enumerate(seen) if (i + 1) / len(seen) >= 0.5 and (i + 1 == len(seen) or seen[i + 1] != d))
        if median >= 5:
            windows[k] = (math.floor(0.3 * median) - 0.5, math.ceil(3 * median) + 0.5)
    out = {}
    for sp, c, p in {r[:3] for r in rows}:
        if (c, p) not in types:
            continue
        here = {s: (d, a) for x, y, z, s, d, a in rows if (x, y, z) == (sp, c, p) and (sp, s) in windows}
        inside = {s: windows[sp, s][0] <= d <= windows[sp, s][1] for s, (d, a) in here.items()}
        if not here or sum(inside.values()) / len(here) < min(least_samples / len({k[1] for k in by if k[0] == sp}), 0.5):
            continue
        turn, pv = population.get((sp, c, p), 0) > 0.5, pvalues.get((sp, c, p), 1.0)
        now = {s: (d, d - a if turn else a) if inside[s] else (0, 0) for s, (d, a) in here.items()}
        called = pv < 0.05 and any(d and a > math.ceil(0.05 * d) + 0.5 for d, a in now.values())
        for s, (d, a) in now.items():
            out[sp, c, p, s] = (*types[c, p], "A" if turn else "R", pv, d, a, called, d > 0 and (a in (0, d) or (a > 1 and d - a > 1)))
    return out


def test_chain_by_hand(spark):
    rng = np.random.default_rng(8)
    rows = []
    for p, s in itertools.product(range(80), range(6)):
        d = 0 if s == 5 and rng.random() < 0.9 or rng.random() < 0.3 else int(rng.integers(1, 4 if s == 4 else 90))
        rows.append(("sp", "c", p, f"s{s}", d, int(rng.integers(0, d + 1)) if rng.random() < 0.4 else int(rng.choice([0, d]))))
    types = {("c", p): (f"g{p // 10}", ["1D", "2D", "3D", "4D"][p % 4]) for p in range(75)}
    population = {("sp", "c", p): float(rng.random()) for p in range(0, 80, 2)}
    pvalues = {("sp", "c", p): float(rng.random() / 10) for p in range(60)}
    info = spark.createDataFrame([(c, p, *v) for (c, p), v in types.items()] + [("c", 76, "g7", "NC")], "contig string, pos long, gene_id string, variant_type string")
    site = "species string, contig string, pos long, "
    got = chain.annotated_sites(spark.createDataFrame(rows, COUNTS), info, spark.createDataFrame([(*k, v) for k, v in population.items()], site + "alt_freq double"), spark.createDataFrame([(*k, v) for k, v in pvalues.items()], site + "pvalue double"), least_samples=2)
    made = {(r["species"], r["contig"], r["pos"], r["sample"]): (r["gene_id"], r["variant_type"], r["polarization"], r["pvalue"], r["depth"], r["alt"], r["called"], r["supported"]) for r in got.collect()}
    want = chain_by_hand(rows, types, population, pvalues)
    assert made == want
    # the cases are all there: turned and not, called and not, emptied by the window, a sample too thin and one mostly empty
    assert {v[2] for v in want.values()} == {"A", "R"} and {v[6] for v in want.values()} == {True, False} and {k[3] for k in want} == {f"s{k}" for k in range(4)} and any(v[4] == 0 for v in want.values())


def test_site_pvalues(spark):
    rows = [("sp", "c", 1, "a", 30, 6), ("sp", "c", 1, "b", 20, 0), ("sp", "c", 1, "z", 0, 0), ("sp", "c", 2, "a", 30, 30), ("sp", "c", 3, "a", 0, 0)]
    got = {r["pos"]: r["pvalue"] for r in chain.site_pvalues(spark.createDataFrame(rows, COUNTS)).collect()}
    assert got == {1: pytest.approx(2 * K.binomial_tail(6, 30, K.ERROR), abs=1e-9), 2: 1.0}


@pytest.mark.parametrize("samples", [1, 5, 40])
def test_axes_are_those_of_a_dense_solver(spark, samples):
    rows = random_counts(4, sites=120, samples=samples, species=1, gaps=0.3)
    cov = diversity.genotype_covariance(spark.createDataFrame(rows, COUNTS), diagonal=True)
    names = [f"s{k}" for k in range(samples)]
    names.sort()
    m = np.zeros((samples, samples))
    for r in cov.collect():
        i, j = names.index(r["sample_1"]), names.index(r["sample_2"])
        m[i, j] = m[j, i] = r["cov"]
    xy, share = K.principal_axes(m, min(2, samples))
    got = axes.principal_axes(cov).collect()
    assert len(got) == samples * min(2, samples)
    for r in got:
        k = r["axis"] - 1
        # one sample alone does not vary
        assert (r["share"] is None) if samples == 1 else r["share"] == pytest.approx(share[k], abs=1e-7)
        assert abs(r["coordinate"]) == pytest.approx(abs(xy[names.index(r["sample"]), k]), abs=1e-5)


def test_axes_of_nothing(spark):
    assert axes.principal_axes(spark.createDataFrame([], "species string, sample_1 string, sample_2 string, cov double")).count() == 0


def test_poisson_weights(spark):
    rows = spark.range(300).select(F.col("id").cast("string").alias("key"))
    got = np.zeros((300, 64))
    for r in bootstrap.weighted(rows, ["key"], 64, seed=1).collect():
        assert r["w"] > 0 and 0 <= r["rep"] < 64
        got[int(r["key"]), r["rep"]] = r["w"]
    assert got.mean() == pytest.approx(1, abs=0.03) and got.var() == pytest.approx(1, abs=0.06)
    assert (got == 0).mean() == pytest.approx(math.exp(-1), abs=0.02) and abs(np.corrcoef(got.T)[0, 1:]).mean() < 0.12
    # the same rows have the same weights in any order and partitioning
    again = {(r["key"], r["rep"]): r["w"] for r in bootstrap.weighted(rows.repartition(5).orderBy(F.desc("key")), ["key"], 64, seed=1).collect()}
    assert all(again.get((str(k), r), 0) == got[k, r] for k in range(300) for r in range(64))


def test_bootstrap_interval_covers_the_sampling_spread(spark):
    rng = np.random.default_rng(9)
    num, den = rng.poisson(20, 400), rng.poisson(100, 400)
    rows = spark.createDataFrame([("g", k, float(a), float(b)) for k, (a, b) in enumerate(zip(num, den, strict=True))], "g string, k int, a double, b double")
    r = bootstrap.bootstrap_ratios(rows, ["g"], ["k"], "a", "b", draws=400).first()
    se = np.std([(num[i].sum() / den[i].sum()) for i in (rng.integers(0, 400, 400) for _ in range(400))])
    assert r["ratio"] == pytest.approx(num.sum() / den.sum()) and r["upper"] - r["lower"] == pytest.approx(2 * 1.96 * se, rel=0.25) and r["lower"] < r["ratio"] < r["upper"]


def test_cumulative_intervals(spark):
    rows = spark.createDataFrame([("g", k, 0.1 * k, float(k), 2.0) for k in range(10)], "g string, k int, at double, a double, b double")
    got = {round(r["cut"], 3): r for r in bootstrap.cumulative_intervals(rows, ["g"], ["k"], "at", "a", "b", [0.25, 0.5, 5.0], draws=200).collect()}
    assert [got[c]["n_below"] for c in (0.25, 0.5, 5.0)] == [3, 6, 10]
    assert got[0.25]["below"] == pytest.approx(3 / 6) and got[0.25]["above"] == pytest.approx(42 / 14) and got[0.5]["below"] == pytest.approx(15 / 12) and got[5.0]["above"] is None and got[5.0]["above_lower"] is None
    assert got[0.5]["below_lower"] < got[0.5]["below"] < got[0.5]["below_upper"]


def test_halved_selection_has_no_shared_noise(spark):
    rng = np.random.default_rng(10)
    rows = []
    for k in range(300):
        for t, n in (("4D", rng.poisson(30)), ("1D", rng.poisson(30))):
            rows.append(("sp", f"a{k}", f"b{k}", t, int(n), 0, 500, 500))
    rows += [("sp", "x", "y", "4D", 3, 0, 500, 0)]
    got = bootstrap.halved_selection(spark.createDataFrame(rows, "species string, sample_1 string, sample_2 string, type string, muts long, revs long, mut_opportunities long, rev_opportunities long")).collect()
    ds, other, dnds = (np.array([r[c] for r in got]) for c in ("ds", "ds_other", "dnds"))
    assert len(got) == 300 and abs(np.corrcoef(ds, dnds)[0, 1]) < 0.15 and np.corrcoef(other, dnds)[0, 1] < -0.5
    assert all(r["ds"] + r["ds_other"] == pytest.approx(r["n_syn"] / 500) and r["expected_non"] == pytest.approx(r["ds_other"] * 1000) for r in got)


def test_permuted_fst(spark):
    rng = np.random.default_rng(11)
    names = [f"s{k:02d}" for k in range(14)]
    labels = [k < 6 for k in range(14)]
    rows = [(sp, names[i], names[j], float(rng.random() + (sp == "split" and labels[i] != labels[j]))) for sp in ("split", "mixed") for i, j in itertools.combinations(range(14), 2)] + [("few", "s00", "s01", 1.0)]
    got = {r["species"]: r for r in bootstrap.permuted_fst(spark.createDataFrame(rows, "species string, sample_1 string, sample_2 string, v double"), spark.createDataFrame(list(zip(names, labels, strict=True)), "sample string, flag boolean"), "v", "flag", trials=99).collect()}
    assert set(got) == {"split", "mixed"} and got["split"]["pvalue"] == 0.01 and got["mixed"]["pvalue"] > 0.05
    for sp in got:
        own = [v for s, a, b, v in rows if s == sp and labels[names.index(a)] == labels[names.index(b)]]
        assert got[sp]["fst"] == pytest.approx(1 - np.mean(own) / np.mean([r[3] for r in rows if r[0] == sp]))


def test_change_errors(spark):
    sfs = [("sp", "a", 10, 1, 6), ("sp", "a", 20, 10, 4), ("sp", "b", 30, 27, 5), ("sp", "b", 12, 0, 5)]
    got = {r["change"]: r["rate"] for r in errors.change_errors(spark.createDataFrame(sfs, "species string, sample string, depth long, alt long, n long"), spark.createDataFrame([("a", "b")], "sample_1 string, sample_2 string")).collect()}
    prior = np.zeros(20)
    for s in "ab":
        total = sum(r[4] for r in sfs if r[1] == s)
        for _, x, d, alt, n in sfs:
            if x == s:
                b = min(19, int(20 * alt / d + 1e-9))
                prior[b] += n / total / 4
                prior[19 - b] += n / total / 4
    low = lambda d, f, c: K.binomial_pmf(np.arange(math.floor(d * (1 - c) / 2 + 1e-9) + 1), d, f).sum()
    for c in errors.CHANGES:
        want = 0.0
        for b in range(20):
            f = (b + 0.5) / 20
            one = sum(n / 10 * low(d, f, c) for _, s, d, _, n in sfs if s == "a")
            two = sum(n / 10 * low(d, 1 - f, c) for _, s, d, _, n in sfs if s == "b")
            want += prior[b] * one * two
        assert got[c] == pytest.approx(want, rel=1e-8)


def test_gene_errors(spark):
    genes = [("sp", "g1", "a", 20, 1.0), ("sp", "g1", "b", 30, 2.0), ("sp", "g2", "a", 4, 0.5), ("sp", "g2", "b", 0, 0.0)]
    got = errors.gene_errors(spark.createDataFrame(genes, "species string, gene_id string, sample string, reads long, copynum double"), spark.createDataFrame([("a", "b")], "sample_1 string, sample_2 string")).first()
    assert got["n_genes"] == 1 and got["expected"] == pytest.approx(K.gene_error(20, 1.0, 30, 2.0), rel=1e-9)


def test_inverted_curve(spark):
    xs = [0.0, 0.01, 0.5, 3.0, 100.0]
    rows = spark.createDataFrame([((10 + 2 * x) / (22 + 26 * x + 4 * x * x) * 2.2,) for x in xs] + [(1.3,), (0.0,), (-0.1,)], "r double")
    got = [r[0] for r in rows.select(errors.inverted_neutral(F.col("r"))).collect()]
    assert got[:6] == pytest.approx([*xs, 0.0], abs=1e-9) and got[6:] == [None, None]


def test_linkage_of_gene_pairs(spark):
    rng = np.random.default_rng(12)
    rows, genes = [], {}
    for g in range(1, 14):
        for k in range(3):
            p = 10 * g + k
            genes[p] = g
            for s in range(9):
                if rng.random() < 0.85:
                    rows.append(("sp", "c" if g < 10 else "d", f"1.2.peg.{g}", p, f"s{s}", 10, int(rng.choice([0, 10, 5], p=[0.45, 0.45, 0.1]))))
    sites = spark.createDataFrame(rows, "species string, contig string, gene_id string, pos long, sample string, depth long, alt long")
    at = {}
    for _, c, g, p, s, d, a in rows:
        if a != 5:
            at.setdefault((c, int(g.rsplit(".", 1)[1]), p), {})[s] = a // 10
    at = {k: v for k, v in at.items() if 0 < sum(v.values()) < len(v)}
    units = sorted({k[:2] for k in at}, key=lambda u: (u[1], u[0]))

    def pairs_sum(pairs):
        n = num = den = 0.0
        for x, y in pairs:
            both = [(at[x][s], at[y][s]) for s in at[x] if s in at[y]]
            c = [np.array(float(both.count(v))) for v in ((1, 1), (1, 0), (0, 1), (0, 0))]
            a, b = genepairs.unbiased_sums(*c)
            if b > 1e-9:
                n, num, den = n + 1, num + float(a), den + float(b)
        return n, num, den

    want = {}
    for u in units:
        own = sorted(k for k in at if k[:2] == u)
        for x, y in itertools.combinations(own, 2):
            key = ("within", (y[2] - x[2]) // 3)
            want.setdefault(key, []).append((x, y))
        for v in units:
            gap = abs(u[1] - v[1])
            if u[0] == v[0] and 1 <= gap <= 5:
                want.setdefault(("neighbour", gap), []).extend((x, y) for x in own for y in at if y[:2] == v)
    got = {(r["kind"], r["step"]): (r["n"], r["num"], r["den"]) for r in genepairs.linkage_curves(sites, seed=2).collect()}
    for key, pairs in want.items():
        assert got[key] == pytest.approx(pairs_sum(pairs)), key
    assert set(got) - set(want) == {("control", 0)}
    # drawn genes are all far, and there are as many as asked for
    drawn = genepairs.gene_partners(genepairs.polymorphic_genes(sites), seed=2).filter("kind = 'control'").collect()
    assert len(drawn) == 10 * len(units) and all(abs(int(r["gene_id"].rsplit(".", 1)[1]) - int(r["other"].rsplit(".", 1)[1])) > 5 for r in drawn)


@pytest.mark.parametrize("width", [1, 7, 1000])
def test_places(spark, width):
    rng = np.random.default_rng(13)
    rows = [(g, int(x)) for g in "ab" for x in rng.choice(500, 60, replace=False)]
    got = {(r["g"], r["x"]): r["place"] for r in places.placed(spark.createDataFrame(rows, "g string, x long"), ["g"], "x", width=width).collect()}
    assert got == {(g, x): sorted(v for h, v in rows if h == g).index(x) for g, x in rows}


@pytest.mark.parametrize("size,step", [(4, 2), (3, 3), (5, 1), (2, 5)])
def test_haplotype_windows(spark, size, step):
    rows = random_counts(14, sites=40, samples=5, species=1, gaps=0.4)
    g = {}
    for _, c, p, s, d, a in rows:
        if d and not 0.2 < a / d < 0.8:
            g.setdefault((c, p), {})[s] = "1" if a / d >= 0.8 else "0"
    want = {}
    for c in ("c0", "c1"):
        snvs = sorted(p for (x, p), v in g.items() if x == c and len(set(v.values())) == 2)
        for w in range(len(snvs)):
            inside = snvs[w * step : w * step + size]
            if len(inside) == size:
                for s in {s for p in inside for s in g[c, p]}:
                    want[c, w, s] = (inside[0], inside[-1], "".join(g[c, p].get(s, "N") for p in inside))
    got = {(r["contig"], r["window"], r["sample"]): (r["first_pos"], r["last_pos"], r["haplotype"]) for r in haplowindows.window_haplotypes(spark.createDataFrame(rows, COUNTS), size, step).collect()}
    assert got == want and any("N" in v[2] for v in want.values())


@pytest.mark.parametrize("most", [0, 1, 2, 3])
@pytest.mark.parametrize("unknown", [0.0, 0.1, 0.4])
def test_clumps_by_index_are_those_of_a_plain_loop(most, unknown):
    rng = np.random.default_rng(15)
    for _ in range(30):
        names = list({"".join(rng.choice(list("01N"), 8, p=[0.5 - unknown / 2, 0.5 - unknown / 2, unknown])) for _ in range(40)})
        sizes = rng.integers(1, 6, len(names)).tolist()
        held, got = haplowindows.Clumps(8, most), {}
        for name, n in sorted(zip(names, sizes, strict=True), key=lambda x: (-x[1], x[0])):
            k = held.add(name)
            size, members = got.get(k, (0, 0))
            got[k] = (size + n, members + 1)
        assert [(held.names[k], *got[k]) for k in range(len(held.names))] == R.clump(names, sizes, most)


def test_clumped_windows_take_windows_in_batches(spark):
    rng = np.random.default_rng(8)
    rows = {}
    for w in range(60):
        for _ in range(int(rng.integers(1, 9))):
            rows["sp", "c", w, 10 * w, 10 * w + 9, "".join(rng.choice(list("01N"), 10, p=[0.4, 0.4, 0.2]))] = int(rng.integers(1, 4))
    schema = "species string, contig string, window bigint, first_pos bigint, last_pos bigint, haplotype string, n bigint"
    got = haplowindows.clumped_windows(spark.createDataFrame([(*k, n) for k, n in rows.items()], schema), 2)
    want = []
    for w in range(60):
        clumps = haplowindows.Clumps(10, 2)
        made = [(clumps.add(h), n) for n, h in sorted(((n, k[5]) for k, n in rows.items() if k[2] == w), key=lambda x: (-x[0], x[1]))]
        want += [("sp", "c", w, 10 * w, 10 * w + 9, name, sum(n for i, n in made if i == k), sum(i == k for i, _ in made)) for k, name in enumerate(clumps.names)]
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert "FlatMapGroupsInPandas" not in got._jdf.queryExecution().optimizedPlan().toString()
