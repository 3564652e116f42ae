"""Hand-computed cases and edge rows."""

import pytest
from pyspark.sql import functions as F

from lociweave.functions import expr
from lociweave.operators import changes, coverage, diversity, genes, linkage, pairs, snps
from lociweave.streaming import sites as streaming


def one(spark, column, **values):
    row = spark.range(1)
    for k, v in values.items():
        row = row.withColumn(k, F.lit(v))
    return row.select(column.alias("x")).first()["x"]


def counts(spark, rows):
    return spark.createDataFrame(rows, "species string, contig string, pos long, sample string, depth long, alt long")


@pytest.mark.parametrize("f,d,want", [(0.33, 10, 0.4666667), (0.29, 100, 0.4072727), (0.5, 1, None), (0.5, 0, None)])
def test_pi(spark, f, d, want):
    got = one(spark, expr.pi_unbiased(F.col("f"), F.col("d")), f=f, d=d)
    assert got == (want if want is None else pytest.approx(want, abs=1e-6))


def test_pi_regular_and_fst(spark):
    assert one(spark, expr.pi_regular(F.col("f")), f=0.33) == pytest.approx(0.4422)
    rows = counts(spark, [("s", "c", 1, "A", 10, 5), ("s", "c", 1, "B", 10, 8), ("s", "c", 2, "A", 10, 0), ("s", "c", 2, "B", 10, 0)])
    got = {r["pos"]: r for r in diversity.fst_loci(rows, "A", "B").collect()}
    assert got[1]["pi_within"] == pytest.approx(0.4555556, abs=1e-6) and got[1]["pi_between"] == pytest.approx(0.5)
    assert got[1]["fst"] == pytest.approx(0.0888889, abs=1e-6) and got[2]["fst"] == 0


@pytest.mark.parametrize("d,f,want", [(20, 0.05, False), (20, 0.1, True), (25, 0.1, True), (20, 0.0, True)])
def test_read_support(spark, d, f, want):
    assert one(spark, expr.supported(F.col("f"), F.col("d")), f=f, d=d) is want


@pytest.mark.parametrize("bins,want", [({0: 10, 3: 2, 5: 4, 9: 4}, 5), ({0: 90, 5: 10}, 0), ({7: 3}, 7)])
def test_nonzero_median(spark, bins, want):
    h = spark.createDataFrame([("x", d, n) for d, n in bins.items()], "g string, depth long, n long")
    assert coverage.nonzero_median(h, ["g"]).first()["median"] == want


def test_depth_window(spark):
    lo, hi = expr.depth_window(F.lit(5), 5)
    assert spark.range(1).select(lo.alias("a"), hi.alias("b")).first()[:] == (0.5, 15.5)


@pytest.mark.parametrize("d,limit", [(20, 1.5), (21, 2.5), (60, 3.5)])
def test_snp_call(spark, d, limit):
    assert float(one(spark, expr.snp_threshold(F.col("d")), d=d)) == limit


def test_prevalence(spark):
    r = snps.prevalence(counts(spark, [("s", "c", 1, "A", 10, 5), ("s", "c", 1, "B", 8, 0), ("s", "c", 1, "C", 10, 10)])).first()
    assert r["alt_freq"] == pytest.approx(2 / 3) and r["snp_freq"] == pytest.approx(2 / 3)


def test_spectrum(spark):
    rows = [("s", "x", "4D", 20, 10, 5), ("s", "x", "4D", 20, 0, 100), ("s", "x", "4D", 20, 20, 10)]
    sfs = spark.createDataFrame(rows, "species string, sample string, variant_type string, depth long, alt long, n long")
    r = snps.ploidy(sfs).first()
    assert (r["within"], r["between"], r["total"], r["haploid"]) == (5, 10, 115, False)
    assert snps.spectrum_pi(sfs).first()["pi"] == pytest.approx(0.0228833, abs=1e-6)


@pytest.mark.parametrize("a,b,want", [((100, 30), (20, 30), False), ((50, 30), (20, 30), True)])
def test_depth_ratio(spark, a, b, want):
    got = expr.depth_ratio_close(F.lit(a[0]), F.lit(float(a[1])), F.lit(b[0]), F.lit(float(b[1])))
    assert one(spark, got) is want


def test_opportunities_are_asymmetric(spark):
    got = {(r["sample_1"], r["sample_2"]) for r in changes.opportunities(counts(spark, [("s", "c", 1, "i", 5, 0), ("s", "c", 1, "j", 25, 25)])).collect()}
    assert got == {("i", "j")}


@pytest.mark.parametrize("hosts,want", [(4, [("H1", 4)]), (3, [])])
def test_private(spark, hosts, want):
    rows = counts(spark, [("s", "c", 1, f"S{k}", 10, 10 if k == 1 else 0) for k in range(1, hosts + 1)])
    who = spark.createDataFrame([(f"S{k}", f"H{k}") for k in range(1, hosts + 1)], "sample string, subject_id string")
    assert [(r["host"], r["n_hosts"]) for r in snps.private_snvs(rows, who).collect()] == want


def test_linkage(spark):
    p = spark.createDataFrame([("s", "g", 1, 2, 2.0, 0.0, 0.0, 2.0), ("s", "g", 1, 3, 1.0, 0.0, 0.0, 1.0)], "species string, gene_id string, pos_1 long, pos_2 long, n11 double, n10 double, n01 double, n00 double")
    (r,) = linkage.unbiased_sigma_squared(p).collect()
    assert r["num"] == pytest.approx(1 / 6) and r["den"] == pytest.approx(1 / 6)


def test_homozygosity(spark):
    c = spark.createDataFrame([("s", "g", "a", 3), ("s", "g", "b", 2), ("s", "g", "c", 1)], "species string, gene_id string, haplotype string, n long")
    r = linkage.homozygosity(c).first()
    assert (r["k"], r["h1"], r["h2"], r["h12"], r["h2_h1"]) == (3, pytest.approx(0.3888889, abs=1e-6), pytest.approx(0.1388889, abs=1e-6), pytest.approx(0.7222222, abs=1e-6), pytest.approx(0.3571429, abs=1e-6))


def test_gene_gain_and_bounds(spark):
    g = spark.createDataFrame([("s", "g", "A", 0.5, 20.0), ("s", "g", "B", 18.0, 20.0), ("s", "h", "A", 0.5, 20.0), ("s", "h", "B", 12.0, 20.0)], "species string, gene_id string, sample string, depth double, marker_coverage double")
    c = genes.copy_number(g.drop("marker_coverage"), g.select("species", "sample", "marker_coverage").distinct())
    assert [(r["gene_id"], r["kind"]) for r in genes.changed_genes(c).collect()] == [("g", "gain")]


def test_hamming_and_labels(spark):
    assert one(spark, expr.hamming(F.lit("ab"), F.lit("abc"))) == 1
    s = F.lit("M4CeG")
    got = spark.range(1).select(expr.mouse_number(s), expr.gut_site(s), expr.diet(s), expr.cage(s), expr.gut_region(expr.gut_site(s))).first()[:]
    assert got == ("4", "Cecum", "Guar gum diet", "Cage 2", "Lower gut")
    t = F.lit(expr.INOCULUM)
    assert spark.range(1).select(expr.mouse_number(t), expr.gut_site(t), expr.diet(t), expr.cage(t)).first()[:] == ("Inoculum", "Inoculum", "Human diet", "Inoculum")


def test_pairs(spark):
    s = spark.createDataFrame([("a", "H", "C", 1), ("b", "H", "C", 2), ("c", "H", "C", 5)], "sample string, subject_id string, cage string, ord long")
    assert sorted((r["sample_1"], r["sample_2"]) for r in pairs.consecutive(s).collect()) == [("a", "b"), ("b", "c")]
    assert [(r["sample_1"], r["sample_2"]) for r in pairs.longest(s).collect()] == [("a", "c")]


def test_median_cap(spark):
    rows = [("s", "c", 1, f"R{k}", d, 0) for k, d in enumerate((3, 3, 3, 4))] + [("s", "c", 1, "T", 25, 25)] + [("s", "c", 2, "R0", 10, 0), ("s", "c", 2, "T", 25, 25)]
    got = {(r["pos"], r["sample"]): (r["depth"], r["alt"]) for r in coverage.median_capped(counts(spark, rows), ["R0", "R1", "R2", "R3"], ["T"]).collect()}
    assert got[1, "T"] == (0, 0) and got[2, "T"] == (10, 10) and got[1, "R0"] == (3, 0)


def test_empty_tables(spark):
    none = counts(spark, [])
    for f in (coverage.depth_histogram, snps.prevalence, snps.called_sites, changes.flips, changes.opportunities, diversity.pooled_freqs, changes.singletons):
        assert f(none).count() == 0


def test_stream_equals_batch(spark, tmp_path):
    rows = [("s", "c", k % 3, "A", k % 2 == 0) for k in range(20)]
    df = spark.createDataFrame(rows, "species string, contig string, pos long, sample string, is_alt boolean")
    df.write.parquet(str(tmp_path / "in"))
    q = streaming.site_counts(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("sites").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    key = lambda d: sorted(map(tuple, d.collect()))
    assert key(spark.table("sites")) == key(streaming.site_counts(df))

def test_a_mean_of_one_half_turns_no_site_in_any_order(spark):
    import itertools

    from lociweave.operators import analyses

    # summed in some orders, their means are 0.5000000000000001
    sets = [q for f in ([0.4, 0.3, 0.8], [0.5, 5 / 6, 1 / 6]) for q in itertools.permutations(f)]
    rows = [("sp", "c", k, f"S{s}", f) for k, q in enumerate(sets) for s, f in enumerate(q)]
    rows += [("sp", "c", 99, "S1", 0.6), ("sp", "c", 99, "S2", 0.5)]
    got = analyses.repolarised(spark.createDataFrame(rows, "species string, contig string, pos bigint, sample string, f double").coalesce(1), "S99")
    assert {r["pos"] for r in got.filter("turned").collect()} == {99}


def test_sites_meet_the_clusters_without_a_shuffle_of_both(spark):
    from lociweave.operators import analyses

    sites = spark.createDataFrame([("sp", "c", k, f"S{s}", 0.1 + 0.8 * (k % 2), 20) for k in range(6) for s in range(3)], "species string, contig string, pos bigint, sample string, f double, depth bigint")
    centroids = spark.createDataFrame([("sp", k, f"S{s}", f, 20.0) for k, f in enumerate((0.12, 0.5)) for s in range(3)], "species string, cluster int, sample string, f double, depth double")
    got = analyses.assigned(sites, centroids)
    exchanges = [x for x in got._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning" in x]
    assert len(exchanges) == 1 and "cluster" not in exchanges[0]
    assert sorted(map(tuple, got.collect())) == [("sp", "c", k, 0, k % 2 == 1) for k in range(6)]
