"""Running sums, ranks and tests over ranges against plain loops."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lociweave.functions import kernels as K
from lociweave.operators import inference, ranks


def table(seed=3, n=3000):
    rnd = random.Random(seed)
    rows = []
    for _ in range(n):
        g = rnd.choice(["hot"] * 8 + ["b", None, "c"])
        v = None if rnd.random() < 0.02 else rnd.choice([7.0, rnd.randrange(40) / 4, rnd.gauss(0, 1)])
        rows.append((g, v, rnd.choice(["x", "y", "z"]), rnd.randrange(9)))
    return [*rows, ("one", 1.0, "x", 1)]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(table(), "g string, v double, side string, w int").repartition(7)


@pytest.mark.parametrize("ranges", [2, 64])
def test_running_sums(rows, ranges):
    counts = rows.groupBy("g", "v").agg(F.count(F.lit(1)).alias("n"))
    got = {(r["g"], r["v"]): (r["n"], r["before_n"], r["all_n"]) for r in ranks.running(counts, ["g"], "v", ["n"], ranges).collect()}
    flat = [(g, -math.inf if v is None else v) for g, v, _, _ in table()]
    assert len(got) == len(set(flat))
    for (g, v), (n, before, every) in got.items():
        own = [x for h, x in flat if h == g]
        at = -math.inf if v is None else v
        assert (n, before, every) == (own.count(at), sum(x < at for x in own), len(own))


def test_running_sums_of_text_and_of_nothing(spark, rows):
    names = ["", "a", "ab", "sample-1", "sample-10", "sample-2", "ä", "z" * 9, "z" * 8]
    df = spark.createDataFrame([(s, i) for i, s in enumerate(names)], "s string, n int").withColumn("k", F.lit("k"))
    got = {r["s"]: r["before_n"] for r in ranks.running(df, ["k"], "s", ["n"], 4).collect()}
    assert got == {s: sum(i for i, t in enumerate(names) if t.encode() < s.encode()) for s in names}
    assert ranks.running(df.limit(0), ["k"], "s", ["n"]).count() == 0
    assert ranks.rank_sum_tests(rows.limit(0), "side", "v", ["g"]).count() == 0


def test_rank_correlation(rows):
    got = {r["g"]: (r["rho"], r["n"]) for r in ranks.rank_correlation(rows, "v", "w", ["g"]).collect()}
    for g in {r[0] for r in table()}:
        own = [(-math.inf if v is None else v, w) for h, v, _, w in table() if h == g]
        x, y = (K.ranks(np.array(c, float)) for c in zip(*own, strict=True))
        assert got[g][1] == len(own)
        if len(own) > 1:
            assert got[g][0] == pytest.approx(np.corrcoef(x, y)[0, 1], abs=1e-12)
        else:
            assert got[g][0] is None


def test_rank_sum_tests(rows):
    got = {(r["g"], r["group_1"], r["group_2"]): (r["u"], r["pvalue"]) for r in ranks.rank_sum_tests(rows, "side", "v", ["g"]).collect()}
    assert len(got) == 4 * 3
    for (g, a, b), (u, p) in got.items():
        x, y = (np.array([v for h, v, s, _ in table() if h == g and s == side and v is not None]) for side in (a, b))
        assert u == sum((x > k).sum() + (x == k).sum() / 2 for k in y)
        assert p == pytest.approx(K.rank_sum(x, y), abs=5e-7)


def test_rank_sum_of_equal_values(spark):
    df = spark.createDataFrame([("k", s, 1.0) for s in "aabbb"], "g string, side string, v double")
    assert [tuple(r) for r in ranks.rank_sum_tests(df, "side", "v", ["g"]).collect()] == [("k", "a", "b", 3.0, 1.0)]


def test_anova_of_cells_is_that_of_rows(rows):
    t = [(v, s, w) for h, v, s, w in table() if h == "hot" and v is not None]
    want = K.sequential_anova(np.array([v for v, _, _ in t]), [np.array([s for _, s, _ in t]), np.array([w for _, _, w in t])])
    got = {r["factor"]: r for r in inference.sequential_anova(rows.filter("g = 'hot'"), ["g"], "v", ["side", "w"]).collect()}
    for (df, ss, f, p), name in zip(want, ("side", "w", "residual"), strict=True):
        r = got[name]
        assert r["df"] == df and r["sum_sq"] == pytest.approx(ss, rel=1e-9)
        if name != "residual":
            assert r["f"] == pytest.approx(f, rel=1e-9) and r["pvalue"] == pytest.approx(p, rel=1e-6)
