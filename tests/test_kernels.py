"""Kernels against hand-computed values and independent sums."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lociweave.functions import kernels as K


def test_binomial_tail():
    assert K.binomial_tail(2, 20, 0.01) == pytest.approx(0.0168593, abs=1e-7)
    assert K.polymorphic_pvalue(2, 20) < 0.05 < K.polymorphic_pvalue(1, 20)


def test_trajectory():
    assert K.trajectory_lrt([0, 10], [50, 50]) == pytest.approx(21.4335941, abs=1e-6)
    assert K.trajectory_lrt([1, 0], [50, 50]) == 0
    assert K.trajectory_lrt([0, 0], [0, 0]) == 0
    assert K.trajectory_pvalue([0, 10], [50, 50], 1, draws=200) <= 2 / 201
    assert K.trajectory_pvalue([0, 0], [50, 50], 1) == 1


@given(st.integers(0, 30), st.floats(0.1, 20))
@settings(max_examples=30, deadline=None)
def test_gamma_matches_poisson(k, mean):
    assert K.poisson_cdf(k, mean) == pytest.approx(1 - K.gamma_p(k + 1, mean), abs=1e-9)


@given(st.integers(1, 15), st.integers(1, 15), st.floats(0.02, 0.98))
@settings(max_examples=30, deadline=None)
def test_beta_matches_binomial(a, b, x):
    assert K.beta_inc(a, b, x) == pytest.approx(K.binomial_tail(a, a + b - 1, x), abs=1e-9)


def test_rate_interval():
    low, high = K.poisson_rate_interval(0, 10)
    assert low == 0 and high == pytest.approx(-math.log(0.25) / 10, abs=1e-9)


def test_upgma():
    d = np.array([[0, 1, 4, 6], [1, 0, 4, 6], [4, 4, 0, 6], [6, 6, 6, 0]], float)
    m = K.upgma(d)
    assert [x[2] for x in m] == [1, 4, 6]
    assert K.cut_tree(m, 4, 2).tolist() == [0, 0, 1, 2]
    assert K.cut_tree(m, 4, 10).tolist() == [0, 0, 0, 0]


def test_snv_distance():
    f, d = np.array([[0.5], [0.3]]), np.array([[10.0], [10.0]])
    assert K.snv_distances(f, d)[0, 1] == pytest.approx(1.6666667, abs=1e-6)


def test_strain_clusters_finds_two_strains():
    rng = np.random.default_rng(0)
    a, b = np.array([0.2, 0.8, 0.5, 0.3]), np.array([0.6, 0.1, 0.9, 0.4])
    f = np.vstack([np.clip(x + rng.normal(0, 0.01, 4), 0, 1) for x in [a] * 30 + [1 - a] * 10 + [b] * 25])
    group, flip = K.strain_clusters(f, np.full(f.shape, 50.0), near=0.5)
    assert len(set(group[:40])) == 1 and len(set(group[40:])) == 1 and group[0] != group[-1]
    assert len(set(flip[:30])) == 1 and len(set(flip[30:40])) == 1 and flip[0] != flip[30]


def test_smoothed_spectrum_peaks_at_the_truth():
    rng = np.random.default_rng(1)
    depth = np.full(400, 60)
    alt = rng.binomial(60, np.where(np.arange(400) % 2, 0.2, 0.7))
    p = K.smoothed_spectrum(depth, alt, np.ones(400))
    fs = np.arange(1, 100) / 100
    assert p.sum() == pytest.approx(1) and p[np.abs(fs - 0.2) < 0.06].sum() > 0.4 and p[np.abs(fs - 0.7) < 0.06].sum() > 0.4


def test_tests():
    assert K.signed_rank(np.array([1.0, 2, 3, 4, 5])) == pytest.approx(2 / 32)
    assert K.fisher_exact(3, 1, 1, 3) == pytest.approx(0.4857143, abs=1e-6)
    assert K.rank_sum(np.arange(20.0), np.arange(20.0)) > 0.9
    assert K.rank_sum(np.arange(20.0), np.arange(20.0) + 30) < 1e-6
    assert K.f_tail(4.964603, 1, 10) == pytest.approx(0.05, abs=1e-6)
    y = np.array([1.0, 2, 3, 4, 5, 6])
    (df, ss, f, p), (rdf, rss, _, _) = K.sequential_anova(y, [np.array([0, 0, 0, 1, 1, 1])])
    assert (df, rdf) == (1, 4) and ss == pytest.approx(13.5) and rss == pytest.approx(4) and f == pytest.approx(13.5)


def test_mds_keeps_distances():
    x = np.array([[0, 0], [3, 0], [0, 4.0]])
    d = np.linalg.norm(x[:, None] - x, axis=2)
    y, share = K.classical_mds(d)
    assert np.allclose(np.linalg.norm(y[:, None] - y, axis=2), d) and share.sum() == pytest.approx(1)


@pytest.mark.parametrize("n", [1, 2, 6, 12, 40])
def test_signed_rank_interval_is_what_the_test_does_not_reject(n):
    rng = np.random.default_rng(n)
    x = rng.normal(0.4, 1, n)
    estimate, low, high = K.signed_rank_interval(x)
    assert low <= estimate <= high
    if n >= 6:
        wide = K.signed_rank(x - (low - 0.05)) , K.signed_rank(x - (high + 0.05))
        assert max(wide) < 0.06 and K.signed_rank(x - (low + high) / 2) > 0.05
    else:
        i, j = np.triu_indices(n)
        assert (low, high) == (x.min(), x.max())


def test_inverse_erfc():
    for y in (1.0, 0.5, 0.05, 1e-6):
        assert math.erfc(K.inverse_erfc(y)) == pytest.approx(y, rel=1e-9)


def test_trajectory_draws_that_cannot_gain_are_not_carried_out(monkeypatch):
    rng = np.random.default_rng(2)
    depths = rng.integers(10, 60, (400, 8))
    alts = rng.binomial(depths, rng.choice([0.01, 0.03, 0.08], (400, 1)))
    alts[:40] = depths[:40] // 2
    whole = K.trajectory_gains

    def plain(a, d, seed, draws):
        p, r = min(a.sum() / d.sum(), K.ERROR), np.random.default_rng(seed)
        return ((whole(r.binomial(d, p, size=(draws, len(d))), d) >= whole(a, d)[0]).sum() + 1) / (draws + 1)

    carried = []
    monkeypatch.setattr(K, "trajectory_gains", lambda a, d, *x: carried.append(len(np.atleast_2d(a))) or whole(a, d, *x))
    got = K.trajectory_pvalues(alts, depths, np.arange(400), draws=4000, enough=4000)
    assert sum(carried) < 400 * 4000 / 2
    want = np.array([plain(a, d, 7 + k, 4000) if whole(a, d)[0] > 0 else 1.0 for k, (a, d) in enumerate(zip(alts, depths, strict=True))])
    sd = np.sqrt(2 * np.maximum(want, 1 / 4000) * (1 - want) / 4000)
    assert (np.abs(got - want) <= 5 * sd + 3 / 4001).all() and abs(((got - want) / (sd + 1e-9)).mean()) < 0.3
    assert (got[:40] == 1 / 4001).all()


def test_trajectory_no_draw_below_the_least_errors_gains_as_much():
    rng = np.random.default_rng(3)
    for _ in range(200):
        depths = rng.integers(1, 40, 5)
        drawn = rng.binomial(depths, rng.choice([0.02, 0.1, 0.4]), size=(50, 5))
        gains = K.trajectory_gains(drawn, depths)
        assert (drawn.sum(1) >= K._least_errors(gains, depths.sum())).all()
