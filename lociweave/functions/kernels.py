"""Numerical kernels in numpy: distributions, tests, clustering, mixtures."""

from __future__ import annotations

import math

import numpy as np

# distributions ---------------------------------------------------------------

_LN_FACTORIAL = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, 1 << 16)))])


def ln_factorial(n: np.ndarray) -> np.ndarray:
    n = np.asarray(n, dtype=np.int64)
    big = n >= len(_LN_FACTORIAL)
    out = _LN_FACTORIAL[np.minimum(n, len(_LN_FACTORIAL) - 1)]
    return np.where(big, np.vectorize(math.lgamma, otypes=[float])(n + 1.0), out) if big.any() else out


def binomial_pmf(k: np.ndarray, n: int, p: float) -> np.ndarray:
    k = np.asarray(k)
    if p <= 0 or p >= 1:
        return (k == (0 if p <= 0 else n)).astype(float)
    return np.exp(ln_factorial(n) - ln_factorial(k) - ln_factorial(n - k) + k * math.log(p) + (n - k) * math.log1p(-p))


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X >= k)."""
    return 1.0 if k <= 0 else float(min(1.0, binomial_pmf(np.arange(k, n + 1), n, p).sum())) if k <= n else 0.0


def poisson_cdf(k: int, mean: float) -> float:
    if k < 0:
        return 0.0
    if mean <= 0:
        return 1.0
    i = np.arange(k + 1)
    return float(min(1.0, np.exp(i * math.log(mean) - mean - ln_factorial(i)).sum()))


def gamma_p(a: float, x: float) -> float:
    """Regularised lower incomplete gamma function, by its series or continued fraction."""
    if x <= 0:
        return 0.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-15:
            n += 1
            term *= x / n
            total += term
        return total * front
    b, c, d = x + 1 - a, 1e300, 1 / (x + 1 - a)
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d, c = 1 / (an * d + b or 1e-300), b + an / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return 1 - front * h


def gamma_quantile(q: float, a: float) -> float:
    low, high = 0.0, max(1.0, a)
    while gamma_p(a, high) < q:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if gamma_p(a, mid) < q else (low, mid)
    return (low + high) / 2


def poisson_rate_interval(n: int, size: float, alpha: float = 0.5) -> tuple[float, float]:
    """Central interval of a rate with ``n`` events seen in ``size``."""
    low = 0.0 if n <= 0 else gamma_quantile(alpha / 2, n) / size
    return low, gamma_quantile(1 - alpha / 2, n + 1) / size


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_inc(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    f = c = 1.0
    d = 0.0
    for i in range(10_000):
        m = i // 2
        if i == 0:
            t = 1.0
        elif i % 2 == 0:
            t = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            t = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / (1 + t * d or 1e-300)
        c = 1 + t / c or 1e-300
        f *= c * d
        if i and abs(c * d - 1) < 1e-15:
            break
    return front * (f - 1)


def f_tail(x: float, d1: float, d2: float) -> float:
    return 1.0 if x <= 0 else beta_inc(d2 / 2, d1 / 2, d2 / (d2 + d1 * x))


def normal_tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


# sites ------------------------------------------------------------------------

ERROR = 0.01


def polymorphic_pvalue(alt: int, depth: int) -> float:
    """Chance of at least the minor reads from errors alone."""
    return binomial_tail(min(alt, depth - alt), depth, ERROR)


def alt_threshold(depth: int, least: int = 2, pvalue: float = 0.05) -> int:
    """The least number of alternate reads that errors exceed with at most ``pvalue``."""
    cdf = np.cumsum(binomial_pmf(np.arange(depth + 1), depth, ERROR))
    return max(least, int(np.searchsorted(1 - cdf <= pvalue, True)))


def trajectory_gains(alts: np.ndarray, depths: np.ndarray, cap: float = ERROR) -> np.ndarray:
    """For each row of ``alts``, the log-likelihood gain of a frequency of its own for every sample outside the band that noise explains; ``depths`` is one row for all or one for each."""
    alts, depths = np.atleast_2d(np.asarray(alts, float)), np.asarray(depths, float)
    p = np.minimum(alts.sum(1) / np.maximum(depths.sum(-1), 1), cap)[:, None]
    mean, sd = depths * p, np.sqrt(depths * p * (1 - p))
    low = np.maximum(0, np.minimum(np.floor(mean) - 0.5, mean - sd))
    high = np.minimum(depths, np.maximum(np.ceil(mean) + 0.5, mean + sd))
    out = (p > 0) & (depths > 0) & ((alts < low) | (alts > high))
    with np.errstate(divide="ignore", invalid="ignore"):
        f = alts / depths
        gain = np.where(f > 0, alts * np.log(f / p), 0) + np.where(f < 1, (depths - alts) * np.log((1 - f) / (1 - p)), 0)
    return np.where(out, gain, 0).sum(1)


def trajectory_lrt(alts: np.ndarray, depths: np.ndarray) -> float:
    return float(trajectory_gains(alts, depths)[0])


def _least_errors(seen: np.ndarray, total: np.ndarray, cap: float = ERROR) -> np.ndarray:
    """No trajectory of ``total`` reads with fewer alternate ones gains ``seen``; 0 where that says nothing.

    A gain is at most what a frequency of ``cap`` loses against certainty on each read,
    ``-e ln cap - (total - e) ln(1 - cap)``, once e reaches ``cap`` of the reads.
    """
    e = np.ceil((seen * (1 - 1e-9) + total * math.log1p(-cap)) / math.log((1 - cap) / cap) - 1e-9)
    return np.where(e >= cap * total, e, 0).astype(np.int64)


def trajectory_pvalue(alts: np.ndarray, depths: np.ndarray, seed: int, draws: int = 10_000, enough: int = 100, some: float | None = None) -> float:
    """(k + 1) / (n + 1) for the share of simulated trajectories that gain as much; stops once more than ``enough`` do.

    Of the ``draws`` only those are carried out that have enough alternate reads to gain as
    much. How many these are is drawn first, then the reads of each, so k is distributed
    as if all were. With ``some``, there is such a draw with that chance.
    """
    alts, depths = np.asarray(alts), np.asarray(depths, dtype=np.int64)
    seen = trajectory_lrt(alts, depths)
    if seen <= 0:
        return 1.0
    total = int(depths.sum())
    p = min(alts.sum() / total, ERROR)
    rng, hits, n = np.random.default_rng(seed), 0, 0
    least = int(_least_errors(seen, total))
    pmf = binomial_pmf(np.arange(least, total + 1), total, p)
    q = float(min(pmf.sum(), 1.0)) if least else 1.0
    if q <= 0:
        return 1 / (draws + 1)
    if some is None:
        left = int(rng.binomial(draws, q))
    else:
        # the first such draw, and those after it
        first = math.ceil(math.log1p(rng.random() * math.expm1(draws * math.log1p(-q))) / math.log1p(-q)) if rng.random() < some else draws + 1
        left = 1 + int(rng.binomial(draws - max(first, 1), q)) if first <= draws else 0
    if not left:
        return 1 / (draws + 1)
    cdf = np.cumsum(pmf) / pmf.sum()
    while n < draws and hits <= enough:
        # too few are left to stop early
        size = draws - n if least and hits + left <= enough else min(500, draws - n)
        if least:
            now = int(rng.hypergeometric(left, draws - n - left, size))
            reads, times = np.unique(least + np.searchsorted(cdf, rng.random(now), side="right").clip(max=len(cdf) - 1), return_counts=True)
            drawn = [rng.multivariate_hypergeometric(depths, int(e), size=int(k), method="marginals") for e, k in zip(reads, times, strict=True)]
            drawn, left = np.concatenate(drawn) if drawn else np.zeros((0, len(depths))), left - now
        else:
            drawn = rng.binomial(depths, p, size=(size, len(depths)))
        hits += int((trajectory_gains(drawn, depths) >= seen).sum()) if len(drawn) else 0
        n += size
    return (hits + 1) / (n + 1)


def trajectory_pvalues(alts: np.ndarray, depths: np.ndarray, seeds: np.ndarray, draws: int = 10_000, enough: int = 100) -> np.ndarray:
    """``trajectory_pvalue`` of each row.

    Where a bound on the chance of any draw with enough alternate reads is small, a uniform
    number of the seed says whether there can be one; if so, or if it is not small, the row
    is simulated.
    """
    seen, total = trajectory_gains(alts, depths), depths.sum(1)
    out = np.where(seen > 0, 1 / (draws + 1), 1.0)
    p, least = np.minimum(alts.sum(1) / np.maximum(total, 1), ERROR), _least_errors(seen, total)
    f = np.minimum(least / np.maximum(total, 1), 1 - 1e-12)
    with np.errstate(divide="ignore", invalid="ignore"):
        bound = draws * np.exp(-total * (np.where(f > 0, f * np.log(f / p), 0) + (1 - f) * np.log((1 - f) / (1 - p))))
    bound = np.where(least > total, 0.0, np.where(f > p, bound, draws))
    x = seeds.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    uniform = ((x ^ (x >> np.uint64(31))) >> np.uint64(11)) * 2.0**-53
    rare = bound <= 0.01
    for k in np.flatnonzero((seen > 0) & ~(rare & (uniform >= bound))):
        some = None
        if rare[k]:
            q = binomial_tail(int(least[k]), int(total[k]), float(p[k]))
            some = -math.expm1(draws * math.log1p(-q)) / bound[k]
        out[k] = trajectory_pvalue(alts[k], depths[k], int(seeds[k]), draws, enough, some)
    return out


def fixation_parts(depths: np.ndarray, alts: np.ndarray, n: np.ndarray, lower: float = 0.2, upper: float = 0.8, bins: int = 20) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of one sample, for true frequencies on ``bins`` bins: sites there, and the chances to read low and high at its depths."""
    mids = (np.arange(bins) + 0.5) / bins
    prior = np.bincount(np.minimum(bins * alts // np.maximum(depths, 1), bins - 1).astype(int), weights=n, minlength=bins)
    each, at = np.unique(depths, return_inverse=True)
    share = np.bincount(at, weights=n) / (n.sum() or 1)
    low, high = np.zeros(bins), np.zeros(bins)
    for d, w in zip(each.tolist(), share.tolist(), strict=True):
        k = np.arange(d + 1)
        for i, f in enumerate(mids):
            pmf = binomial_pmf(k, d, f)
            low[i] += w * pmf[k <= lower * d].sum()
            high[i] += w * pmf[k >= upper * d].sum()
    return prior, low, high


def fixation_error(hist_1: dict, hist_2: dict, lower: float = 0.2, upper: float = 0.8, bins: int = 20) -> float:
    """Expected false flips: two samples of one true frequency, read low in one and high in the other.

    ``hist``: (depth, alt) to number of sites, whose frequencies are the prior.
    """
    both = [h for h in (hist_1, hist_2) if h]
    made = []
    for h in (hist_1, hist_2):
        cells = np.array([(d, a) for d, a in h], dtype=np.int64).reshape(-1, 2)
        made.append(fixation_parts(cells[:, 0], cells[:, 1], np.array(list(h.values()), float), lower, upper, bins))
    (p1, l1, h1), (p2, l2, h2) = made
    return float(((p1 + p2) / max(len(both), 1) * (l1 * h2 + h1 * l2)).sum())


def gene_error(reads_1: float, copies_1: float, reads_2: float, copies_2: float, absent: float = 0.05, low: float = 0.6, high: float = 1.2) -> float:
    """Chance that reading noise turns a normal gene absent in one of two samples; reads scale with copies."""

    def one(reads: float, copies: float) -> tuple[float, float]:
        unit = reads / copies if copies > 0 else 0.0
        return poisson_cdf(int(absent * unit), unit), poisson_cdf(int(high * unit), unit) - poisson_cdf(math.ceil(low * unit) - 1, unit)

    (a1, n1), (a2, n2) = one(reads_1, copies_1), one(reads_2, copies_2)
    return a1 * n2 + n1 * a2


# spectra ------------------------------------------------------------------------


def smoothed_spectrum(depths: np.ndarray, alts: np.ndarray, weights: np.ndarray, rounds: int = 100, grid: int = 99) -> np.ndarray:
    """Mixture weights of allele frequencies 1/(grid+1) ... by expectation maximisation."""
    fs = np.arange(1, grid + 1) / (grid + 1)
    lik = np.stack([np.exp(alts * math.log(f) + (depths - alts) * math.log1p(-f) + ln_factorial(depths) - ln_factorial(alts) - ln_factorial(depths - alts)) for f in fs], axis=1)
    p = np.full(grid, 1 / grid)
    for _ in range(rounds):
        post = lik * p
        post /= post.sum(1, keepdims=True) + 1e-300
        p = weights @ post
        p /= p.sum()
    return p


# clustering ------------------------------------------------------------------------


def upgma(d: np.ndarray) -> list[tuple[int, int, float, int]]:
    """Merges (a, b, height, size) of average linkage; ties go to the smallest indexes."""
    n = len(d)
    d = d.astype(float).copy()
    np.fill_diagonal(d, np.inf)
    ids, sizes, out = list(range(n)), [1] * n, []
    while len(ids) > 1:
        at = int(np.argmin(d))
        i, j = sorted(divmod(at, len(ids)))
        h, si, sj = d[i, j], sizes[i], sizes[j]
        a, b = sorted((ids[i], ids[j]))
        out.append((a, b, float(h), si + sj))
        row = (si * d[i] + sj * d[j]) / (si + sj)
        row[i] = np.inf
        d[i], d[:, i] = row, row
        ids[i], sizes[i] = n + len(out) - 1, si + sj
        d = np.delete(np.delete(d, j, 0), j, 1)
        del ids[j], sizes[j]
    return out


def cut_tree(merges: list[tuple[int, int, float, int]], n: int, height: float) -> np.ndarray:
    """Cluster of each leaf under ``height``, numbered by size, then by first leaf."""
    parent = list(range(n + len(merges)))

    def root(x: int) -> int:
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (a, b, h, _) in enumerate(merges):
        if h <= height:
            parent[root(a)] = parent[root(b)] = n + k
    roots = [root(i) for i in range(n)]
    order = sorted(set(roots), key=lambda r: (-roots.count(r), roots.index(r)))
    return np.array([order.index(r) for r in roots])


def _distances_from(f: np.ndarray, d: np.ndarray, k: int, flip: bool, first: int = 0) -> np.ndarray:
    """Coverage-weighted distance of SNV ``k`` to every SNV (row) from ``first`` on over samples, its frequency flipped on demand. It is the same both ways."""
    own = 1 - f[k] if flip else f[k]
    s = own + f[first:]
    with np.errstate(divide="ignore", invalid="ignore"):
        v = (d[k] + d[first:]) * (own - f[first:]) ** 2 / (s * (2 - s))
        known = np.isfinite(v)
        return 2 * np.where(known, v, 0).sum(axis=1) / known.sum(axis=1)


def snv_distances(f: np.ndarray, d: np.ndarray, flip: bool = False) -> np.ndarray:
    """``_distances_from`` every SNV."""
    return np.array([_distances_from(f, d, k, flip) for k in range(len(f))]).reshape(len(f), len(f))


def strain_clusters(f: np.ndarray, d: np.ndarray, near: float = 3.5, share: float = 0.25, least: int = 10, most: int = 10) -> tuple[np.ndarray, np.ndarray]:
    """(cluster or -1, flipped) of each SNV: densest seed first, members near the seed and near a ``share`` of its group.

    The largest index wins among equally dense seeds. Of the distances only what is
    near and what is nearer when flipped is kept, a bit each in a byte.
    """
    n = len(f)
    close_by, turned = np.zeros((n, n), dtype=bool), np.zeros((n, n), dtype=bool)
    with np.errstate(invalid="ignore"):
        for k in range(n):
            forward, back = _distances_from(f, d, k, False, k), _distances_from(f, d, k, True, k)
            close_by[k, k:] = close_by[k:, k] = np.fmin(forward, back) < near
            turned[k, k:] = turned[k:, k] = back < forward
    free, cluster, flipped = np.ones(n, bool), np.full(n, -1), np.zeros(n, bool)
    for k in range(most if n else 0):
        close = close_by & free & free[:, None]
        degree = close.sum(1)
        seed = int(n - 1 - np.argmax(degree[::-1]))
        group = np.flatnonzero(close[seed])
        if len(group) < least:
            break
        group = group[close[np.ix_(group, group)].mean(1) > share]
        cluster[group] = k
        flipped[group] = turned[seed, group]
        free[group] = False
    return cluster, flipped


def principal_axes(cov: np.ndarray, k: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """(coordinates, shares of variance), each axis with its largest entry positive."""
    w, v = np.linalg.eigh((cov + cov.T) / 2)
    w, v = w[::-1][:k], v[:, ::-1][:, :k]
    v = v * np.sign(v[np.abs(v).argmax(0), np.arange(v.shape[1])])
    return v * np.sqrt(np.maximum(w, 0)), w / np.maximum(np.trace(cov), 1e-300)


def classical_mds(d: np.ndarray, k: int = 2) -> tuple[np.ndarray, np.ndarray]:
    n = len(d)
    j = np.eye(n) - 1 / n
    return principal_axes(-0.5 * j @ (d**2) @ j, k)


# tests ------------------------------------------------------------------------


def ranks(x: np.ndarray) -> np.ndarray:
    _, inv, n = np.unique(x, return_inverse=True, return_counts=True)
    ends = np.cumsum(n)
    return (ends - (n - 1) / 2)[inv]


def rank_sum(x: np.ndarray, y: np.ndarray) -> float:
    """Two-sided p of the rank-sum test by the normal law with tie and continuity corrections."""
    both = np.concatenate([x, y])
    r, n, m = ranks(both), len(x), len(y)
    u = r[:n].sum() - n * (n + 1) / 2
    _, t = np.unique(both, return_counts=True)
    var = n * m / 12 * (n + m + 1 - ((t**3 - t).sum()) / max((n + m) * (n + m - 1), 1))
    return 1.0 if var <= 0 else min(1.0, 2 * normal_tail(max(abs(u - n * m / 2) - 0.5, 0) / math.sqrt(var)))


def signed_rank(x: np.ndarray) -> float:
    """Two-sided p of the signed-rank test against 0, exact up to 25 values without ties."""
    x = x[x != 0]
    n = len(x)
    if not n:
        return 1.0
    r = ranks(np.abs(x))
    w = r[x > 0].sum()
    if n <= 25 and len(np.unique(np.abs(x))) == n:
        ways = np.zeros(n * (n + 1) // 2 + 1)
        ways[0] = 1
        for k in range(1, n + 1):
            ways[k:] = ways[k:] + ways[: len(ways) - k]
        w = int(min(w, n * (n + 1) / 2 - w))
        return min(1.0, 2 * ways[: w + 1].sum() / 2.0**n)
    _, t = np.unique(np.abs(x), return_counts=True)
    var = n * (n + 1) * (2 * n + 1) / 24 - (t**3 - t).sum() / 48
    return min(1.0, 2 * normal_tail(max(abs(w - n * (n + 1) / 4) - 0.5, 0) / math.sqrt(var)))


def signed_rank_interval(x: np.ndarray, level: float = 0.95) -> tuple[float, float, float]:
    """(estimate, lower, upper) of the centre that the signed-rank test goes with: the median of the means of all pairs, and the pairs' means that it cannot reject.

    Exact up to 25 values, by the normal law beyond; an interval that so few values cannot give is that of all means.
    """
    n = len(x)
    if not n:
        return (float("nan"),) * 3
    i, j = np.triu_indices(n)
    means = np.sort((x[i] + x[j]) / 2)
    half = (1 - level) / 2
    if n <= 25:
        ways = np.zeros(n * (n + 1) // 2 + 1)
        ways[0] = 1
        for k in range(1, n + 1):
            ways[k:] = ways[k:] + ways[: len(ways) - k]
        cut = int(np.searchsorted(np.cumsum(ways) / 2.0**n, half, side="right"))
    else:
        z = 2**0.5 * inverse_erfc(2 * half)
        cut = math.floor(n * (n + 1) / 4 - z * math.sqrt(n * (n + 1) * (2 * n + 1) / 24))
    cut = min(max(cut, 1), (len(means) + 1) // 2)
    return float(np.median(means)), float(means[cut - 1]), float(means[-cut])


def inverse_erfc(y: float) -> float:
    """x with erfc(x) = y for y in (0, 1], by halving."""
    low, high = 0.0, 30.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if math.erfc(mid) > y else (low, mid)
    return (low + high) / 2


def fisher_exact(a: int, b: int, c: int, d: int) -> float:
    """Two-sided p of a 2x2 table: all tables at most as likely."""
    k = np.arange(max(0, a + b - (b + d)), min(a + b, a + c) + 1)
    ln = lambda x: ln_factorial(np.asarray(x))
    p = np.exp(ln(a + b) + ln(c + d) + ln(a + c) + ln(b + d) - ln(a + b + c + d) - ln(k) - ln(a + b - k) - ln(a + c - k) - ln(d - a + k))
    return float(min(1.0, p[p <= p[k == a][0] * (1 + 1e-7)].sum()))


def sequential_anova(y: np.ndarray, factors: list[np.ndarray], n: np.ndarray | None = None, within: float = 0.0) -> list[tuple[int, float, float, float]]:
    """(df, sum of squares, F, p) of each factor added in turn, then of the residual (F and p nan).

    With ``n``, each y is the mean of so many values of one cell of the factors, and
    ``within`` their squared distances from these means.
    """
    n = np.ones(len(y)) if n is None else np.asarray(n, float)
    w = np.sqrt(n)[:, None]
    x, rank, rows = np.ones((len(y), 1)), 1, []
    before = float((n * (y - np.average(y, weights=n)) ** 2).sum()) + within
    for f in factors:
        levels = np.unique(f)
        x = np.hstack([x, (f[:, None] == levels[1:]).astype(float)])
        fit, _, new, _ = np.linalg.lstsq(x * w, y * w[:, 0], rcond=None)
        after = float((n * (y - x @ fit) ** 2).sum()) + within
        rows.append((int(new) - rank, before - after))
        before, rank = after, int(new)
    df = int(n.sum()) - rank
    ms = before / df if df > 0 else float("nan")
    out = [(k, s, s / k / ms if k and ms > 0 else float("nan")) for k, s in rows]
    return [(k, s, f, f_tail(f, k, df) if f == f else float("nan")) for k, s, f in out] + [(df, before, float("nan"), float("nan"))]


def bootstrap_mean(x: np.ndarray, seed: int | list[int], draws: int = 1000, size: int = 100) -> tuple[float, float]:
    """2.5 and 97.5 percentiles of means of ``size`` draws with replacement."""
    rng = np.random.default_rng(seed)
    return tuple(np.percentile(rng.choice(x, (draws, size)).mean(1), [2.5, 97.5]).tolist())


def permutation_pvalue(values: np.ndarray, labels: np.ndarray, seed: int, draws: int = 999) -> float:
    """(k + 1) / (n + 1) for the difference of two groups' means."""
    rng, on = np.random.default_rng(seed), labels == labels.max()
    gap = lambda m: abs(values[m].mean() - values[~m].mean())
    seen = gap(on)
    return (sum(gap(rng.permutation(on)) >= seen - 1e-12 for _ in range(draws)) + 1) / (draws + 1)
