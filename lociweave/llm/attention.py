"""A small causal self-attention model over subword ids, in numpy.

The ``PLACES - 1`` most frequent ids have a place of their own, all others share the
last one and then their smoothed relative frequency, so every id has a probability
and all sum to 1. Places are clustered into ``GROUPS`` groups by what stands before
them. The model predicts the group of the next place from the window; the place in
its group follows the place before it, by the counts of all pairs of neighbours in
the training texts. The same counts give each group's probability after each place,
to which the attention adds what it reads in the window.

A text is read in windows of ``WIDTH`` places that overlap by ``CONTEXT``: a window
scores its last ``WIDTH - CONTEXT`` ids, each id is scored once, and all windows of a
batch go through one masked attention.
"""

from __future__ import annotations

import numpy as np

PLACES = 2048
DIM = 16
HIDDEN = 48
GROUPS = 96
WIDTH = 32
CONTEXT = 8
STEP = WIDTH - CONTEXT
BATCH = 64
LOG10 = np.log(10.0)
#: Scores end here before their exponential, so no maximum has to be taken off.
TOP = np.float32(60)
#: What is taken off each pair's count and given to the frequencies of places.
DISCOUNT = 0.75

Params = dict[str, np.ndarray]
#: Only places behind the context ask; all places answer.
_SEEN = np.tril(np.ones((WIDTH, WIDTH), dtype=np.float32))[CONTEXT:]


def _clusters(pairs: np.ndarray, mass: np.ndarray, seed: int = 11) -> np.ndarray:
    """The group of each place: k-means over what stands before it; the last place is the last group alone."""
    own = len(mass) - 1
    seen = np.log1p(pairs[:, :own].T * (pairs.sum() / np.maximum(np.outer(pairs[:, :own].sum(0), pairs.sum(1)), 1.0)))
    rng = np.random.default_rng(seed)
    sketch = seen @ (seen.T @ rng.standard_normal((own, 48)))
    basis = np.linalg.qr(sketch)[0]
    u, s, _ = np.linalg.svd(basis.T @ seen, full_matrices=False)
    points = (basis @ u) * s
    points /= np.linalg.norm(points, axis=1, keepdims=True) + 1e-9
    weight = np.sqrt(mass[:own])
    k = min(GROUPS - 1, own)
    centres = points[np.argsort(-mass[:own], kind="stable")[:k]].copy()
    group = np.zeros(own, dtype=np.int64)
    for _ in range(20):
        group = np.argmax(points @ centres.T, axis=1)
        for g in range(k):
            on = group == g
            if on.any():
                centres[g] = np.average(points[on], axis=0, weights=weight[on] + 1e-12)
        centres /= np.linalg.norm(centres, axis=1, keepdims=True) + 1e-9
    return np.append(group, GROUPS - 1)


class Vocabulary:
    """Places of ids by their counts; the last id of ``counts`` is the end of a text."""

    def __init__(self, counts: np.ndarray):
        counts = counts.astype(np.float64)
        self.end = len(counts) - 1
        order = np.argsort(-counts, kind="stable")
        order = np.concatenate([[self.end], order[order != self.end]])
        top, rest = order[: PLACES - 1], order[PLACES - 1 :]
        self.place = np.full(len(counts), PLACES - 1, dtype=np.int32)
        self.place[top] = np.arange(len(top))
        self.extra = np.zeros(len(counts))
        if len(rest):
            self.extra[rest] = np.log((counts[rest] + 1) / (counts[rest].sum() + len(rest)))
        mass = np.ones(PLACES)
        mass[: len(top)] += counts[top]
        mass[PLACES - 1] += counts[rest].sum()
        self.mass = mass / mass.sum()


class Tables:
    """What the counts of neighbours say: ``group`` of each place, ``prior`` (log probability of a group after a place) and ``within`` (of a place in its group)."""

    def __init__(self, mass: np.ndarray, pairs: np.ndarray):
        """``pairs[a, b]``: how often place b follows place a."""
        n = pairs.sum(1, keepdims=True)
        kinds = (pairs > 0).sum(1, keepdims=True)
        p = np.where(n > 0, (np.maximum(pairs - DISCOUNT, 0) + DISCOUNT * kinds * mass) / np.maximum(n, 1), mass)
        self.group = _clusters(pairs, mass)
        by_group = np.zeros((len(mass), GROUPS))
        for g in range(GROUPS):
            by_group[:, g] = p[:, self.group == g].sum(1)
        by_group = np.maximum(by_group, 1e-12)
        self.prior = np.log(by_group).astype(np.float32)
        self._start = (None, None)
        self.within = (np.log(np.maximum(p, 1e-30)) - np.log(by_group)[:, self.group]).astype(np.float32)

    def start(self, bias: np.ndarray) -> np.ndarray:
        """``prior`` with a bias of each group, kept for the next call."""
        if self._start[0] is not bias:
            self._start = (bias, self.prior + bias)
        return self._start[1]


def initial(seed: int = 7) -> Params:
    """Random weights; the output starts at nothing, so the counts alone speak."""
    rng = np.random.default_rng(seed)
    r = lambda *s, scale=0.1: (rng.standard_normal(s) * scale).astype(np.float32)
    root = 1 / np.sqrt(DIM)
    return {
        "emb": r(PLACES, DIM, scale=0.3), "pos": r(WIDTH, DIM, scale=0.1), "wq": r(DIM, DIM, scale=root), "wk": r(DIM, DIM, scale=root), "wv": r(DIM, DIM, scale=root), "wo": r(DIM, DIM, scale=root),
        "w1": r(DIM, HIDDEN, scale=root), "b1": np.zeros(HIDDEN, np.float32), "w2": r(HIDDEN, DIM, scale=1 / np.sqrt(HIDDEN)), "ug": r(DIM, GROUPS, scale=0.02), "bg": np.zeros(GROUPS, np.float32),
    }


def slots(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(slot of each place, first window of each text, number of windows): a text takes whole windows of ``STEP`` slots."""
    n = -(-counts // STEP)
    first = np.cumsum(n) - n
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first * STEP - ends + counts, counts), first, int(n.sum())


def windows(places: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(inputs, targets) of the windows of texts of ``counts`` places: what each reads (a text begins after place 0, the end) and scores (-1: nothing)."""
    slot, first, n = slots(counts)
    own = np.full(n * STEP, -1, dtype=np.int32)
    own[slot] = places
    read = np.zeros(n * STEP + CONTEXT, dtype=np.int32)
    np.maximum(own[:-1], 0, out=read[CONTEXT + 1 :])
    read[CONTEXT + STEP * first] = 0
    strided = np.lib.stride_tricks.as_strided(read, (n, WIDTH), (STEP * 4, 4), writeable=False)
    fresh = np.zeros(n, dtype=bool)
    fresh[first] = True
    inputs = strided.copy()
    # a text's first window has no context but the end of what was before
    inputs[fresh, :CONTEXT] = 0
    return inputs, own.reshape(n, STEP)


def _by(m: np.ndarray, w: np.ndarray) -> np.ndarray:
    """``m @ w`` for a stack of matrices, as one product instead of one for each."""
    return (m.reshape(-1, m.shape[-1]) @ w).reshape(*m.shape[:-1], w.shape[-1])


def _bound(z: np.ndarray) -> None:
    """Scores above ``TOP`` are cut to it."""
    if z.max() > TOP:
        np.minimum(z, TOP, out=z)


def _with_ones(m: np.ndarray) -> np.ndarray:
    """``m`` with a column of ones, which brings biases and their gradients into the products."""
    out = np.ones((m.shape[0], m.shape[1] + 1), dtype=m.dtype)
    out[:, :-1] = m
    return out


class Reader:
    """The model's scores of texts. Embeddings are multiplied with the projections once, and the attention's sums come with its product."""

    def __init__(self, p: Params, tables: Tables):
        self.p, self.tables = p, tables
        # a place's own part, its key, its query, its value and a one
        full = lambda e, one: np.concatenate([e, e @ p["wk"], e @ p["wq"] / np.float32(np.sqrt(DIM)), e @ p["wv"], np.full((len(e), 1), one)], axis=-1).astype(np.float32)
        self.emb, self.pos = full(p["emb"], 1), full(p["pos"], 0)
        # bounds of all scores there can be: below TOP nothing has to be cut
        d = DIM
        most = lambda a, b: float(np.linalg.norm(self.emb[:, a:b], axis=1).max() + np.linalg.norm(self.pos[:, a:b], axis=1).max())
        norm = lambda w: float(np.linalg.norm(p[w], 2))
        y = most(0, d) + most(3 * d, 4 * d) * norm("wo")
        h = y + (y * norm("w1") + float(np.linalg.norm(p["b1"]))) * norm("w2")
        self.cut_keys = most(2 * d, 3 * d) * most(d, 2 * d) > TOP
        self.cut_groups = h * float(np.linalg.norm(p["ug"], axis=0).max()) + float(np.abs(p["bg"]).max()) > TOP

    def _windows(self, inputs: np.ndarray, targets: np.ndarray) -> np.ndarray:
        p, t, d = self.p, self.tables, DIM
        x = np.take(self.emb, inputs, axis=0)
        x += self.pos
        s = x[:, CONTEXT:, 2 * d : 3 * d] @ x[:, :, d : 2 * d].transpose(0, 2, 1)
        if self.cut_keys:
            np.minimum(s, TOP, out=s)
        np.exp(s, out=s)
        s *= _SEEN
        c = (s @ x[:, :, 3 * d :]).reshape(-1, d + 1)
        c[:, d] += np.float32(1e-30)
        y = x[:, CONTEXT:, :d].reshape(-1, d)
        y = y + (c[:, :d] / c[:, d:]) @ p["wo"]
        u = y @ p["w1"]
        u += p["b1"]
        np.maximum(u, 0, out=u)
        y += u @ p["w2"]
        last = inputs[:, CONTEXT:].ravel()
        z = y @ p["ug"]
        z += np.take(t.start(p["bg"]), last, axis=0)
        if self.cut_groups:
            np.minimum(z, TOP, out=z)
        own = z[np.arange(len(z)), t.group[targets.ravel()]]
        np.exp(z, out=z)
        return own - np.log(z @ np.ones(GROUPS, z.dtype)) + t.within[last, targets.ravel()]

    def log_probs(self, places: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Natural log probability of each place given those before it in its text."""
        if not len(places):
            return np.zeros(0)
        inputs, targets = windows(places, counts)
        out = np.empty(targets.shape, dtype=np.float32)
        targets = np.maximum(targets, 0)
        for b in range(0, len(inputs), BATCH):
            out[b : b + BATCH] = self._windows(inputs[b : b + BATCH], targets[b : b + BATCH]).reshape(-1, STEP)
        return out.ravel()[slots(counts)[0]].astype(np.float64)


def gradients(p: Params, tables: Tables, inputs: np.ndarray, targets: np.ndarray) -> tuple[float, Params]:
    """(mean loss in groups, gradients) of windows as ``windows`` gives them.

    Keys, values and queries are one product; rows of the softmaxes are divided by their
    sums where they are narrow, after the products.
    """
    d, kind = DIM, p["emb"].dtype
    flat = lambda m: m.reshape(-1, m.shape[-1])
    shape, root = (*targets.shape, d), kind.type(1 / np.sqrt(d))
    x = np.take(p["emb"], inputs, axis=0)
    x += p["pos"]
    w = np.concatenate([p["wk"], p["wv"], p["wq"] * root], axis=1)
    kvq = _by(x, w)
    k, v, q = kvq[:, :, :d], kvq[:, :, d : 2 * d], kvq[:, CONTEXT:, 2 * d :]
    a = q @ k.transpose(0, 2, 1)
    _bound(a)
    np.exp(a, out=a)
    a *= _SEEN
    part = 1 / (flat(a) @ np.ones(WIDTH, kind) + kind.type(1e-30))[:, None]
    c = flat(a @ v)
    c *= part
    y = c @ p["wo"]
    y += flat(x[:, CONTEXT:])
    y = _with_ones(y)
    u = y @ np.vstack([p["w1"], p["b1"]])
    np.maximum(u, 0, out=u)
    h = u @ p["w2"]
    h += y[:, :d]
    h = _with_ones(h)
    last, on, grad = inputs[:, CONTEXT:].ravel(), targets.ravel() >= 0, {}
    n = max(int(on.sum()), 1)
    z = h @ np.vstack([p["ug"], p["bg"]])
    z += np.take(tables.prior, last, axis=0)
    _bound(z)
    np.exp(z, out=z)
    total = z @ np.ones(GROUPS, kind)
    cells = tables.group[np.maximum(targets, 0).ravel()] + np.arange(0, z.size, GROUPS)
    loss = -np.log(z.ravel()[cells] / total + 1e-30)[on].sum()
    z.ravel()[cells] -= total
    # places without a target have no part in any gradient
    scale = (on / (total * n)).astype(kind)[:, None]
    h *= scale
    both = h.T @ z
    grad["ug"], grad["bg"] = both[:d], both[d]
    out = z @ p["ug"].T
    out *= scale
    grad["w2"] = u.T @ out
    du = out @ p["w2"].T
    du *= u > 0
    both = y.T @ du
    grad["w1"], grad["b1"] = both[:d], both[d]
    dy = du @ p["w1"].T
    dy += out
    grad["wo"] = c.T @ dy
    dc = dy @ p["wo"].T
    dc *= part
    drift = np.einsum("ij,ij->i", dc, c).reshape(*targets.shape, 1)
    dc = dc.reshape(shape)
    ds = dc @ v.transpose(0, 2, 1)
    ds -= drift
    ds *= a
    dkvq = np.empty_like(kvq)
    dkvq[:, :, :d] = ds.transpose(0, 2, 1) @ q
    dkvq[:, :, d : 2 * d] = a.transpose(0, 2, 1) @ dc
    dkvq[:, :CONTEXT, 2 * d :] = 0
    dkvq[:, CONTEXT:, 2 * d :] = ds @ k
    both = flat(x).T @ flat(dkvq)
    grad["wk"], grad["wv"], grad["wq"] = both[:, :d], both[:, d : 2 * d], both[:, 2 * d :] * root
    dx = _by(dkvq, w.T)
    dx[:, CONTEXT:] += dy.reshape(shape)
    grad["pos"] = dx.sum(0)
    # an id that stands often in the windows adds up what it gets
    cells = np.repeat(inputs.ravel().astype(np.int64) * d, d).reshape(-1, d)
    cells += np.arange(d)
    grad["emb"] = np.bincount(cells.ravel(), weights=dx.ravel(), minlength=p["emb"].size).reshape(p["emb"].shape).astype(kind)
    return float(loss) / n, grad


class Learner:
    """Adam over windows, from given weights; all weights, and all moments, are one vector each, so that a step is a few operations."""

    def __init__(self, p: Params, tables: Tables, rate: float = 3e-3):
        self.flat, self.tables, self.rate, self.t = packed(p).astype(np.float32), tables, rate, 0
        self.p = unpacked(self.flat, p, copy=False)
        self.m, self.v, self.room = np.zeros_like(self.flat), np.zeros_like(self.flat), np.empty_like(self.flat)

    def learn(self, inputs: np.ndarray, targets: np.ndarray, batch: int = 64) -> None:
        for b in range(0, len(inputs), batch):
            g = packed(gradients(self.p, self.tables, inputs[b : b + batch], targets[b : b + batch])[1])
            size = np.sqrt(float(g @ g))
            if not np.isfinite(size):
                continue
            # a tenth of the gradient goes into the first moment, and its square, a hundredth, into the second
            g *= np.float32(0.1 * min(1.0, 1.0 / (size + 1e-9)))
            self.t += 1
            self.m *= np.float32(0.9)
            self.m += g
            self.v *= np.float32(0.99)
            g *= g
            self.v += g
            root = np.sqrt(1 - 0.99**self.t)
            step = np.sqrt(self.v, out=self.room)
            step += np.float32(1e-6 * root)
            np.divide(self.m, step, out=step)
            step *= np.float32(self.rate * root / (1 - 0.9**self.t))
            self.flat -= step


def packed(p: Params) -> np.ndarray:
    return np.concatenate([p[k].ravel() for k in sorted(p)])


def unpacked(flat: np.ndarray, like: Params, copy: bool = True) -> Params:
    """The weights in ``flat``, as parts of it if they are not copied."""
    out, at = {}, 0
    for k in sorted(like):
        part = flat[at : at + like[k].size].reshape(like[k].shape)
        out[k] = part.astype(np.float32) if copy else part
        at += like[k].size
    return out
