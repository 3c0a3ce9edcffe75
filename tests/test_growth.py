"""Growth fits in linear time against the dense ones."""

import time

import numpy as np

from cytoweave.operators import growth, track


def dense(t, v, scale, noise):
    """Value, slope, second derivative and deviations from the full covariance, variance in closed form."""
    centre, spread = v.mean(), v.std() or 1.0
    y, d = (v - centre) / spread, t[:, None] - t[None, :]
    u = np.sqrt(5) * np.abs(d) / scale
    k = (1 + u + u * u / 3) * np.exp(-u)
    g = -(5 * d / (3 * scale**2)) * (1 + u) * np.exp(-u)
    b = -(5 / (3 * scale**2)) * (1 + u - u * u) * np.exp(-u)
    low = np.linalg.cholesky(k + noise * np.eye(len(t)))
    a = np.linalg.solve(low.T, np.linalg.solve(low, y))
    var = float(y @ a) / len(t)
    score = -0.5 * len(t) * np.log(var) - np.log(np.diag(low)).sum()
    std = lambda m, top: np.sqrt(np.clip(var * (top - (np.linalg.solve(low, m.T) ** 2).sum(0)), 0, None)) * spread
    return score, (k @ a * spread + centre, std(k, 1), g @ a * spread, std(g, 5 / (3 * scale**2)), b @ a * spread, std(b, 25 / scale**4))


def series(rng, n, gaps=(1, 2, 3)):
    t = np.cumsum(rng.choice(gaps, n)).astype(float)
    return t, 50 + 10 * np.sin(t / 7) + rng.normal(0, 1, n)


def test_fits_equal_dense_ones():
    rng = np.random.default_rng(3)
    parts = [series(rng, n) for n in (3, 4, 17, 60, 60, 200)]
    first = np.cumsum([0, *[len(t) for t, _ in parts]])[:-1]
    got = growth.gp_fit(np.concatenate([t for t, _ in parts]), np.concatenate([v for _, v in parts]), first)
    for (t, v), a in zip(parts, first, strict=True):
        y = ((v - v.mean()) / v.std())[None, :]
        scale, noise, _ = growth._search(t[None, :], y, np.ones_like(y, bool), np.zeros(1, int), 1)
        score, want = dense(t, v, scale[0], noise[0])
        for x, w in zip(got, want, strict=True):
            assert np.abs(x[a : a + len(t)] - w).max() < 1e-6 * max(1.0, np.abs(w).max())
        # no start of the search is better
        assert all(score >= dense(t, v, s, r)[0] - 1e-6 for s in growth.SCALES for r in growth.NOISES)


def test_flat_and_repeated_times():
    got = growth.gp_fit(np.array([0.0, 1, 2, 3, 0, 0, 1, 5]), np.array([2.0, 2, 2, 2, 1, 3, 2, 4]), np.array([0, 4]))
    assert np.allclose(got[0][:4], 2) and np.isfinite(np.concatenate(got)).all()


def test_windows_of_a_long_series_are_its_whole_fit(monkeypatch):
    rng = np.random.default_rng(4)
    t, v = series(rng, 1_500)
    monkeypatch.setattr(growth, "WINDOW", 400)
    got = growth.gp_fit(t, v, np.array([0]))
    monkeypatch.setattr(growth, "_search", lambda *a, f=growth._search: f(*growth._rows(np.arange(0, 1_500, 400), np.append(np.arange(400, 1_500, 400), 1_500), t, (v - v.mean()) / v.std()), np.zeros(4, int), 1))
    monkeypatch.setattr(growth, "WINDOW", 2_000)
    want = growth.gp_fit(t, v, np.array([0]))
    for k, (x, w) in enumerate(zip(got, want, strict=True)):
        if k % 2 == 0:
            assert np.abs(x - w).max() < 1e-6 * np.abs(w).max()


def test_time_is_linear_in_the_points():
    rng = np.random.default_rng(5)
    t, v = series(rng, 200_000, (1,))
    start = time.perf_counter()
    got = growth.gp_fit(t, v, np.array([0]))
    assert time.perf_counter() - start < 60
    assert np.abs(got[0] - (50 + 10 * np.sin(t / 7))).mean() < 0.5 and np.abs(got[2] - 10 / 7 * np.cos(t / 7)).mean() < 0.2


def walk(prev, now, growth_, tolerance):
    """The rule read aloud: the side that is behind takes its next object."""
    out, rest_p, rest_q, a, b, took = [], list(prev), list(now), 0, 0, [[], []]
    while True:
        side = 0 if sum(took[0]) < sum(took[1]) else 1
        rest = rest_p if side == 0 else rest_q
        if not rest:
            return out
        took[side].append(rest.pop(0))
        p, q = map(sum, took)
        if p and q and abs(p * np.exp(growth_) - q) <= tolerance:
            i, j = a + len(took[0]), b + len(took[1])
            out.append((a, i, b, j))
            a, b, took = i, j, [[], []]


def test_balance_is_the_walk():
    rng = np.random.default_rng(6)
    for _ in range(500):
        prev, now = (rng.integers(1, 100, rng.integers(0, 9)).astype(float).tolist() for _ in range(2))
        assert track.balance(prev, now, 0.1, 8.0) == walk(prev, now, 0.1, 8.0)
