import math

import numpy as np

from lumenframe.functions import vonmises

TAU = 2 * math.pi


def test_range_tail():
    """The plain alternating sum where it is exact enough, a simulation, and large samples."""
    for n, r in ((5, 2.0), (8, 4.5), (20, 5.0), (12, 1.0)):
        gap = 1 - r / TAU
        plain = math.fsum((-1) ** (k - 1) * math.comb(n, k) * (1 - k * gap) ** (n - 1) for k in range(1, int(1 / gap) + 1))
        assert abs(vonmises.range_tail(n, gap) - plain) < 1e-9
    x = np.sort(np.random.default_rng(1).uniform(size=(20000, 30)))
    gaps = np.diff(x, axis=1, append=x[:, :1] + 1).max(axis=1)
    assert abs(vonmises.range_tail(30, 0.12) - (gaps >= 0.12).mean()) < 0.02
    n = 10**6
    assert vonmises.range_tail(n, 1.0000001 / n) == 1 and abs(vonmises.range_tail(n, (math.log(n) + 1) / n) - (1 - math.exp(-math.exp(-1)))) < 1e-3
    assert vonmises.range_tail(1, 1.0) == 1 and vonmises.range_tail(3, 1.0) == 0


def test_watson_vm_and_range(spark):
    rng = np.random.default_rng(2)
    groups = {"fit": rng.vonmises(1, 2, 200), "bad": np.concatenate([rng.normal(0.5, 0.1, 80), rng.normal(3.5, 0.1, 100)]), "tied": np.repeat(rng.vonmises(0, 1, 20), 3)}
    rows = [(g, float(v) % TAU) for g, x in groups.items() for v in x]
    a = spark.createDataFrame(rows + [("fit", None)], "g string, x double")
    got = {r.g: r for r in vonmises.watson_vm(a).collect()}
    for g, x in groups.items():
        mu, n = math.atan2(np.sin(x).sum(), np.cos(x).sum()), len(x)
        z = np.sort(vonmises.cdf(np.mod(x - mu, TAU), 0.0, got[g].kappa))
        u2 = ((z - (2 * np.arange(1, n + 1) - 1) / (2 * n)) ** 2).sum() - n * (z.mean() - 0.5) ** 2 + 1 / (12 * n)
        assert got[g].n == n and abs(got[g].u2 - u2) < 1e-5
    assert got["bad"].p_band == "p < 0.01" and got["fit"].p_band == "p > 0.10"
    found = {r.g: r for r in vonmises.range_test(a).collect()}
    assert found["bad"].p_value < 1e-6 and found["fit"].n == 200 and all(0 <= r.p_value <= 1 for r in found.values())


def test_regression_orders(spark):
    rng = np.random.default_rng(3)
    x = rng.uniform(0, TAU, 150)
    y = np.mod(np.arctan2(0.4 * np.sin(x) + 0.5 * np.sin(2 * x) + rng.normal(0, 0.2, 150), 1 + 0.3 * np.cos(x)), TAU)
    pairs = spark.createDataFrame([("g", float(a), float(b)) for a, b in zip(x, y, strict=True)] + [("few", 1.0, 2.0)] * 3 + [("g", None, 1.0)], "g string, x double, y double")
    for order in (1, 2):
        reg = vonmises.circular_regression(pairs, order)
        got = {r.g: r for r in reg.collect()}
        X = np.column_stack([np.ones(150)] + [f(k * x) for f in (np.cos, np.sin) for k in range(1, order + 1)])
        W = np.column_stack([np.cos((order + 1) * x), np.sin((order + 1) * x)])
        rest = np.eye(150) - X @ np.linalg.solve(X.T @ X, X.T)
        N = W @ np.linalg.solve(W.T @ rest @ W, W.T)
        for t, p in ((np.cos(y), got["g"].p_cos), (np.sin(y), got["g"].p_sin)):
            T = (150 - 2 * order - 1) * (t @ rest @ N @ rest @ t) / (t @ rest @ t)
            assert abs(p - math.exp(-T / 2)) < 1e-9
        assert got["few"].p_cos is None and got["few"].p_sin is None
        coef = [np.linalg.lstsq(X, f(y), rcond=None)[0] for f in (np.cos, np.sin)]
        fitted = np.mod(np.arctan2(X @ coef[1], X @ coef[0]), TAU)
        fits = vonmises.regression_fit(pairs, reg, order)
        mine = {round(r.x, 12): r.fitted for r in fits.where("g = 'g' and x is not null").collect()}
        assert all(abs(mine[round(a, 12)] - b) < 1e-8 for a, b in zip(x, fitted, strict=True))
        a_k = {r.g: r.a_k for r in vonmises.residual_concentration(fits.where("x is not null")).collect()}["g"]
        assert abs(a_k - np.cos(y - fitted).mean()) < 1e-9
