import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenframe.functions import vonmises
from lumenframe.plans import catalog

COLUMNS = ["g", "low", "high", "mu_low", "mu_high", "kappa_low", "kappa_high"]


def test_intervals(spark):
    """Against intervals of plain resampling; p's directions lie on both sides of 0, q's do not; one is a single row."""
    rnd = np.random.default_rng(1)
    xs = {"p": rnd.vonmises(0.02, 2.0, 300) % vonmises.TAU, "q": rnd.vonmises(2.0, 4.0, 300) % vonmises.TAU}
    rows = [(1000 * i + j, g, float(x)) for i, (g, v) in enumerate(xs.items()) for j, x in enumerate(v)] + [(9000, "one", 1.0)]
    df = vonmises.bootstrap(spark.createDataFrame(rows, "id long, g string, x double"))
    got = {r.g: r for r in df.collect()}
    assert df.columns == COLUMNS and set(got) == {"p", "q", "one"}
    for g, v in xs.items():
        z = np.exp(1j * v)[rnd.integers(0, 300, (4000, 300))].mean(axis=1)
        centre = np.angle(np.exp(1j * v).mean())
        mu = np.quantile(np.angle(z / np.exp(1j * centre)), [0.025, 0.975]) + centre
        r = np.abs(z)
        kappa = np.quantile(np.where(r < 0.53, 2 * r + r**3 + 5 * r**5 / 6, np.where(r < 0.85, -0.4 + 1.39 * r + 0.43 / (1 - r), 1 / (r**3 - 4 * r * r + 3 * r))), [0.025, 0.975])
        x = got[g]
        assert np.allclose(np.exp(1j * np.array([x.mu_low, x.mu_high])), np.exp(1j * mu), atol=0.03)
        assert 0 < x.mu_high - x.mu_low < 0.5
        assert np.allclose([x.kappa_low, x.kappa_high], kappa, rtol=0.06)
    one = got["one"]
    assert one.mu_low == pytest.approx(1.0) and one.mu_high == pytest.approx(1.0) and one.kappa_low is None
    assert math.isclose(one.low, 1.0)


@pytest.mark.parametrize("seed", [1, -3, 1 << 40])
def test_weights(spark, seed):
    """The weights are those of Spark's hash of row, repetition and seed."""
    u = F.pmod(F.xxhash64("id", "rep", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    steps = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(8)])
    rows = spark.range(-50, 50).select("id", F.xxhash64("id").alias("h"), F.explode(F.sequence(F.lit(1), F.lit(30))).alias("rep")).withColumn("k", sum((u >= float(c)).cast("int") for c in steps)).toPandas()
    want = rows.sort_values(["id", "rep"]).k.to_numpy().reshape(100, 30)
    assert (vonmises._weights(rows.drop_duplicates("id").sort_values("id").h.to_numpy(), 30, seed) == want).all() and want.max() > 3


def test_parts(spark):
    """One part of the input is dealt out; groups without a name, and of nothing but unknown directions."""
    rows = [(i, (None, "a", "b")[i % 3], None if i % 3 == 2 else i / 7 % 6) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, g string, x double").coalesce(1)
    plan = vonmises.bootstrap(df, reps=40)._jdf.queryExecution().toString()
    assert "Generate" not in plan
    got = {r.g: r for r in vonmises.bootstrap(df, reps=40).collect()}
    assert set(got) == {None, "a", "b"} and got["b"].low is None and got["b"].mu_low is None
    by = {g: np.array([x for _, k, x in rows if k == g]) for g in (None, "a")}
    ids = {g: spark.createDataFrame([(i,) for i, k, _ in rows if k == g], "id long").select(F.xxhash64("id").alias("h")).toPandas().h.to_numpy() for g in by}
    for g, x in by.items():
        k = vonmises._weights(ids[g], 40, 1).astype(float)
        rho = np.hypot(np.sin(x) @ k, np.cos(x) @ k) / k.sum(axis=0)
        assert np.allclose([got[g].low, got[g].high], np.quantile(rho, [0.025, 0.975]))


def test_registered(spark, small, monkeypatch):
    reps, real = [], vonmises.bootstrap

    def spy(a, reps_=1000, **k):
        reps.append(k.get("reps", reps_))
        return real(a, **k)

    monkeypatch.setattr(catalog.vonmises, "bootstrap", spy)
    df = catalog.QUERIES["bootstrap_ci"](spark, small)
    assert reps == [1000] and df.columns == COLUMNS
