import math
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lumenframe.functions import search, vonmises
from lumenframe.operators import circular, draws


def test_weighted_draw(spark):
    """Each draw is the first row whose running weight passes it; null, 0 and negative weights are never drawn."""
    rng = np.random.default_rng(1)
    rows = [(g, int(o), float(w)) for g in range(40) for o, w in zip(rng.permutation(2000)[:60] - 500, rng.integers(-1, 9, 60), strict=True)]
    rows += [(100, 1, None), (100, 2, 0.0), (101, 7, 0.5), (102, 1, None), (102, 3, 2.0)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "g long, o long, weight double, draw string").repartition(3)
    got = sorted(tuple(r) for r in draws.weighted_draw(df.drop("draw"), draws=20).collect())
    want = []
    for g in {r[0] for r in rows}:
        own = sorted((o, w) for h, o, w in rows if h == g and w and w > 0)
        for d in range(1, 21) if own else ():
            u = (((g % 1000003) * 1103515245 + d * 12345 + 1013904223) % 2147483647) * 48271 % 2147483647 / 2147483647
            at = int(np.searchsorted(np.cumsum([w for _, w in own]), u * sum(w for _, w in own), side="right"))
            want.append((g, d, own[at][0]))
    assert got == sorted(want)
    for n in (0, 101):
        with pytest.raises(ValueError):
            draws.weighted_draw(df, draws=n)


def test_draws_are_fair(spark):
    df = spark.range(3000).selectExpr("id as g").crossJoin(spark.createDataFrame([(1, 1.0), (2, 3.0), (3, 6.0)], "o long, weight double"))
    n = Counter(r.o for r in draws.weighted_draw(df, draws=2).collect())
    assert abs(n[1] - 600) < 120 and abs(n[2] - 1800) < 180 and abs(n[3] - 3600) < 180


def test_bisect(spark):
    def one(func, *args, **more):
        return spark.range(1).select(search.bisect(func, *args, **more).alias("x")).first().x

    assert one(lambda x: 2 * x - 4, 0, -1, 3) == pytest.approx(2) and one(lambda x: x * x - 2, 3, 0, 3) == pytest.approx(math.sqrt(5))
    assert one(F.sqrt, 0, 0, 1, tol=1e-6) == pytest.approx(0, abs=1e-11) and one(F.sqrt, 0, 0, 1) == pytest.approx(0, abs=1e-20)
    cubic = lambda x: x * x * x + 2 * x * x - 8 * x
    assert one(cubic, 5, -2, 1) is None and one(cubic, -3, 2, 3) is None and one(F.sqrt, 0, 0, 1, tol=1e-18, steps=30) is None and one(lambda x: x, 1, 3, 2) is None
    df = spark.createDataFrame([(1.0, 4.0), (2.0, 10.0), (None, 1.0), (0.0, None)], "k double, t double")
    got = [r.x for r in df.select(search.bisect(lambda x: x * x + F.col("k") * x, F.col("t"), 0, 10).alias("x")).collect()]
    assert got == [pytest.approx((-1 + math.sqrt(17)) / 2), pytest.approx(-1 + math.sqrt(11)), None, None]


def test_cauchy(spark):
    """The fixed point of plain reweighting; repeated, null and single angles."""
    rng = np.random.default_rng(2)
    groups = {"a": np.round(2 + np.arctan(rng.standard_cauchy(400)), 2), "b": rng.random(300) * 2 * math.pi, "c": np.mod(rng.normal(5, 0.3, 200), 2 * math.pi)}
    rows = [(g, float(x)) for g, xs in groups.items() for x in xs] + [("a", None), ("a", float("nan"))]
    got = {r.g: r for r in vonmises.cauchy_ml(spark.createDataFrame(rows, "g string, x double").repartition(3)).collect()}
    assert set(got) == set(groups)
    for g, x in groups.items():
        m = np.array([0.1, 0.1])
        for _ in range(20_000):
            w = 1 / (1 - m[0] * np.cos(x) - m[1] * np.sin(x))
            m = np.array([(w * np.cos(x)).sum(), (w * np.sin(x)).sum()]) / w.sum()
        size = math.hypot(*m)
        assert got[g].mu == pytest.approx(math.atan2(m[1], m[0]) % (2 * math.pi), abs=1e-8) and got[g].rho == pytest.approx((1 - math.sqrt(1 - size**2)) / size, abs=1e-9)


def test_rao_points(spark):
    """Simulated 5 % and 10 % points against published ones, and p-values of extremes."""
    null = {r.row: np.array(r.null) for r in vonmises.rao_null(spark.createDataFrame([(n,) for n in (4, 5, 6, 7, 8)], "row int")).collect()}
    for n, five, ten in ((4, 186.45, 168.02), (5, 183.44, 168.66), (6, 180.65, 166.30), (7, 177.83, 165.05), (8, 175.68, 163.56)):
        assert np.quantile(null[n], 0.95) == pytest.approx(five, rel=0.01) and np.quantile(null[n], 0.9) == pytest.approx(ten, rel=0.01)
    even, crowd, few = np.arange(50) * 2 * math.pi / 50, np.linspace(0, 0.5, 50), [0.1, 0.2, 3.0]
    df = spark.createDataFrame([(g, float(x)) for g, xs in (("even", even), ("crowd", crowd), ("few", few)) for x in xs], "g string, x double")
    got = {r.g: r for r in vonmises.rao_test(df, draws=2000).collect()}
    assert got["even"].p_value == 1 and got["crowd"].p_value == 0 and got["crowd"].p_band == "p < 0.001" and got["few"].p_value is None and got["few"].p_band is None


def test_bands(spark):
    """The bands of Watson's tests for samples that are even, and that crowd."""
    rows = [("even", float(x)) for x in np.arange(30) * 2 * math.pi / 30] + [("crowd", float(x)) for x in np.linspace(0, 0.5, 30)]
    got = {r.g: r.p_band for r in circular.watson_uniform_test(spark.createDataFrame(rows, "g string, x double")).collect()}
    assert got == {"even": "p > 0.10", "crowd": "p < 0.01"}
    two = pd.DataFrame({"side": [1, 2] * 30, "x": [x for _, x in rows[:30] for _ in range(2)]})
    assert circular.watson_two_test(spark.createDataFrame(two)).first().p_band == "p > 0.10"
    two["x"] = [x + 3 * (s - 1) for x, s in zip([x for _, x in rows[30:] for _ in range(2)], two["side"], strict=True)]
    assert circular.watson_two_test(spark.createDataFrame(two)).first().p_band == "p < 0.001"
