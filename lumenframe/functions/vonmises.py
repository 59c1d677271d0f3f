"""Circular distributions as Arrow functions, and seeded draws."""

from __future__ import annotations

import decimal
import itertools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.circular import WATSON_VM_BAND, a1inv, circ_range, rao_spacing, vm_ml, watson_fitted
from ..sources.store import tasks_of, written

TAU = 2 * math.pi


def bessel_ratios(kappa: float, terms: int) -> np.ndarray:
    """I_p / I_0 for p = 1..terms, by backward recurrence."""
    start, i = terms + 60 + int(2 * kappa), np.zeros(terms + 62 + int(2 * kappa))
    if kappa == 0:
        return np.zeros(terms)
    i[start] = 1e-300
    for p in range(start, 0, -1):
        i[p - 1] = i[p + 1] + 2 * p / kappa * i[p]
        if i[p - 1] > 1e250:
            i *= 1e-250
    return i[1 : terms + 1] / i[0]


def cdf(theta: np.ndarray, mu: float, kappa: float, terms: int | None = None) -> np.ndarray:
    """Probability of the arc from 0 to theta (mod 2 pi)."""
    n = terms or 40 + int(3 * math.sqrt(kappa) * 4)
    p = np.arange(1, n + 1)
    r = bessel_ratios(kappa, n) / p
    f = lambda t: np.asarray(t) / TAU + (r * np.sin(np.multiply.outer(np.asarray(t), p))).sum(axis=-1) / math.pi
    theta = np.mod(theta, TAU)
    return f(theta - mu % TAU) - f(-(mu % TAU))


def bisect(f: Callable[[np.ndarray], np.ndarray], target: np.ndarray, low: float, high: float, rounds: int = 60) -> np.ndarray:
    """Where a function that grows from ``low`` to ``high`` reaches each target."""
    a, b = np.full(len(target), low), np.full(len(target), high)
    for _ in range(rounds):
        mid = (a + b) / 2
        less = f(mid) < target
        a, b = np.where(less, mid, a), np.where(less, b, mid)
    return (a + b) / 2


def quantile(p: np.ndarray, mu: float, kappa: float) -> np.ndarray:
    """Angle in [0, 2 pi] with the given probability."""
    return bisect(lambda t: cdf(t, mu, kappa), p, 0.0, TAU - 1e-15)


def cardioid_quantile(p: np.ndarray, rho: float) -> np.ndarray:
    """Of the cardioid distribution around 0."""
    return bisect(lambda t: (t + 2 * rho * np.sin(t)) / TAU, p, 0.0, TAU)


def triangular_quantile(p: np.ndarray, rho: float) -> np.ndarray:
    """Of the triangular distribution, which is highest at 0 and symmetric."""
    def half(t: np.ndarray) -> np.ndarray:
        return (4 * t - math.pi**2 * rho * t + TAU * rho * (math.pi * t - t * t / 2)) / (8 * math.pi)

    return bisect(lambda t: np.where(t <= math.pi, half(t), 1 - half(TAU - t)), p, 0.0, TAU)


def chi_square_tail(x: float, df: int) -> float:
    """Probability that a chi-square value of ``df`` degrees of freedom is above x."""
    if x <= 0:
        return 1.0
    h, odd = x / 2, df % 2
    terms = sum(math.exp((k + odd / 2) * math.log(h) - h - math.lgamma(k + 1 + odd / 2)) for k in range((df - odd) // 2))
    return min(1.0, terms + (math.erfc(math.sqrt(h)) if odd else 0.0))


def cdf_column(x: Column, mu: float, kappa: float) -> Column:
    return F.pandas_udf(lambda s: pd.Series(cdf(s.to_numpy(), mu, kappa)), "double")(x)


def quantile_column(p: Column, mu: float, kappa: float) -> Column:
    return F.pandas_udf(lambda s: pd.Series(quantile(s.to_numpy(), mu, kappa)), "double")(p)


def mixed_cdf_column(x: Column, mu: float, kappa: float, mu2: float, kappa2: float, share: float) -> Column:
    return F.pandas_udf(lambda s: pd.Series(share * cdf(s.to_numpy(), mu, kappa) + (1 - share) * cdf(s.to_numpy(), mu2, kappa2)), "double")(x)


def _cdf_by_fit(x: pd.Series, mu: pd.Series, kappa: pd.Series) -> pd.Series:
    out = np.full(len(x), np.nan)
    for m, k in set(zip(mu[kappa.notna()], kappa[kappa.notna()], strict=True)):
        at = ((mu == m) & (kappa == k)).to_numpy()
        out[at] = cdf(x.to_numpy()[at], m, k)
    return pd.Series(out)


def fitted_cdf(x: Column, mu: Column, kappa: Column) -> Column:
    """Von Mises probabilities with each row's own parameters; NaN without a finite concentration."""
    return F.pandas_udf(_cdf_by_fit, "double")(x, mu, kappa)


def fitted(edf: DataFrame, summary: DataFrame, fits: DataFrame) -> DataFrame:
    """Data of a probability plot: empirical (i / (n + 1)) and fitted von Mises probabilities of rows (g, x, f), given n and mu, kappa of each g."""
    rows = edf.join(summary.select("g", "n"), "g").join(fits, "g")
    return rows.select("g", "x", (F.col("f") * F.col("n") / (F.col("n") + 1)).alias("empirical"), fitted_cdf(F.col("x"), F.col("mu"), F.col("kappa")).alias("fitted"))


def correlation_test(cor: DataFrame) -> DataFrame:
    """Adds the two-sided p_value of a circular correlation's test_stat."""
    return cor.withColumn("p_value", 2 * (1 - normal_cdf(F.abs("test_stat"))))


def homogeneity_test(rao: DataFrame) -> DataFrame:
    """Adds the p-values of Rao's tests of homogeneity, from their chi-square statistics."""
    tail = F.pandas_udf(lambda h, df: pd.Series([chi_square_tail(x, int(k)) if x == x else None for x, k in zip(h, df, strict=True)], dtype="float64"), "double")
    return rao.withColumns({"p_polar": tail("h_polar", "df"), "p_disp": tail("h_disp", "df")})


def normal_cdf(z: Column) -> Column:
    return F.pandas_udf(lambda s: s.map(lambda v: 0.5 * math.erfc(-v / math.sqrt(2)) if v == v else None), "double")(z)


def v0_test(a: DataFrame, mu0: float = 0.0) -> DataFrame:
    """V test of a stated mean direction for rows (g, x): r0_bar, p_value."""
    s = a.groupBy("g").agg(F.count("*").alias("n"), F.avg(F.cos(F.col("x") - mu0)).alias("r0_bar")).withColumn("z", F.sqrt(2 * F.col("n")) * F.col("r0_bar"))
    z, n = F.col("z"), F.col("n")
    series = (3 * z - z**3) / (16 * n) + (15 * z + 305 * z**3 - 125 * z**5 + 9 * z**7) / (4608 * n * n)
    return s.select("g", "r0_bar", (1 - normal_cdf(z) + F.exp(-z * z / 2) / math.sqrt(TAU) * series).alias("p_value"))


def cauchy_ml(a: DataFrame, mu0: float = 1.0, rho0: float = 0.3, tol: float = 1e-12, rounds: int = 100) -> DataFrame:
    """Wrapped Cauchy estimates (g, mu, rho) of each group: the fixed point of reweighting, reached by Newton's steps.

    Equal angles are one row. A round sums eight products of every group's rows, with partial sums, and the state is two
    numbers a group, so no group meets in a task. A step that would leave the unit disc is the plain reweighting instead.
    Null angles are left out. Groups that still move after ``rounds`` rounds keep the state they have reached.
    """
    rows = a.where("x is not null and not isnan(x)").groupBy("g", "x").agg(F.count("*").alias("n"))
    rows = written(rows.select("g", "n", F.cos("x").alias("c"), F.sin("x").alias("s")), "angles")
    size = 2 * rho0 / (1 + rho0**2)
    state = written(rows.select("g").distinct().select("g", F.lit(size * math.cos(mu0)).alias("a"), F.lit(size * math.sin(mu0)).alias("b"), F.lit(1.0).alias("moved")), "state")
    for _ in range(rounds):
        w = rows.join(state.where(F.col("moved") >= tol), "g").withColumn("w", 1 / (1 - F.col("a") * F.col("c") - F.col("b") * F.col("s")))
        total = lambda e: F.sum(F.expr(f"n * {e}"))
        sums = {"w0": "w", "n1": "w * c", "n2": "w * s", "v1": "w * w * c", "v2": "w * w * s", "m11": "w * w * c * c", "m12": "w * w * c * s", "m22": "w * w * s * s"}
        t = w.groupBy("g", "a", "b").agg(*[total(e).alias(k) for k, e in sums.items()])
        # the mean under the weights less the state, and its derivatives
        t = t.selectExpr("g", "a", "b", "n1 / w0 as p", "n2 / w0 as q", *[f"(m{min(i, j)}{max(i, j)} - n{i} / w0 * v{j}) / w0 - {int(i == j)} as j{i}{j}" for i in (1, 2) for j in (1, 2)])
        t = t.withColumn("det", F.expr("j11 * j22 - j12 * j21"))
        t = t.withColumns({"na": F.expr("a - try_divide(j22 * (p - a) - j12 * (q - b), det)"), "nb": F.expr("b - try_divide(j11 * (q - b) - j21 * (p - a), det)")})
        inner = F.coalesce(F.expr("na * na + nb * nb < 1"), F.lit(False))
        t = t.select("g", "a", "b", F.when(inner, F.col("na")).otherwise(F.col("p")).alias("na"), F.when(inner, F.col("nb")).otherwise(F.col("q")).alias("nb"))
        moved = t.select("g", F.col("na").alias("a"), F.col("nb").alias("b"), F.greatest(F.abs(F.col("na") - F.col("a")), F.abs(F.col("nb") - F.col("b"))).alias("moved"))
        state = written(moved.union(state.where(F.col("moved") < tol)), "state")
        if state.where(F.col("moved") >= tol).isEmpty():
            break
    size = F.hypot("a", "b")
    return state.select("g", F.pmod(F.atan2("b", "a"), F.lit(TAU)).alias("mu"), F.when(size > 0, (1 - F.sqrt(F.greatest(F.lit(0.0), 1 - size * size))) / size).otherwise(0.0).alias("rho"))


# Up to which number of angles a table of Rao's spacing is read, and the number whose row is read there (below, its own).
RAO_ROWS = ((32, 30), (37, 35), (42, 40), (47, 45), (62, 50), (87, 75), (125, 100), (175, 150), (250, 200), (350, 300), (450, 400), (550, 500), (650, 600), (750, 700), (850, 800), (950, 900))
#: Numbers of uniform angles drawn for a row, and how many of them a task draws.
RAO_DRAWS, RAO_CHUNK = 40_000, 1000


def _rao_row(n: Column) -> Column:
    out = F.lit(1000)
    for most, row in reversed(RAO_ROWS):
        out = F.when(n <= most, row).otherwise(out)
    return F.when(n <= 30, n).otherwise(out).cast("int")


def _spacings(seed: int):
    def run(frames):
        for pdf in frames:
            for n, chunk in zip(pdf["row"], pdf["chunk"], strict=True):
                gaps = np.random.default_rng([seed, int(n), int(chunk)]).standard_exponential((RAO_CHUNK, int(n)))
                u = np.abs(360 * gaps / gaps.sum(axis=1, keepdims=True) - 360 / n).sum(axis=1) / 2
                yield pd.DataFrame({"row": np.full(len(u), n, dtype=np.int32), "u": u})

    return run


def rao_null(rows: DataFrame, draws: int = RAO_DRAWS, seed: int = 1) -> DataFrame:
    """row, null: for each number of angles (row) the statistics of so many uniform samples, ascending; drawn in tasks, fixed by number and seed."""
    chunks = -(-draws // RAO_CHUNK)
    units = rows.select("row").distinct().select("row", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"))
    drawn = units.repartition(tasks_of(rows.sparkSession), "row", "chunk").mapInPandas(_spacings(seed), "row int, u double")
    return drawn.groupBy("row").agg(F.sort_array(F.collect_list("u")).alias("null"))


def rao_test(a: DataFrame, draws: int = RAO_DRAWS, seed: int = 1) -> DataFrame:
    """g, n, u and the p_value of Rao's spacing test of uniformity, with its band; null for groups of fewer than 4 angles.

    The share of uniform samples of as many angles that reach u, by simulation: of the group's own number up to 30, and of
    classes of numbers beyond, as tables of the test have them (of 1,000 for all larger ones).
    """
    found = rao_spacing(a).join(a.where("x is not null and not isnan(x)").groupBy("g").agg(F.count("*").alias("n")), "g")
    found = found.withColumn("row", F.when(F.col("n") >= 4, _rao_row(F.col("n"))))
    null = rao_null(found.where("row is not null"), draws, seed)
    p = F.size(F.filter("null", lambda v: v >= F.col("u"))) / F.size("null")
    band = "case when p_value < 0.001 then 'p < 0.001' when p_value < 0.01 then '0.001 < p < 0.01' when p_value < 0.05 then '0.01 < p < 0.05' when p_value < 0.1 then '0.05 < p < 0.10' when p_value is not null then 'p > 0.10' end"
    return found.join(null, "row", "left").select("g", "n", "u", p.alias("p_value")).withColumn("p_band", F.expr(band))


def _design(order: int) -> list[str]:
    return ["1e0"] + [f"{f}({k} * x)" for f in ("cos", "sin") for k in range(1, order + 1)]


def circular_regression(pairs: DataFrame, order: int = 1) -> DataFrame:
    """Trigonometric regression of y on x by group: rho, coefficients, and whether terms of the next order would add to it (p_cos, p_sin), from sums of products alone.

    The normal equations are aggregated, so no group has to fit anywhere. Groups with too few different angles for the
    next order have no p-values, and those with too few for this one get the coefficients of least norm.
    """
    design = _design(order) + [f"{f}({order + 1} * x)" for f in ("cos", "sin")] + ["cos(y)", "sin(y)"]
    n, k = len(design), 2 * order + 1
    rows = pairs.selectExpr("g", *[f"{v} as a{i}" for i, v in enumerate(design)])
    sums = [F.sum(F.col(f"a{i}") * F.col(f"a{j}")).alias(f"m{i}_{j}") for i in range(n) for j in range(i, n)]

    def solve(key, pdf: pd.DataFrame) -> pd.DataFrame:
        r = pdf.iloc[0]
        m = np.array([[r[f"m{min(i, j)}_{max(i, j)}"] for j in range(n)] for i in range(n)])
        x, w, count = slice(k), slice(k, k + 2), m[0, 0]
        coef, *_ = np.linalg.lstsq(m[x, x], m[x, k + 2 :], rcond=1e-12)
        size = sum(coef[:, t] @ m[x, x] @ coef[:, t] for t in range(2))
        rest = m - m[:, x] @ np.linalg.lstsq(m[x, x], m[x, :], rcond=1e-12)[0]  # products of what the terms of x leave
        p = [None, None]
        if count > k + 2 and np.linalg.eigvalsh(rest[w, w])[0] > 1e-9 * count:
            for t in range(2):
                y = k + 2 + t
                gain = rest[y, w] @ np.linalg.solve(rest[w, w], rest[w, y])
                # the tail of a chi-square value of two degrees of freedom
                p[t] = math.exp(-(count - k) * gain / rest[y, y] / 2) if rest[y, y] > 1e-12 * count else None
        out = {"g": [key[0]], "rho": [math.sqrt(max(size, 0.0) / count)], "cos_coef": [coef[:, 0].tolist()], "sin_coef": [coef[:, 1].tolist()]}
        return pd.DataFrame(out | {"p_cos": pd.Series([p[0]], dtype="float64"), "p_sin": pd.Series([p[1]], dtype="float64")})

    return rows.where(" and ".join(f"a{i} is not null and not isnan(a{i})" for i in (1, n - 1))).groupBy("g").agg(*sums).groupBy("g").applyInPandas(solve, "g string, rho double, cos_coef array<double>, sin_coef array<double>, p_cos double, p_sin double")


def regression_fit(pairs: DataFrame, regression: DataFrame, order: int = 1) -> DataFrame:
    """The rows of ``pairs`` with their ``fitted`` angle and ``residual``, both in [0, 2 pi)."""
    fit = lambda c: " + ".join(f"{c}[{i}] * {d}" for i, d in enumerate(_design(order)))
    rows = pairs.join(regression.select("g", "cos_coef", "sin_coef"), "g").withColumn("fitted", F.pmod(F.expr(f"atan2({fit('sin_coef')}, {fit('cos_coef')})"), F.lit(TAU)))
    return rows.withColumn("residual", F.pmod(F.col("y") - F.col("fitted"), F.lit(TAU))).drop("cos_coef", "sin_coef")


def residual_concentration(fits: DataFrame) -> DataFrame:
    """g, a_k (mean cosine of the residuals), kappa of them."""
    return fits.groupBy("g").agg(F.avg(F.cos("residual")).alias("a_k")).withColumn("kappa", F.expr(a1inv("a_k")))


def range_tail(n: int, gap: float) -> float:
    """Probability that n uniform angles leave a gap of this share of the circle or more, which is that of their range or a smaller one."""
    if n < 2 or gap <= 0:
        return 1.0
    # gaps are negatively associated, so that none reaches ``gap`` is at most this likely
    if n * math.log1p(-math.exp((n - 1) * math.log1p(-gap))) < math.log(1e-17) if gap < 1 else False:
        return 1.0
    with decimal.localcontext(prec=60):
        d, ways, total = decimal.Decimal(gap), decimal.Decimal(1), decimal.Decimal(0)
        for k in range(1, min(n, math.floor(1 / gap)) + 1):
            ways = ways * (n - k + 1) / k
            term = ways * max(1 - k * d, decimal.Decimal(0)) ** (n - 1)
            total += term if k % 2 else -term
            if k > 2 * n * math.exp(-n * gap) + 8 and term < decimal.Decimal("1e-30"):
                break
    return float(min(max(total, decimal.Decimal(0)), decimal.Decimal(1)))


def range_test(a: DataFrame) -> DataFrame:
    """g, n, range and the p_value of the test of uniformity by the circular range (small: the angles crowd into an arc)."""
    found = circ_range(a, digits=15).join(a.where("x is not null and not isnan(x)").groupBy("g").agg(F.count("*").alias("n")), "g")
    tail = F.pandas_udf(lambda n, r: pd.Series([range_tail(int(k), 1 - v / TAU) for k, v in zip(n, r, strict=True)], dtype="float64"), "double")
    return found.select("g", "n", "range", tail("n", "range").alias("p_value"))


def watson_vm(a: DataFrame) -> DataFrame:
    """Watson's test against the von Mises distribution that fits each group best: g, n, kappa, u2 and the band of its p-value.

    Null where the concentration is infinite (all angles equal).
    """
    fits = vm_ml(a, digits=15)
    z = a.join(fits, "g").select("g", fitted_cdf(F.pmod(F.col("x") - F.col("mu"), F.lit(TAU)), F.lit(0.0), F.col("kappa")).alias("x"))
    return watson_fitted(z.where("x is not null and not isnan(x)")).join(fits.select("g", "kappa"), "g").select("g", "n", "kappa", "u2", F.expr(WATSON_VM_BAND).alias("p_band"))


_PRIME = [np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)]


def _hashed(h: np.ndarray, value: np.ndarray, bits: int = 32) -> np.ndarray:
    """``xxhash64`` of one more integer column of so many bits, where ``h`` is that of the columns before."""
    p1, p2, p3, p4, p5 = _PRIME
    turned = lambda x, k: (x << np.uint64(k)) | (x >> np.uint64(64 - k))
    value = value.astype(np.int64).view(np.uint64)
    if bits == 32:
        h = turned((h + (p5 + np.uint64(4))) ^ ((value & np.uint64(0xFFFFFFFF)) * p1), 23) * p2
        h += p3
    else:
        h = turned((h + (p5 + np.uint64(8))) ^ (turned(value * p2, 31) * p1), 27) * p1
        h += p4
    h ^= h >> np.uint64(33)
    h *= p2
    h ^= h >> np.uint64(29)
    h *= p3
    h ^= h >> np.uint64(32)
    return h


#: Rows whose weights a task draws at once.
DRAWN = 64


def _weights(h: np.ndarray, reps: int, seed: int) -> np.ndarray:
    """Poisson weights of rows (by the ``xxhash64`` of their ids) in each repetition."""
    h = _hashed(h.view(np.uint64)[:, None], np.arange(1, reps + 1)[None])
    u = (_hashed(h, np.array([seed]), 32 if -(1 << 31) <= seed < 1 << 31 else 64) & np.uint64((1 << 30) - 1)).astype(np.uint32)
    out = np.zeros(u.shape, dtype=np.uint8)
    for c in np.cumsum([math.exp(-1) / math.factorial(k) for k in range(8)]):
        out += u >= np.uint32(math.ceil(c * (1 << 30)))
    return out


def _resampled(reps: int, seed: int):
    """Sums (g, rep, s, c, n) of a task's rows (g, h, s, c), sorted by g."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def summed() -> pa.RecordBatch:
            s, c, n = sums
            return pa.RecordBatch.from_arrays([
                pa.array([own] * reps, kind), pa.array(np.arange(1, reps + 1, dtype=np.int32)), *(pa.array(v) if some else pa.nulls(reps, pa.float64()) for v in (s, c)), pa.array(np.rint(n).astype(np.int64)),
            ], names=["g", "rep", "s", "c", "n"])

        own, some, sums, kind = None, False, None, None
        for batch in batches:
            g, kind = batch.column(0).to_pylist(), batch.schema.field(0).type
            h, rows = batch.column(1).to_numpy(zero_copy_only=False), len(g)
            there = batch.column(2).is_valid().to_numpy(zero_copy_only=False)
            x = np.stack([batch.column(i).fill_null(0.0).to_numpy(zero_copy_only=False) for i in (2, 3)] + [np.ones(rows)])
            cuts = [i for i in range(rows) if not i or g[i] != g[i - 1]] + [rows]
            for a, b in itertools.pairwise(cuts):
                if sums is None or g[a] != own:
                    if sums is not None:
                        yield summed()
                    own, some, sums = g[a], False, np.zeros((3, reps))
                some |= bool(there[a:b].any())
                for i in range(a, b, DRAWN):
                    to = min(b, i + DRAWN)
                    sums += x[:, i:to] @ _weights(h[i:to], reps, seed).astype(np.float64)
        if sums is not None:
            yield summed()

    return run


def bootstrap(a: DataFrame, reps: int = 1000, alpha: float = 0.05, seed: int = 1, bias: bool = False) -> DataFrame:
    """Percentile intervals of each group's mean direction, concentration and mean resultant length (low, high), by Poisson weights of every row and repetition.

    The weights come from a hash of row, repetition and seed, and each task sums those of its rows. The directions of the
    repetitions are cut at their widest gap, so ``mu_low`` may be negative; ``bias`` corrects the concentrations. Repetitions in which
    no row has a weight are left out, and those without a finite concentration (all directions equal) from its interval.
    """
    kind = a.schema["g"].dataType.simpleString()
    rows = a.select("g", F.xxhash64("id").alias("h"), F.sin("x").alias("s"), F.cos("x").alias("c"))
    rows = rows.repartition(tasks_of(a.sparkSession), "h").sortWithinPartitions("g")  # few bytes make much work: the input's own parts are too few
    parts = rows.mapInArrow(_resampled(reps, seed), f"g {kind}, rep int, s double, c double, n long")
    sums = parts.groupBy("g", "rep").agg(*[F.sum(c).alias(c) for c in "scn"]).where("n > 0")
    stat = sums.select("g", "n", F.pmod(F.atan2("s", "c"), F.lit(TAU)).alias("mu"), (F.sqrt(F.col("s") ** 2 + F.col("c") ** 2) / F.col("n")).alias("rho"))
    # a resultant within rounding of 1 has no finite concentration
    stat = stat.withColumn("kappa", F.when(F.col("rho") < 1 - 1e-12, F.expr(a1inv("rho"))))
    if bias:
        stat = stat.withColumn("kappa", F.expr("case when kappa < 2 then greatest(kappa - 2 / nullif(n * kappa, 0e0), 0e0) else pow(n - 1, 3) * kappa / (pow(n, 3) + n) end"))
    # one row a repetition: the direction after the widest gap is where they start
    own, by = Window.partitionBy("g"), Window.partitionBy("g").orderBy("mu")
    gap = F.col("mu") - F.coalesce(F.lag("mu").over(by), F.max("mu").over(own) - TAU)
    stat = stat.withColumn("gap", gap).withColumn("least", F.min("mu").over(own)).withColumn("start", F.max_by("mu", F.struct("gap", -F.col("mu"))).over(own))
    stat = stat.withColumn("turned", F.pmod(F.col("mu") - F.col("start"), F.lit(TAU)) + F.col("start") - F.when(F.col("start") > F.col("least"), TAU).otherwise(0.0))
    ends = (("low", alpha / 2), ("high", 1 - alpha / 2))
    return stat.groupBy("g").agg(*[F.percentile(c, F.lit(p)).alias(f"{n}{end}") for c, n in (("rho", ""), ("turned", "mu_"), ("kappa", "kappa_")) for end, p in ends])


def draws(ids: DataFrame, mu: float = 1.0, kappa: float = 2.0, rho: float = 0.5, alpha: float = 1.5, seed: int = 1) -> DataFrame:
    """One draw of each circular distribution for every row (id), fixed by the row's id and the seed."""
    u = lambda k: (F.pmod(F.xxhash64("id", F.lit(k), F.lit(seed)), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    wrap = lambda x: F.pmod(x, F.lit(TAU))
    normal = F.sqrt(-2 * F.log(u(1))) * F.cos(TAU * u(2))
    v, w = math.pi * (u(3) - 0.5), -F.log(u(4))
    stable = F.sin(alpha * v) / F.cos(v) ** (1 / alpha) * (F.cos((1 - alpha) * v) / w) ** ((1 - alpha) / alpha)
    mixture = F.when(u(6) < 0.5, quantile_column(u(5), mu, kappa)).otherwise(quantile_column(u(5), mu + math.pi, kappa))
    return ids.select(
        "id", quantile_column(u(5), mu, kappa).alias("von_mises"), mixture.alias("mixed"), wrap(mu + math.sqrt(-2 * math.log(rho)) * normal).alias("wrapped_normal"), wrap(mu - math.log(rho) * F.tan(math.pi * (u(7) - 0.5))).alias("wrapped_cauchy"), wrap(stable).alias("wrapped_stable"), stable.alias("stable"),
        wrap(mu + F.pandas_udf(lambda p: pd.Series(cardioid_quantile(p.to_numpy(), rho * 0.9)), "double")(u(8))).alias("cardioid"), F.pandas_udf(lambda p: pd.Series(triangular_quantile(p.to_numpy(), 0.2)), "double")(u(9)).alias("triangular"),
    )
