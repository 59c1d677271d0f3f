"""Circular statistics of angle columns: aggregates, tests and densities of rows (g: group, x: radians)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame

from .base import SqlOp

TAU = "(2 * pi())"


def modulo(x: str, m: str = TAU) -> str:
    return f"((({x}) % {m} + {m}) % {m})"


def a1inv(x: str) -> str:
    """Concentration for a mean resultant length; null where it is infinite."""
    return f"(case when {x} >= 0 and {x} < 0.53e0 then 2 * {x} + pow({x}, 3) + 5 * pow({x}, 5) / 6 when {x} < 0.85e0 then -0.4e0 + 1.39e0 * {x} + 0.43e0 / (1 - {x}) when {x} >= 1 then null else 1 / (pow({x}, 3) - 4 * {x} * {x} + 3 * {x}) end)"


def bessel(p: int, x: str, terms: int = 40) -> str:
    """Modified Bessel function of the first kind and order p, for arguments up to about 30, as a nested series."""
    t, out = f"({x} * {x} / 4e0)", "1e0"
    for k in range(terms, 0, -1):
        out = f"(1e0 + {t} / {k * (k + p)}e0 * {out})"
    return f"(pow({x} / 2e0, {p}) / {math.factorial(p)}e0 * {out})"


class TwoLevel(SqlOp):
    """An operator with a plan of its own on Spark, which counts in two levels; ``text`` says the same in one window for the oracle."""

    def __init__(self, text: str, plan: str, **defaults: float) -> None:
        super().__init__(text, **defaults)
        self.plan = SqlOp(plan, **defaults)

    def __call__(self, *frames: DataFrame, **params: float) -> DataFrame:
        return self.plan(*frames, **params)


#: Cells of equal width in which rows are ordered; running values over cells are added to those within each.
CELLS = 4096


def in_cells(points: str, sums: str, order: str, cell: str) -> str:
    """Common table expressions up to ``ranked``: the rows of ``points`` (g, ``order``, and ``sums``, a space between their names) with ``<sum>0`` for
    what lies before a row and ``<sum>n`` for the whole of its g, the next value in ``nxt`` and the first in ``first``. No window holds more than a cell's rows, or a row a cell."""
    names = sums.split()
    before = "rows between unbounded preceding and 1 preceding"
    return f"""
points as (select *, {cell} as cell from ({points})),
cells as (select g, cell, min({order}) as least, {', '.join(f'sum({c}) as {c}' for c in names)} from points group by g, cell),
heads as (select g, cell, lead(least) over (partition by g order by cell) as after, min(least) over (partition by g) as first,
  {', '.join(f'coalesce(sum({c}) over (partition by g order by cell {before}), 0) as {c}0, sum({c}) over (partition by g) as {c}n' for c in names)} from cells),
ranked as (select p.g, p.{order}, {', '.join(f'p.{c}, h.{c}n, h.{c}0 + coalesce(sum(p.{c}) over (partition by p.g, p.cell order by p.{order} {before}), 0) as {c}0' for c in names)},
  coalesce(lead(p.{order}) over (partition by p.g, p.cell order by p.{order}), h.after) as nxt, h.first from points p join heads h on p.g <=> h.g and p.cell <=> h.cell)"""


_CELL = f"case when isnan(x) then {CELLS} else cast(floor(x / {TAU} * {CELLS}) as int) end"

_SUMS = "select g, count(*) as n, sum(sin(x)) as s, sum(cos(x)) as c from {a} group by g"
_MEAN = f"select g, n, atan2(s, c) as mu, sqrt(s * s + c * c) as r, sqrt(s * s + c * c) / n as rbar from ({_SUMS})"

circ_summary = SqlOp(f"select g, n, round(mu, 6) as mean_dir, round(rbar, 6) as rho from ({_MEAN})")
circ_disp = SqlOp(f"select g, n, round(r, 5) as r, round(rbar, 6) as rbar, round(1 - rbar, 6) as var from ({_MEAN})")
trig_moment = SqlOp(f"""
select m.g, round(atan2(avg(sin(:p * (x - :center * mu))), avg(cos(:p * (x - :center * mu)))), 6) as mu_p, round(sqrt(pow(avg(sin(:p * (x - :center * mu))), 2) + pow(avg(cos(:p * (x - :center * mu))), 2)), 6) as rho_p,
  round(avg(cos(:p * (x - :center * mu))), 6) as cos_p, round(avg(sin(:p * (x - :center * mu))), 6) as sin_p
from {{a}} a join ({_MEAN}) m on a.g = m.g group by m.g""", p=2, center=0)
rayleigh = SqlOp(f"""
select g, round(rbar, 6) as rbar, round(exp(-z) * case when n < 50 then 1 + (2 * z - z * z) / (4 * n) - (24 * z - 132 * z * z + 76 * pow(z, 3) - 9 * pow(z, 4)) / (288e0 * n * n) else 1 end, 6) as p_value
from (select *, n * rbar * rbar as z from ({_MEAN}))""")
_KAPPA = f"select g, n, mu, {a1inv('a')} as kappa from (select m.g, m.n, m.mu, avg(cos(x - mu)) as a from {{a}} a join ({_MEAN}) m on a.g = m.g group by m.g, m.n, m.mu)"
est_kappa = SqlOp(f"select g, round(kappa, 6) as kappa, round(case when kappa < 2 then greatest(kappa - 2 / (n * kappa), 0e0) else pow(n - 1, 3) * kappa / (pow(n, 3) + n) end, 6) as kappa_unbiased from ({_KAPPA})")
vm_ml = SqlOp(f"select g, round(mu, :digits) as mu, round(kappa, :digits) as kappa from ({_KAPPA})", digits=6)
circ_cor = SqlOp("""
with m as (select g, atan2(sum(sin(x)), sum(cos(x))) as mx, atan2(sum(sin(y)), sum(cos(y))) as my from {pairs} group by g),
d as (select p.g, sin(p.x - coalesce(m.mx, 0e0)) as a, sin(p.y - m.my) as b from {pairs} p join m on p.g = m.g)
select g, round(sum(a * b) / sqrt(sum(a * a) * sum(b * b)), 6) as r, round(sqrt(count(*) * avg(a * a) * avg(b * b) / avg(a * a * b * b)) * sum(a * b) / sqrt(sum(a * a) * sum(b * b)), 5) as test_stat from d group by g""")

_SORTED = f"select g, x, row_number() over (partition by g order by x) as i, count(*) over (partition by g) as n, lead(x) over (partition by g order by x) as nxt, min(x) over (partition by g) as x1 from (select g, {modulo('x')} as x from {{a}})"
# equal angles are one row of m: those ranked m0 + 1 to m0 + m
_RANKED = "with " + in_cells(f"select g, x, count(*) as m from (select g, {modulo('x')} as x from {{a}}) group by g, x", "m", "x", _CELL)
_GAP = f"coalesce(nxt, first + {TAU}) - x"
circ_range = TwoLevel(f"select g, round(2 * pi() - max(coalesce(nxt, x1 + 2 * pi()) - x), :digits) as range from ({_SORTED}) group by g", f"{_RANKED} select g, round({TAU} - max({_GAP}), :digits) as range from ranked group by g", digits=6)
rao_spacing = TwoLevel(f"select g, round(sum(abs(degrees(coalesce(nxt, x1 + 2 * pi()) - x) - 360e0 / n)) / 2, 5) as u from ({_SORTED}) group by g",
    f"{_RANKED} select g, round(sum(abs(degrees({_GAP}) - 360e0 / mn) + (m - 1) * (360e0 / mn)) / 2, 5) as u from ranked group by g")
#: Upper points of Kuiper's statistic.
_BAND = "case when v < 1.537e0 then 'p > 0.15' when v < 1.62e0 then '0.10 < p < 0.15' when v < 1.747e0 then '0.05 < p < 0.10' when v < 1.862e0 then '0.025 < p < 0.05' when v < 2.001e0 then '0.01 < p < 0.025' else 'p < 0.01' end"
kuiper = TwoLevel(f"""
select g, v, {_BAND} as p_band
from (select g, round((max(i / cast(n as double) - x / {TAU}) + max(x / {TAU} - (i - 1) / cast(n as double))) * (sqrt(max(n)) + 0.155e0 + 0.24e0 / sqrt(max(n))), 6) as v from ({_SORTED}) group by g)""", f"""
{_RANKED} select g, v, {_BAND} as p_band
from (select g, round((max((m0 + m) / cast(mn as double) - x / {TAU}) + max(x / {TAU} - m0 / cast(mn as double))) * (sqrt(max(mn)) + 0.155e0 + 0.24e0 / sqrt(max(mn))), 6) as v from ranked group by g)""")
watson_uniform = TwoLevel(f"""
select g, round((u2 - 0.1e0 / n + 0.1e0 / (cast(n as double) * n)) * (1 + 0.8e0 / n), 6) as u2
from (select g, max(n) as n, sum(pow(u - ubar - (2 * i - 1) / (2e0 * n) + 0.5e0, 2)) + 1 / (12e0 * max(n)) as u2 from (select *, x / {TAU} as u, avg(x / {TAU}) over (partition by g) as ubar from ({_SORTED})) group by g)""", f"""
{_RANKED}, means as (select g, sum(m * x) / sum(case when x is not null then m end) / {TAU} as ubar from points group by g)
select g, round((u2 - 0.1e0 / n + 0.1e0 / (cast(n as double) * n)) * (1 + 0.8e0 / n), 6) as u2
from (select r.g, max(mn) as n, sum(m * pow(x / {TAU} - ubar - (2 * m0 + m) / (2e0 * mn) + 0.5e0, 2) + (pow(m, 3) - m) / (12e0 * mn * mn)) + 1 / (12e0 * max(mn)) as u2 from ranked r join means on r.g <=> means.g group by r.g)""")
#: Upper points of Watson's statistics, of one sample against the uniform distribution and of two samples.
_UNIFORM_BAND = "case when u2 > 0.267e0 then 'p < 0.01' when u2 > 0.221e0 then '0.01 < p < 0.025' when u2 > 0.187e0 then '0.025 < p < 0.05' when u2 > 0.152e0 then '0.05 < p < 0.10' else 'p > 0.10' end"
_TWO_BAND = "case when u2 > 0.385e0 then 'p < 0.001' when u2 > 0.268e0 then '0.001 < p < 0.01' when u2 > 0.187e0 then '0.01 < p < 0.05' when u2 > 0.152e0 then '0.05 < p < 0.10' else 'p > 0.10' end"


class Banded(TwoLevel):
    """A test with the band of its p-value."""

    def __init__(self, test: TwoLevel, band: str) -> None:
        head = f"select *, {band} as p_band from"
        super().__init__(f"{head} ({test.raw}) t", f"{head} ({test.plan.raw}) t")


#: Upper points of Watson's statistic for a fitted von Mises distribution: concentration below, then the 10 %, 5 % and 1 % points.
WATSON_VM_POINTS = (
    (0.25, 0.052, 0.061, 0.081), (0.75, 0.056, 0.066, 0.09), (1.25, 0.066, 0.079, 0.11), (1.75, 0.077, 0.092, 0.128), (3, 0.084, 0.101, 0.142), (5, 0.093, 0.113, 0.158), (float("inf"), 0.096, 0.117, 0.164),
)
WATSON_VM_BAND = "case " + " ".join(f"when kappa < {'double(\'inf\')' if k == float('inf') else k} then case when u2 < {a}e0 then 'p > 0.10' when u2 < {b}e0 then '0.05 < p < 0.10' when u2 < {c}e0 then '0.01 < p < 0.05' else 'p < 0.01' end" for k, a, b, c in WATSON_VM_POINTS) + " end"
#: Watson's statistic of probabilities x under a fitted distribution, against evenly spread ones.
watson_fitted = SqlOp("with " + in_cells("select g, x, count(*) as m from {a} group by g, x", "m", "x", f"cast(floor(x * {CELLS}) as int)") + """
select g, max(mn) as n, round(sum(m * pow(x - (2 * m0 + m) / (2e0 * mn), 2) + (pow(m, 3) - m) / (12e0 * mn * mn)) - max(mn) * pow(sum(m * x) / max(mn) - 0.5e0, 2) + 1 / (12e0 * max(mn)), 6) as u2 from ranked group by g""")
watson_two = TwoLevel(f"""
with o as (select side, sum(case when side = 1 then 1 else 0 end) over (order by x, side rows between unbounded preceding and current row) as a, sum(case when side = 2 then 1 else 0 end) over (order by x, side rows between unbounded preceding and current row) as b,
  sum(case when side = 1 then 1 else 0 end) over () as n1, sum(case when side = 2 then 1 else 0 end) over () as n2 from (select side, {modulo('x')} as x from {{two}}))
select max(n1) as n1, max(n2) as n2, round(cast(max(n1) as double) * max(n2) / (cast(count(*) as double) * count(*)) * (sum(pow(b / cast(n2 as double) - a / cast(n1 as double), 2)) - pow(sum(b / cast(n2 as double) - a / cast(n1 as double)), 2) / count(*)), 6) as u2 from o""", f"""
with {in_cells(f"select 0 as g, x, count_if(side = 1) as a, count_if(side = 2) as b from (select side, {modulo('x')} as x from {{two}}) group by x", "a b", "x", _CELL)},
t as (select cast(an as double) as n1, cast(bn as double) as n2, an + bn as n, a, b, b0 / cast(bn as double) - a0 / cast(an as double) as d0 from ranked),
u as (select *, d0 - (a + 1) / (2 * n1) as da, d0 - a / n1 + (b + 1) / (2 * n2) as db from t)
select cast(max(n1) as bigint) as n1, cast(max(n2) as bigint) as n2, round(max(n1) * max(n2) / (cast(max(n) as double) * max(n)) * (
  sum(a * da * da + (pow(a, 3) - a) / (12 * n1 * n1) + b * db * db + (pow(b, 3) - b) / (12 * n2 * n2)) - pow(sum(a * da + b * db), 2) / max(n)), 6) as u2 from u""")
watson_uniform_test, watson_two_test = Banded(watson_uniform, _UNIFORM_BAND), Banded(watson_two, _TWO_BAND)
rao_homogeneity = SqlOp("""
with m as (select g, count(*) as n, avg(cos(x)) as x, avg(sin(x)) as y, var_samp(cos(x)) as co, var_samp(sin(x)) as ss, covar_samp(cos(x), sin(x)) as cs from {a} group by g),
s as (select y / x as t, x * x + y * y as u, (ss / (x * x) + y * y * co / pow(x, 4) - 2 * y * cs / pow(x, 3)) / n as polar, 4 * (x * x * co + y * y * ss + 2 * x * y * cs) / n as disp from m)
select count(*) - 1 as df, round(sum(t * t / polar) - pow(sum(t / polar), 2) / sum(1 / polar), 5) as h_polar, round(sum(u * u / disp) - pow(sum(u / disp), 2) / sum(1 / disp), 5) as h_disp from s""")
change_point = TwoLevel(f"""
with o as (select g, k, n, sin(x) as s, cos(x) as c from (select g, x, row_number() over (partition by g order by o) as k, count(*) over (partition by g) as n from {{ordered}})),
w as (select g, k, n, s, c, sum(s) over (partition by g order by k) as s1, sum(c) over (partition by g order by k) as c1, sum(s) over (partition by g) as st, sum(c) over (partition by g) as ct from o),
p as (select g, k, n, sqrt(s1 * s1 + c1 * c1) as r1, sqrt((st - s1) * (st - s1) + (ct - c1) * (ct - c1)) as r2, sqrt(st * st + ct * ct) as r from w),
d as (select g, k, n, r, r1 + case when k = n then 0 else r2 end - r as diff from p)
select g, max(n) as n, round(max(r) / max(n), 6) as rho, round(max(diff), 5) as rmax, round(avg(diff), 5) as rave from d group by g""", f"""
with {in_cells("select g, o, sin(x) as s, cos(x) as c, 1 as k, lo, hi from {ordered} cross join (select min(o) as lo, max(o) as hi from {ordered})", "s c k", "o", f"case when hi > lo then cast(floor((cast(o as double) - lo) / (cast(hi as double) - lo) * {CELLS}) as int) else 0 end")},
w as (select g, k0 + 1 as k, kn as n, s0 + s as s1, c0 + c as c1, sn as st, cn as ct from ranked),
p as (select g, k, n, sqrt(s1 * s1 + c1 * c1) as r1, sqrt((st - s1) * (st - s1) + (ct - c1) * (ct - c1)) as r2, sqrt(st * st + ct * ct) as r from w),
d as (select g, k, n, r, r1 + case when k = n then 0 else r2 end - r as diff from p)
select g, max(n) as n, round(max(r) / max(n), 6) as rho, round(max(diff), 5) as rmax, round(avg(diff), 5) as rave from d group by g""")
rose_bins = SqlOp(f"""
select g, bin, n, round(sqrt(n / cast(sum(n) over (partition by g) as double)), 6) as radius
from (select g, cast(least(:bins, greatest(1, ceil({modulo('x')} / ({TAU} / :bins)))) as int) as bin, count(*) as n from {{a}} group by 1, 2)""", bins=12)
edf = TwoLevel(f"select g, round(x, 6) as x, round(max(i) / cast(max(n) as double), 6) as f from ({_SORTED}) group by g, x", f"{_RANKED} select g, round(x, 6) as x, round((m0 + m) / cast(mn as double), 6) as f from ranked")
circular_convert = SqlOp(f"""
select id, round(degrees(x), 6) as degrees, round(x * 12 / pi(), 6) as hours, round(({modulo('-x + pi() / 2')}), 6) as geographic, round(({modulo('2 * x')}), 6) as doubled, round(radians(degrees(x)), 6) as back from {{points}}""")
bessel_ratio = SqlOp(f"""
select k, round(i0, 6) as i0, round(i1, 6) as i1, round(i2, 6) as i2, round(i1 / i0, 6) as a1, round({a1inv('(i1 / i0)')}, 6) as a1inv
from (select k, {bessel(0, 'k')} as i0, {bessel(1, 'k')} as i1, {bessel(2, 'k')} as i2 from {{kappas}})""")

bessel_orders = SqlOp(f"select k, {', '.join(f'round({bessel(p, 'k')}, 6) as i{p}' for p in range(3, 8))} from {{kappas}}")

#: Ways to choose k of n; 0 where k is above n. A product of quotients, so that nothing overflows before the result does.
binomial = TwoLevel("select n, k, case when k > n then 0 else cast(round(exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1))) as bigint) end as ways from {numbers}",
    "select n, k, case when k > n then 0 when k = 0 then 1 else cast(round(aggregate(sequence(1, cast(k as int)), 1e0, (a, i) -> a * (n - k + i) / i)) as bigint) end as ways from {numbers}")


def wrapped_normal(x: str, mu: str, rho: str, terms: int = 8) -> str:
    var = f"(-2 * ln({rho}))"
    return "(" + " + ".join(f"exp(-pow({x} - {mu} + 2 * pi() * {k}, 2) / (2 * {var}))" for k in range(-terms, terms + 1)) + f") / sqrt(2 * pi() * {var})"


def von_mises(x: str, mu: str, kappa: str) -> str:
    return f"(exp({kappa} * cos({x} - {mu})) / (2 * pi() * {bessel(0, kappa)}))"


circular_densities = SqlOp(f"""
select id, round({von_mises('x', ':mu', ':kappa')}, 6) as von_mises, round(:share * {von_mises('x', ':mu', ':kappa')} + (1 - :share) * {von_mises('x', ':mu2', ':kappa2')}, 6) as mixed, round((1 + 2 * :rho * cos(x - :mu)) / (2 * pi()), 6) as cardioid,
  round((1 - :rho * :rho) / (2 * pi() * (1 + :rho * :rho - 2 * :rho * cos(x - :mu))), 6) as wrapped_cauchy, round((4 - pi() * pi() * :r + 2 * pi() * :r * abs(pi() - x)) / (8 * pi()), 6) as triangular, round({wrapped_normal('x', ':mu', ':rho')}, 6) as wrapped_normal
from {{points}}""", mu=1.0, kappa=2.5, share=0.6, mu2=4.0, kappa2=1.5, rho=0.4, r=0.2)
#: Logs of the von Mises density and of a mixture of two.
log_densities = SqlOp(f"select id, round(:kappa * cos(x - :mu) - ln(2 * pi() * {bessel(0, ':kappa')}), 6) as von_mises, round(ln(:share * {von_mises('x', ':mu', ':kappa')} + (1 - :share) * {von_mises('x', ':mu2', ':kappa2')}), 6) as mixed from {{points}}", mu=1.0, kappa=2.5, share=0.6, mu2=4.0, kappa2=1.5)
