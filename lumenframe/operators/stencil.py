"""Neighbourhood operators: separable convolutions, edges, extrema and wavelets as window functions.

A pass along a row or a column is a window over (photo, row) or (photo, column): the pixels move once for each
direction and no pixel is copied for a tap. Beyond the edge the edge pixel counts (replicate).
"""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame

from ..sources.store import written
from .base import SqlOp
from .color import HSV, LUM

ALONG = {"cl": "photo_id, rw", "rw": "photo_id, cl"}


def conv(value: str, weights: list[float], axis: str) -> str:
    """SQL of a one-dimensional convolution (the kernel is flipped); null never occurs in a pixel relation."""
    k, terms = len(weights) // 2, []
    if len(weights) % 2 == 0:
        raise ValueError("kernels have odd sizes")
    over = f"(partition by {ALONG[axis]} order by {axis} rows between unbounded preceding and unbounded following)"
    step = f"(partition by {ALONG[axis]} order by {axis})"
    for i, weight in enumerate(weights):
        at = k - i  # out[x] = sum f[i] v[x + k - i]
        v = value if at == 0 else f"coalesce(lead({value}, {at}) over {step}, last_value({value}) over {over})" if at > 0 else f"coalesce(lag({value}, {-at}) over {step}, first_value({value}) over {over})"
        if weight:
            terms.append(f"{weight!r}e0 * {v}" if "e" not in repr(weight) else f"{weight!r} * {v}")
    return "(" + " + ".join(terms) + ")"


def gaussian(n: int, sigma: float) -> list[float]:
    k = [math.exp(-((i - n // 2) ** 2) / (2 * sigma * sigma)) for i in range(n)]
    return [x / sum(k) for x in k]


def mean(size: int) -> list[float]:
    return [1 / size] * size


def blurred(weights: list[float], channels: tuple[str, ...] = ("r", "g", "b")) -> str:
    """Adds <channel>_f: vertical, then horizontal pass."""
    first = "select *, " + ", ".join(f"{conv(c, weights, 'rw')} as {c}_v" for c in channels) + " from {px}"
    return "select *, " + ", ".join(f"{conv(c + '_v', weights, 'cl')} as {c}_f" for c in channels) + f" from ({first})"


def _snap(x: str) -> str:
    return f"(case when abs({x}) < 1e-12 then 0e0 when abs({x} - 1) < 1e-12 then 1e0 else {x} end)"


def _channels(form: str) -> str:
    return ", ".join(f"round({form.replace('@', c)}, 6) + 0e0 as {c}" for c in "rgb")


mean_blur = SqlOp(f"select photo_id, rw, cl, {_channels(_snap('@_f'))} from ({blurred(mean(3))})")


def gaussian_blurred(sigma: float) -> SqlOp:
    """Blur by a Gaussian of so many pixels, which reaches three of its deviations to every side."""
    return SqlOp(f"select photo_id, rw, cl, {_channels('@_f')} from ({blurred(gaussian(2 * math.ceil(3 * sigma) + 1, sigma))})")


gaussian_blur, gaussian_blur_narrow = gaussian_blurred(1.0), gaussian_blurred(0.6)
adjust_blur = SqlOp(f"select photo_id, rw, cl, {_channels('least(1e0, greatest(0e0, @ + (@ - @_f) * :factor))')} from ({blurred(mean(3))})", factor=-0.5)
sharp_blur_amount = SqlOp(f"select photo_id, rw, cl, {', '.join(f'round(abs({c} - {c}_f), 6) as sharp_{c}, round(1 - abs({c} - {c}_f), 6) as blur_{c}' for c in 'rgb')} from ({blurred(mean(3))})")

_GREY = f"select *, {LUM} as lum from {{px}}"
_SOBEL = f"select *, {conv('lum_s', [-1.0, 0.0, 1.0], 'cl')} as edge from (select *, {conv('lum', [1.0, 2.0, 1.0], 'rw')} as lum_s from ({_GREY}))"
sobel_edges = SqlOp(f"select photo_id, rw, cl, round(abs(edge), 6) as edge from ({_SOBEL})")

_NINE = [1 / 9] * 9


def _loss(axis: str) -> str:
    step = f"(partition by {ALONG[axis]} order by {axis})"
    blur = f"select *, {conv('lum', _NINE, axis)} as f from ({_GREY})"
    diff = f"select photo_id, abs(lum - lag(lum) over {step}) as d, abs(f - lag(f) over {step}) as e from ({blur})"
    return f"select photo_id, (sum(d) - sum(greatest(0e0, d - e))) / nullif(sum(d), 0) as blur from ({diff}) where d is not null group by photo_id"


blur_annoyance = SqlOp(f"""
select v.photo_id, round((3.79e0 / (1 + exp(10.72e0 * greatest(v.blur, x.blur) - 4.55e0)) + 1.13e0 - 1) / 4, 6) as quality
from ({_loss('rw')}) v join ({_loss('cl')}) x on v.photo_id = x.photo_id""")

_STEP = "(partition by photo_id, rw order by cl)"
_DIFF = f"select photo_id, rw, cl, w, lum, coalesce(lum - lag(lum) over {_STEP}, 0e0) as d0, coalesce(lead(lum) over {_STEP} - lum, 0e0) as d1 from ({_GREY})"
local_extrema = SqlOp(f"""
select photo_id, rw, cl, d0 <= 0 and d1 >= 0 as minimum, d0 >= 0 and d1 <= 0 as maximum, d0 < 0 and d1 > 0 as strict_minimum, d0 > 0 and d1 < 0 as strict_maximum
from ({_DIFF})""")

#: Edge strengths in 19 right-closed bins between the least and the largest of a photo; the first holds the least.
_BINNED = f"""
select photo_id, rw, cl, edge, lo, hi, case when hi = lo then 1 else cast(least(19e0, greatest(1e0, ceil(round((edge - lo) / (hi - lo) * 19, 9)))) as int) end as bin
from (select *, min(edge) over (partition by photo_id) as lo, max(edge) over (partition by photo_id) as hi from (select photo_id, rw, cl, round(abs(edge), 9) as edge from ({_SOBEL})))"""
_BINS = "values " + ", ".join(f"({i})" for i in range(1, 20))
_OTSU = f"""
with binned as ({_BINNED}),
counts as (select photo_id, bin, count(*) as n from binned group by 1, 2),
ids as (select distinct photo_id from counts),
freq as (select ids.photo_id, t.bin, coalesce(c.n, 0) as n from ids cross join ({_BINS}) t(bin) left join counts c on c.photo_id = ids.photo_id and c.bin = t.bin),
cum as (select photo_id, bin, sum(n) over (partition by photo_id order by bin) as n0, sum(n * bin) over (partition by photo_id order by bin) as s0, sum(n) over (partition by photo_id) as nt, sum(n * bin) over (partition by photo_id) as st from freq),
between_ as (select photo_id, bin, round(cast(n0 as double) / nt * (nt - n0) / nt * pow(cast(s0 as double) / nullif(n0, 0) - cast(st - s0 as double) / nullif(nt - n0, 0), 2), 9) as v from cum),
best as (select photo_id, min(bin) as threshold from (select *, max(v) over (partition by photo_id) as most from between_) where v = most group by photo_id)"""
otsu = SqlOp(_OTSU + " select photo_id, threshold from best")
_EDGES = _OTSU + f""",
edges as (select b.photo_id, b.rw, b.cl, case when b.hi = b.lo then false else b.edge >= b.lo + (t.threshold - 0.5e0) * (b.hi - b.lo) / 19 end as is_edge from binned b join best t on b.photo_id = t.photo_id),
islands as (select *, cl - row_number() over {_STEP} as g from edges where is_edge),
mids as (select photo_id, rw, min(cl) + cast(ceil((max(cl) - min(cl)) / 2e0) as int) as cl from islands group by photo_id, rw, g)"""
edge_midpoints = SqlOp(_EDGES + " select photo_id, rw, cl from mids")


def _enclosing(kind: str, flag: str) -> str:
    """The extremum at or before each edge's midpoint and the next one; the outermost interval at the ends of a row.

    A midpoint at an extremum of which none before it is missing (the i-th at column i) has that one for the next as well.
    """
    return f"""
{kind}_all as (select photo_id, rw, cl, row_number() over {_STEP} as i, lead(cl) over {_STEP} as nxt, lag(cl) over {_STEP} as before, max(cl) over (partition by photo_id, rw) as last from ext where {flag}),
{kind}_of as (select m.photo_id, m.rw, m.cl, e.cl as prev, case when m.cl = e.cl and e.cl = e.i then e.cl else e.nxt end as nxt from mids m join {kind}_all e on e.photo_id = m.photo_id and e.rw = m.rw and e.nxt is not null
  and (e.cl <= m.cl or e.before is null) and (m.cl < e.nxt or e.nxt = e.last))"""


_WIDTHS = f"""
ext as (select photo_id, rw, cl, d0 <= 0 and d1 >= 0 as is_min, d0 >= 0 and d1 <= 0 as is_max from ({_DIFF})),
{_enclosing('mins', 'is_min')},
{_enclosing('maxs', 'is_max')},
widths as (select a.photo_id, least(a.nxt - b.prev, b.nxt - a.prev) as width from mins_of a join maxs_of b on a.photo_id = b.photo_id and a.rw = b.rw and a.cl = b.cl),
score as (select m.photo_id, sum(x.width) / cast(max(m.n) as double) as score from (select photo_id, count(*) as n from mids group by 1) m left join widths x on x.photo_id = m.photo_id group by m.photo_id)
select photo_id, round(score, 6) as score, round(1 - (least(10e0, greatest(1e0, pow(score, 1.04e0) - 4.5e0)) - 1) / 9, 6) as gaussian,
  round(1 - (least(10e0, greatest(1e0, 17.5e0 * pow(greatest(0e0, score - 3), 0.3e0) - 19.5e0)) - 1) / 9, 6) as jpeg2k from score"""
mdwe = SqlOp(_EDGES + "," + _WIDTHS)
_MDWE_OF = SqlOp("with mids as (select photo_id, rw, cl from {mids})," + _WIDTHS)


def edge_widths(px: DataFrame) -> DataFrame:
    """``mdwe`` with the midpoints of edges as a table, as they are read three times."""
    return _MDWE_OF(written(edge_midpoints(px), "mids"), px)


# wavelets: taps of the scaling filter of order 4
_G = [(1 + math.sqrt(3)) / (4 * math.sqrt(2)), (3 + math.sqrt(3)) / (4 * math.sqrt(2)), (3 - math.sqrt(3)) / (4 * math.sqrt(2)), (1 - math.sqrt(3)) / (4 * math.sqrt(2))]
_H = [(-1) ** i * _G[3 - i] for i in range(4)]


def _taps(value: str, taps: list[float], axis: str) -> str:
    """At an odd place p (from 0): the sum of taps[i] v[p - i], around the end."""
    part = "photo_id, channel, " + {"rw": "cl", "cl": "rw"}[axis]
    step = f"(partition by {part} order by {axis})"
    far = f"(partition by {part} order by {axis} desc rows between unbounded preceding and unbounded following)"
    v = [value, f"lag({value}) over {step}", f"coalesce(lag({value}, 2) over {step}, first_value({value}) over {far})", f"coalesce(lag({value}, 3) over {step}, nth_value({value}, 2) over {far})"]
    return "(" + " + ".join(f"({t!r}e0) * {x}" for t, x in zip(taps, v, strict=True)) + ")"


def _level(source: str) -> str:
    """One level of the transform of rows (photo_id, channel, h, w, rw, cl from 0, x): ll, lh, hl, hh at half the size."""
    down = f"select photo_id, channel, h, w, rw, cl, {_taps('x', _G, 'rw')} as lo, {_taps('x', _H, 'rw')} as hi from {source}"
    half = f"select photo_id, channel, cast(floor(h / 2e0) as int) as h, w, cast(floor(rw / 2e0) as int) as rw, cl, lo, hi from ({down}) where rw % 2 = 1"
    both = ", ".join(f"{_taps(a, t, 'cl')} as {n}" for n, a, t in (("ll", "lo", _G), ("lh", "lo", _H), ("hl", "hi", _G), ("hh", "hi", _H)))
    return f"select photo_id, channel, h, cast(floor(w / 2e0) as int) as w, rw, cast(floor(cl / 2e0) as int) as cl, ll, lh, hl, hh from (select photo_id, channel, h, w, rw, cl, {both} from ({half})) where cl % 2 = 1"


_CHANNELS = f"""select photo_id, t.channel, h, w, rw - 1 as rw, cl - 1 as cl, case t.channel when 'hue' then coalesce(hue, 0e0) / 360 when 'sat' then sat else val end as x
  from ({HSV}) cross join (values ('hue'), ('sat'), ('val')) t(channel)"""
_NEXT = "select photo_id, channel, h, w, rw, cl, ll as x from {0} where h >= 2 and w >= 2"
_WAVES = f"""
with l0 as ({_CHANNELS}),
w1 as ({_level('l0')}),
l1 as ({_NEXT.format('w1')}),
w2 as ({_level('l1')}),
l2 as ({_NEXT.format('w2')}),
w3 as ({_level('l2')})"""
_TEXTURE = """
select photo_id, channel, round(max(case when level = 1 then texture end), 6) as level1, round(max(case when level = 2 then texture end), 6) as level2, round(max(case when level = 3 then texture end), 6) as level3, round(sum(texture), 6) as total
from (select photo_id, channel, level, sum(abs(hh) + abs(hl) + abs(lh)) / (3 * count(*)) as texture from (
  select photo_id, channel, 1 as level, hh, hl, lh from {w1} union all select photo_id, channel, 2, hh, hl, lh from {w2} union all select photo_id, channel, 3, hh, hl, lh from {w3}) group by 1, 2, 3)
group by photo_id, channel"""
#: Share of the third level's detail in the middle blocks (2nd to 4th of 5 in both directions) against that of an even spread.
_MID = "{0} + 1 between floor(1 + ({1} - 1) / 5e0 + 0.5e0) and floor(1 + 4 * ({1} - 1) / 5e0 + 0.5e0)"
_DOF = f"""
select photo_id, channel, round(case when sum(detail) = 0 then 0 else sum(detail * middle) / sum(detail) / (sum(middle) / cast(count(*) as double)) - 1 end, 5) + 0e0 as dof
from (select photo_id, channel, abs(hh) + abs(hl) + abs(lh) as detail, case when {_MID.format('rw', 'h')} and {_MID.format('cl', 'w')} then 1 else 0 end as middle from {{w3}}) group by photo_id, channel"""
_named = lambda text: re.sub(r"\{(w\d)\}", r"\1", text)
wavelet_texture, wavelet_dof = SqlOp(_WAVES + _named(_TEXTURE)), SqlOp(_WAVES + _named(_DOF))
_FIRST, _FURTHER = SqlOp(f"with l as ({_CHANNELS}) {_level('l')}"), SqlOp(f"with l as ({_NEXT.format('{w}')}) {_level('l')}")
_TEXTURE_OF, _DOF_OF = SqlOp(_TEXTURE), SqlOp(_DOF)


def wavelets(px: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``wavelet_texture`` and ``wavelet_dof`` of the same three levels, each level a table; its rows are dealt by their photo, once for both directions."""
    levels = [written(_FIRST(px), "level")]
    for _ in range(2):
        levels.append(written(_FURTHER(levels[-1].repartition("photo_id")), "level"))
    return _TEXTURE_OF(*levels), _DOF_OF(levels[-1])


def conv2(weights: list[list[float]], value: str = LUM, shape: str = "same", pad: float = 0.0) -> SqlOp:
    """Two-dimensional convolution with any odd kernel; beyond the edge lies ``pad``.

    ``shape`` is that of the result: ``same`` as the photo, ``reach`` (every place a pixel reaches), or ``valid``
    (places whose kernel lies inside). Every pixel sends its weighted value to the places around it, and places
    sum what they get: one aggregation with partial sums, no join of pixels with pixels. Separable kernels are
    cheaper as two passes of ``conv``.
    """
    n, m = len(weights), len(weights[0])
    if n % 2 == 0 or m % 2 == 0 or any(len(row) != m for row in weights):
        raise ValueError("kernels have odd sizes")
    if shape not in ("same", "reach", "valid"):
        raise ValueError(f"no such shape: {shape}")
    out = {"same": 0, "reach": 1, "valid": -1}[shape]
    down, right = out * (n // 2), out * (m // 2)
    total = sum(map(sum, weights))
    taps = ", ".join(f"({i - n // 2}, {j - m // 2}, cast({w!r} as double))" for i, row in enumerate(weights) for j, w in enumerate(row) if w)
    return SqlOp(f"""
select photo_id, rw + {down} as rw, cl + {right} as cl, round(sum(x) + {pad!r}e0 * ({total!r}e0 - sum(weight)), 6) + 0e0 as v
from (select photo_id, h, w, rw + dr as rw, cl + dc as cl, weight, weight * {value} as x from {{px}} cross join (values {taps}) k(dr, dc, weight))
where rw between 1 - {down} and h + {down} and cl between 1 - {right} and w + {right} group by photo_id, rw, cl""")


def conv2_inner(weights: list[list[float]], value: str = LUM, shape: str = "same") -> SqlOp:
    """Two-dimensional convolution without padding: only places whose kernel lies inside are computed.

    ``same`` gives those, numbered from 1; ``full`` the photo's size, with the photo's own values along the border; ``valid``
    leaves out another border of the kernel's half size.
    """
    down, right = len(weights) // 2, len(weights[0]) // 2
    if shape not in ("same", "full", "valid"):
        raise ValueError(f"no such shape: {shape}")
    inner = conv2(weights, value, "valid").raw
    if shape == "same":
        return SqlOp(inner)
    if shape == "full":
        border = f"rw <= {down} or rw > h - {down} or cl <= {right} or cl > w - {right}"
        return SqlOp(f"select photo_id, rw + {down} as rw, cl + {right} as cl, v from ({inner}) union all select photo_id, rw, cl, round({value}, 6) + 0e0 as v from {{px}} where {border}")
    return SqlOp(f"""
select c.photo_id, c.rw - {down} as rw, c.cl - {right} as cl, v from ({inner}) c join (select photo_id, max(h) as h, max(w) as w from {{px}} group by photo_id) p on p.photo_id = c.photo_id
where c.rw > {down} and c.rw <= h - {3 * down} and c.cl > {right} and c.cl <= w - {3 * right}""")


def padded(rows: int, cols: int, pad: float | str = "replicate") -> SqlOp:
    """The pixel relation with so many rows and columns more on every side: of a number, or of the pixels at the edge."""
    if isinstance(pad, str) and pad != "replicate":
        raise ValueError(f"no such padding: {pad}")
    beyond = lambda d, at, size: f"({d} = 0 or ({d} < 0 and {at} = 1) or ({d} > 0 and {at} = {size}))"
    steps = lambda n: "(values " + ", ".join(f"({i})" for i in range(-n, n + 1)) + ")"
    value = lambda c: c if pad == "replicate" else f"case when dr = 0 and dc = 0 then {c} else {float(pad)!r}e0 end"
    return SqlOp(f"""
select photo_id, h + {2 * rows} as h, w + {2 * cols} as w, rw + dr + {rows} as rw, cl + dc + {cols} as cl, {', '.join(f'{value(c)} as {c}' for c in 'rgb')}
from {{px}} cross join {steps(rows)} y(dr) cross join {steps(cols)} x(dc)
where {beyond('dr', 'rw', 'h')} and {beyond('dc', 'cl', 'w')}""")


def gaussian_kernel(n: int, sigma: float) -> list[list[float]]:
    """Weights of a two-dimensional Gaussian of n by n places, which sum to 1."""
    side = [math.exp(-((i - (n - 1) / 2) ** 2) / (2 * sigma * sigma)) for i in range(n)]
    return [[a * b / sum(side) ** 2 for b in side] for a in side]


_EMBOSS = [[-1.0, -2.0, -1.0], [0.0, 0.0, 0.0], [1.0, 2.0, 1.0]]
emboss = conv2(_EMBOSS)
emboss_reach, emboss_valid, emboss_padded = conv2(_EMBOSS, shape="reach"), conv2(_EMBOSS, shape="valid"), conv2([[0.0, 1.0, 0.0], [1.0, 2.0, 1.0], [0.0, 1.0, 0.0]], pad=0.5)
gaussian_blur_2d = conv2(gaussian_kernel(5, 1.2))
emboss_full, emboss_trimmed = conv2_inner(_EMBOSS, shape="full"), conv2_inner(_EMBOSS, shape="valid")
pad_replicate, pad_number = padded(1, 2), padded(2, 1, -0.25)
