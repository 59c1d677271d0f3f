"""Colour spaces, channels and scalar channel arithmetic over a pixel relation (r, g, b in [0, 1])."""

from __future__ import annotations

from .base import SqlOp
from .circular import TwoLevel, a1inv

#: Relative luminance without gamma.
LUM = "(0.212673e0 * r + 0.715152e0 * g + 0.072175e0 * b)"
KEY = "photo_id, rw, cl"

HUE = "case when d = 0 then null when b > greatest(r, g) then 60 * ((r - g) / d + 4) when g > r then 60 * ((b - r) / d + 2) else 60 * ((((g - b) / d) % 6e0 + 6e0) % 6e0) end"
#: Adds hue (degrees, null for grey), sat and val.
HSV = f"select *, {HUE} as hue, case when mx = 0 then 0e0 else d / mx end as sat, mx as val from (select *, greatest(r, g, b) as mx, greatest(r, g, b) - least(r, g, b) as d from {{px}})"


def _rgb(hue: str, sat: str, val: str) -> tuple[str, str, str]:
    """Sextants 0 to 5; a hue of 360 belongs to none and gives null."""
    c = f"({val} * {sat})"
    x = f"({c} * (1 - abs(({hue} / 60e0) % 2e0 - 1)))"
    m = f"({val} - {c})"
    table = ((c, x, "0e0"), (x, c, "0e0"), ("0e0", c, x), ("0e0", x, c), (x, "0e0", c), (c, "0e0", x))
    return tuple(f"(case cast(floor({hue} / 60e0) as int) " + " ".join(f"when {i} then {row[k]}" for i, row in enumerate(table)) + f" end + {m})" for k in range(3))


def _linear(c: str) -> str:
    return f"(case when {c} <= 0.04045e0 then {c} / 12.92e0 else pow(({c} + 0.055e0) / 1.055e0, 2.4e0) end)"


def _xyz(of) -> str:
    return "select *, " + ", ".join(
        f"{a}e0 * {of('r')} + {b}e0 * {of('g')} + {c}e0 * {of('b')} as {n}"
        for n, a, b, c in (("x", 0.4124564, 0.3575761, 0.1804375), ("y", 0.2126729, 0.7151522, 0.0721750), ("z", 0.0193339, 0.1191920, 0.9503041))
    ) + " from {px}"


XYZ = _xyz(_linear)

# D65 white point in u', v'
_UN, _VN = 4 * 0.312713 / (-2 * 0.312713 + 12 * 0.329016 + 3), 9 * 0.329016 / (-2 * 0.312713 + 12 * 0.329016 + 3)
LUV = f"""select *, case when s = 0 then null else 13 * l * (4 * x / s - {_UN!r}e0) end as u, case when s = 0 then null else 13 * l * (9 * y / s - {_VN!r}e0) end as v
from (select *, case when y <= 216e0 / 24389e0 then y * 24389e0 / 27e0 else 116 * pow(y, 1e0 / 3e0) - 16 end as l, x + 15 * y + 3 * z as s from ({XYZ}))"""

#: ``radians`` 1 for hues in radians instead of degrees, ``max_value`` for saturations and values up to another bound than 1.
hsv_pixels = SqlOp(f"select {KEY}, round(case when :radians = 1 then radians(hue) else hue end, 6) as hue, round(sat * :max_value, 6) as sat, round(val * :max_value, 6) as val from ({HSV})", radians=0, max_value=1.0)
#: Hues come in degrees, or with ``radians`` 1 in radians; ``na_hue`` is that of pixels without one.
_DEGREES = "(case when :radians = 1 then degrees(coalesce(hue, :na_hue)) else coalesce(hue, :na_hue) end)"
_R, _G, _B = _rgb("hue_", "sat", "val")
to_rgb = SqlOp(f"select {KEY}, round({_R}, 6) as r, round({_G}, 6) as g, round({_B}, 6) as b from (select *, {_DEGREES} as hue_ from {{hsv}}) x", na_hue=0.0, radians=0)
rgb_roundtrip = SqlOp(to_rgb.raw.replace("{hsv}", f"(select {KEY}, case when :radians = 1 then radians(hue) else hue end as hue, sat, val from ({HSV}) y)"), na_hue=0.0, radians=0)
xyz_pixels = SqlOp(f"select {KEY}, round(x, 6) as x, round(y, 6) as y, round(z, 6) as z from ({XYZ})")
#: The same of values that are linear already.
xyz_plain = SqlOp(f"select {KEY}, round(x, 6) as x, round(y, 6) as y, round(z, 6) as z from ({_xyz(str)})")
xyy_pixels = SqlOp(f"select {KEY}, round(x / nullif(x + y + z, 0), 6) as x, round(y / nullif(x + y + z, 0), 6) as y, round(y, 6) as big_y from ({XYZ})")
luv_pixels = SqlOp(f"select {KEY}, round(l, 5) + 0e0 as l, round(u, 5) + 0e0 as u, round(v, 5) + 0e0 as v from ({LUV})")
_R, _G, _B = _rgb("coalesce(hue, 0e0)", "(case when hue is null then :na_sat else 1e0 end)", "(case when hue is null then :na_val else 1e0 end)")
bright_rgb = SqlOp(f"select {KEY}, round({_R}, 6) as r, round({_G}, 6) as g, round({_B}, 6) as b from ({HSV})", na_sat=0.0, na_val=0.7450980392156863)
rescaled = SqlOp("""
select photo_id, rw, cl, round((r - lo) / nullif(hi - lo, 0), 6) as r, round((g - lo) / nullif(hi - lo, 0), 6) as g, round((b - lo) / nullif(hi - lo, 0), 6) as b
from (select *, min(least(r, g, b)) over (partition by photo_id) as lo, max(greatest(r, g, b)) over (partition by photo_id) as hi from {px})""")

#: 8-bit luminosity of the perceived-brightness kind, which differs from LUM.
luminosity = SqlOp("select photo_id, rw, cl, round(sqrt(0.299e0 * r8 * r8 + 0.587e0 * g8 * g8 + 0.114e0 * b8 * b8), 4) as grey from {px}")
channel_math = SqlOp("""
select photo_id, rw, cl, r8 + :add as added, r8 * :mult as multiplied, round(:add + :mult * r8, 6) as linear, round(:wr * r8 + :wg * g8 + :wb * b8, 6) as weighted,
  cast(floor(least(255e0, greatest(0e0, :add + :mult * r8)) + 0.5e0) as int) as clamped, cast(floor(:add + :mult * r8 + 0.5e0) as bigint) % 256 as wrapped
from {px}""", add=10.5, mult=1.25, wr=0.25, wg=0.5, wb=0.25)
argb_pack = SqlOp("""
select photo_id, rw, cl, argb, cast(floor(argb / 16777216) as bigint) % 256 as alpha, cast(floor(argb / 65536) as bigint) % 256 as red, cast(floor(argb / 256) as bigint) % 256 as green, argb % 256 as blue
from (select *, cast(255 as bigint) * 16777216 + cast(r8 as bigint) * 65536 + cast(g8 as bigint) * 256 + cast(b8 as bigint) as argb from {px})""")

hsv_averages = SqlOp(f"select photo_id, round(avg(val), 6) as intensity, round(avg(sat), 6) as saturation, round(avg(hue), 6) as hue from ({HSV}) group by photo_id")
_CENTRAL = "rw between floor(h / 3e0) and ceil(2 * h / 3e0) and cl between floor(w / 3e0) and ceil(2 * w / 3e0)"
hsv_central_averages = SqlOp(f"select photo_id, round(avg(val), 6) as intensity, round(avg(sat), 6) as saturation, round(avg(hue), 6) as hue from ({HSV}) where {_CENTRAL} group by photo_id")
size_aspect = SqlOp("select photo_id, max(h) + max(w) as size, round(max(h) / cast(max(w) as double), 6) as aspect, round(greatest(max(h) / cast(max(w) as double), max(w) / cast(max(h) as double)), 6) as aspect_max from {px} group by photo_id")

exposure_contrast = SqlOp(f"""
select photo_id, round(case when m between 0 and 1 then 4 * m * (1 - m) else 0 end, 6) as exposure, round(sd, 6) as rms_contrast, round(hi - lo, 6) as interval_contrast
from (select photo_id, avg(lum) as m, stddev_samp(lum) as sd, percentile(lum, 0.5 + :interval / 2) as hi, percentile(lum, 0.5 - :interval / 2) as lo from (select photo_id, {LUM} as lum from {{px}}) group by photo_id)""", interval=0.95)

_IN = f"case when {_CENTRAL} then {{}} end"
#: All of the above in one aggregation, by the names of the measure record.
simple_measures = SqlOp(f"""
select photo_id, round(case when m between 0 and 1 then 4 * m * (1 - m) else 0 end, 6) as Exposure, round(sd, 6) as RmsContrast, round(hi - lo, 6) as IntervalContrast,
  round(val, 6) as AverageIntensity, round(sat, 6) as AverageSaturation, round(hue, 6) as AverageHue, round(cval, 6) as AverageCentralIntensity, round(csat, 6) as AverageCentralSaturation, round(chue, 6) as AverageCentralHue,
  h + w as SizeFeature, round(h / cast(w as double), 6) as AspectRatio, round(greatest(h / cast(w as double), w / cast(h as double)), 6) as AspectRatioMax
from (select photo_id, avg(lum) as m, stddev_samp(lum) as sd, percentile(lum, 0.975) as hi, percentile(lum, 0.025) as lo, avg(val) as val, avg(sat) as sat, avg(hue) as hue,
    avg({_IN.format('val')}) as cval, avg({_IN.format('sat')}) as csat, avg({_IN.format('hue')}) as chue, max(h) as h, max(w) as w
  from (select *, {LUM} as lum from ({HSV})) group by photo_id)""")


class Buckets(SqlOp):
    """Counts of n by n by n colour buckets, n from 1 to MOST."""

    MOST = 32

    def text(self, **params: float) -> str:
        n = (self.defaults | params)["n"]
        if not 1 <= n <= self.MOST:
            raise ValueError(f"n has to be from 1 to {self.MOST}: {n}")
        return super().text(**params)


_N = ":n"
color_buckets = Buckets(f"""
with c as (select photo_id, cast(least(floor(b * {_N}), {_N} - 1) * {_N} * {_N} + least(floor(g * {_N}), {_N} - 1) * {_N} + least(floor(r * {_N}), {_N} - 1) as int) + 1 as bucket, count(*) as n from {{px}} group by 1, 2),
ids as (select distinct photo_id from {{px}}),
digits as (select distinct n from (values {", ".join(f"({i})" for i in range(Buckets.MOST))}) t(n) where n < {_N}),
buckets as (select x.n * {_N} * {_N} + y.n * {_N} + z.n + 1 as bucket from digits x cross join digits y cross join digits z)
select ids.photo_id, buckets.bucket, coalesce(c.n, 0) as n from ids cross join buckets left join c on c.photo_id = ids.photo_id and c.bucket = buckets.bucket""", n=4)
#: Of the same buckets only those that a photo has; its pixels are read once.
bucket_counts = Buckets(f"select photo_id, cast(least(floor(b * {_N}), {_N} - 1) * {_N} * {_N} + least(floor(g * {_N}), {_N} - 1) * {_N} + least(floor(r * {_N}), {_N} - 1) as int) + 1 as bucket, count(*) as n from {{px}} group by 1, 2", n=4)

_MID = {c: f"(cast(floor((bucket - 1) / {d}e0) as int) % 4 + 0.5e0) / 4" for c, d in (("r", 1), ("g", 4), ("b", 16))}
#: The buckets (4 a channel) that photos' colours fall into, as pixels of the midpoints' colours; the bucket is the id.
bucket_midpoints = SqlOp(f"select bucket as photo_id, 1 as h, 1 as w, 1 as rw, 1 as cl, {', '.join(f'{m} as {c}' for c, m in _MID.items())} from (select distinct cast(least(floor(b * 4), 3) * 16 + least(floor(g * 4), 3) * 4 + least(floor(r * 4), 3) as int) + 1 as bucket from {{px}}) t")
bucket_rgb = SqlOp(f"select photo_id as bucket, r, g, b from ({bucket_midpoints.raw}) m")

_HUE_K = f"""
with a as (select photo_id, h, w, rw, cl, radians(hue) as t from ({HSV}) where hue is not null),
m as (select photo_id, case when atan2(sum(sin(t)), sum(cos(t))) < 0 then atan2(sum(sin(t)), sum(cos(t))) + 2 * pi() else atan2(sum(sin(t)), sum(cos(t))) end as mu, count(*) as hued from a group by photo_id),
r as (select m.photo_id, mu, hued, avg(cos(t - mu)) as rbar from a join m on a.photo_id = m.photo_id group by 1, 2, 3),
k as (select photo_id, mu, hued, {a1inv('rbar')} as kappa from r)"""
#: The same with what belongs to a photo beside each of its pixels: they move once, and nothing is joined.
_OF_PHOTO = "over (partition by photo_id)"
_HUE_W = f"""
with a as (select photo_id, h, w, rw, cl, radians(hue) as t from ({HSV}) where hue is not null),
m as (select *, atan2(sum(sin(t)) {_OF_PHOTO}, sum(cos(t)) {_OF_PHOTO}) as at, count(*) {_OF_PHOTO} as hued from a),
n as (select *, case when at < 0 then at + 2 * pi() else at end as mu from m),
r as (select *, avg(cos(t - mu)) {_OF_PHOTO} as rbar from n),
k as (select *, {a1inv('rbar')} as kappa from r)"""
dominant_hue = TwoLevel(_HUE_K + """,
d as (select k.photo_id, mu, kappa, hued, sum(case when least(abs(t - mu), 2 * pi() - abs(t - mu)) <= 1 / kappa then 1 else 0 end) as dominant from a join k on a.photo_id = k.photo_id group by 1, 2, 3, 4)
select photo_id, case when dominant >= 4 then round(mu, 6) end as mu, case when dominant >= 4 then round(kappa, 6) end as kappa, case when dominant >= 4 then round(dominant / cast(hued as double), 6) end as pi from d""", _HUE_W + """,
d as (select photo_id, max(mu) as mu, max(kappa) as kappa, max(hued) as hued, sum(case when least(abs(t - mu), 2 * pi() - abs(t - mu)) <= 1 / kappa then 1 else 0 end) as dominant from k group by photo_id)
select photo_id, case when dominant >= 4 then round(mu, 6) end as mu, case when dominant >= 4 then round(kappa, 6) end as kappa, case when dominant >= 4 then round(dominant / cast(hued as double), 6) end as pi from d""")
#: Pixels whose hue lies within 1 / kappa of the mean hue.
dominant_pixels = TwoLevel(_HUE_K + """
select a.photo_id, h, w, rw, cl, 1 as dominant from a join k on a.photo_id = k.photo_id where round(least(abs(t - mu), 2 * pi() - abs(t - mu)), 7) <= round(1 / kappa, 7)""", _HUE_W + """
select photo_id, h, w, rw, cl, 1 as dominant from k where round(least(abs(t - mu), 2 * pi() - abs(t - mu)), 7) <= round(1 / kappa, 7)""")
hue_histogram = SqlOp(f"select photo_id, cast(floor(hue / 3e0) as int) as bin, count(*) as n from ({HSV}) where hue is not null group by 1, 2")
