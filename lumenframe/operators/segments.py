"""Clusters, components, shapes and description lengths of photos; geometry of points and hulls."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernels
from ..sources.store import spread_out, tasks_of, written
from . import clusters
from .base import SqlOp
from .circular import TwoLevel
from .color import HSV

#: Eight fixed centres: the midpoints of two intervals of each channel, red fastest, as 8-bit values.
CENTRES = [(64 + 127 * (i & 1), 64 + 127 * (i >> 1 & 1), 64 + 127 * (i >> 2)) for i in range(8)]


def nearest(centres: list[tuple[int, int, int]] = CENTRES) -> str:
    """Number (from 1) of the nearest centre; the lower one on ties. No join: the centres are part of the expression."""
    d = [f"((r8 - {r}) * (r8 - {r}) + (g8 - {g}) * (g8 - {g}) + (b8 - {b}) * (b8 - {b}))" for r, g, b in centres]
    room = 1 << len(centres).bit_length()
    return f"cast(least({', '.join(f'{x} * {room} + {i}' for i, x in enumerate(d, 1))}) % {room} as int)"


_COLOUR = "case cluster_id " + " ".join(f"when {i} then {{}}" for i in range(1, 9)) + " end"
CLUSTERS = f"select photo_id, h, w, rw, cl, r8, g8, b8, r, g, b, {nearest()} as cluster_id from {{px}}"
nearest_center = SqlOp(f"select photo_id, rw, cl, cluster_id from ({CLUSTERS})")
reconstruct = SqlOp("select photo_id, rw, cl, " + ", ".join(f"{_COLOUR.format(*[c[k] for c in CENTRES])} as {n}8" for k, n in enumerate("rgb")) + f" from ({CLUSTERS})")


KINDS = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64()}


def per_photo(px: DataFrame, columns: list[str], fn, schema: str) -> DataFrame:
    """Apply ``fn(photo_id, h, w, {column: h x w raster})`` -> rows to each photo, one Arrow group a photo."""

    kinds = pa.schema([(name, KINDS[kind]) for name, kind in (x.split() for x in schema.split(", "))])

    def run(key: tuple, table: pa.Table) -> pa.Table:
        h, w = table.column("h")[0].as_py(), table.column("w")[0].as_py()
        at, rasters = (table.column("rw").to_numpy() - 1, table.column("cl").to_numpy() - 1), {}
        for c in columns:
            values = table.column(c).to_numpy()
            rasters[c] = np.zeros((h, w), dtype=values.dtype)
            rasters[c][at] = values
        found = fn(key[0].as_py(), h, w, rasters)
        n = max(len(v) for v in found.values() if hasattr(v, "__len__"))
        return pa.Table.from_arrays([pa.array(v if hasattr(v, "__len__") else np.full(n, v)).cast(f.type) for f, v in ((f, found[f.name]) for f in kinds)], schema=kinds)

    rows = px.select("photo_id", "h", "w", "rw", "cl", *columns)
    return rows.repartition(tasks_of(px.sparkSession), "photo_id").groupBy("photo_id").applyInArrow(run, schema)


def components(found: DataFrame, more: list[str] = []) -> DataFrame:
    """photo_id, h, w, rw, cl, segment_id of rows with a cluster_id, and ``more`` columns of numbers of a photo."""

    def rows(photo, h, w, m):
        label = kernels.components(m["cluster_id"])
        rw, cl = np.mgrid[1 : h + 1, 1 : w + 1]
        return {"photo_id": photo, "h": h, "w": w, "rw": rw.ravel(), "cl": cl.ravel(), "segment_id": label.ravel()} | {c: int(m[c][0, 0]) for c in more}

    return per_photo(found, ["cluster_id", *more], rows, "photo_id long, h int, w int, rw int, cl int, segment_id long" + "".join(f", {c} int" for c in more))


#: The same by reachability, for the oracle engine.
COMPONENTS_SQL = f"""
with recursive px as ({{px}}), c as materialized ({CLUSTERS.replace('{px}', 'px')}),
e as materialized (select a.photo_id, (a.cl - 1) * a.h + a.rw as p, (b.cl - 1) * b.h + b.rw as q from c a join c b on a.photo_id = b.photo_id and a.cluster_id = b.cluster_id and abs(a.rw - b.rw) + abs(a.cl - b.cl) = 1),
reach as (select photo_id, (cl - 1) * h + rw as p, (cl - 1) * h + rw as root from c union select e.photo_id, e.q, reach.root from reach join e on e.photo_id = reach.photo_id and e.p = reach.p where reach.root < e.q),
label as materialized (select photo_id, p, min(root) as segment_id from reach group by 1, 2),
segments as materialized (select c.photo_id, c.h, c.w, c.rw, c.cl, cast(label.segment_id as bigint) as segment_id from c join label on c.photo_id = label.photo_id and label.p = (c.cl - 1) * c.h + c.rw)"""

_RANKED = "select *, row_number() over (partition by photo_id order by n desc, segment_id desc) as place from (select photo_id, segment_id, max(h) as h, max(w) as w, count(*) as n, avg(rw) as mr, avg(cl) as mc, min(rw) as r0, max(rw) as r1, min(cl) as c0, max(cl) as c1 from {segments} group by photo_id, segment_id)"
bounding_boxes = SqlOp(f"select photo_id, segment_id, n, r0 as first_row, r1 as last_row, c0 as first_column, c1 as last_column from ({_RANKED})")
segment_positions = SqlOp(f"""
select photo_id, cast(place as int) as place, cast(10 * (least(floor(round((mr - 1) / ((h - 1) / 3e0), 9)), 2) + 1) + least(floor(round((mc - 1) / ((w - 1) / 3e0), 9)), 2) + 1 as int) as position,
  round(sqrt(pow(mr - (h + 1) / 2e0, 2) + pow(mc - (w + 1) / 2e0, 2)) / sqrt(pow((h - 1) / 2e0, 2) + pow((w - 1) / 2e0, 2)), 6) as distance
from ({_RANKED}) where place <= 5""")
top5_segments = TwoLevel(f"""
with t as (select photo_id, segment_id, place, n, h, w from ({_RANKED}) where place <= 5), v as ({HSV})
select t.photo_id, cast(t.place as int) as place, t.n, round(max(t.n) / cast(max(t.h) * max(t.w) as double), 6) as share, case when max(t.n) > 0.01e0 * max(t.h) * max(t.w) then true else false end as large, round(avg(hue), 5) as hue, round(avg(sat), 6) as sat, round(avg(val), 6) as val
from t join {{segments}} s on s.photo_id = t.photo_id and s.segment_id = t.segment_id join v on v.photo_id = s.photo_id and v.rw = s.rw and v.cl = s.cl group by t.photo_id, t.place, t.n""", f"""
with s as (select s.photo_id, s.segment_id, s.h, s.w, v.photo_id as found, hue, sat, val from {{segments}} s left join ({HSV}) v on v.photo_id = s.photo_id and v.rw = s.rw and v.cl = s.cl),
t as (select photo_id, segment_id, max(h) as h, max(w) as w, count(*) as n, count(found) as m, avg(hue) as hue, avg(sat) as sat, avg(val) as val from s group by photo_id, segment_id)
select photo_id, cast(place as int) as place, n, round(n / cast(h * w as double), 6) as share, n > 0.01e0 * h * w as large, round(hue, 5) as hue, round(sat, 6) as sat, round(val, 6) as val
from (select *, row_number() over (partition by photo_id order by n desc, segment_id desc) as place from t) where place <= 5 and m > 0""")

_RES = [f"({c}8 - ({_COLOUR.format(*[x[k] for x in CENTRES])}))" for k, c in enumerate("rgb")]
#: On Spark equal deviations of a cluster are one row with a count, so pixels are read once and join nothing.
clustering_mdl_terms = TwoLevel(f"""
with c as ({CLUSTERS}), res as (select photo_id, h, w, cluster_id, {_RES[0]} as e from c union all select photo_id, h, w, cluster_id, {_RES[1]} from c union all select photo_id, h, w, cluster_id, {_RES[2]} from c),
sd as (select photo_id, cluster_id, greatest(1e0, floor(coalesce(stddev_samp(e), 0e0) + 0.5e0)) as sd from res group by 1, 2),
bits as (select res.photo_id, max(h) as h, max(w) as w, count(distinct res.cluster_id) as k, sum(-log2((exp(-pow(e - 0.5e0, 2) / (2 * sd * sd)) + exp(-e * e / (2 * sd * sd)) + exp(-pow(e + 0.5e0, 2) / (2 * sd * sd))) / (3 * sd * sqrt(2 * pi())))) as residual
  from res join sd on res.photo_id = sd.photo_id and res.cluster_id = sd.cluster_id group by res.photo_id)
select photo_id, round(log2(h * w), 6) as length, round(k * (log2(101) + log2(345) + log2(257)), 6) as centres, round(k * log2(100), 6) as deviations, round(residual, 3) as residual from bits""", f"""
with c as ({CLUSTERS}), res as (select photo_id, h, w, cluster_id, explode(array({', '.join(_RES)})) as e from c),
counts as (select photo_id, cluster_id, cast(e as double) as e, max(h) as h, max(w) as w, cast(count(*) as double) as n from res group by photo_id, cluster_id, e),
sums as (select *, sum(n) over (partition by photo_id, cluster_id) as m, sum(n * e) over (partition by photo_id, cluster_id) as s1, sum(n * e * e) over (partition by photo_id, cluster_id) as s2 from counts),
sd as (select *, greatest(1e0, floor(coalesce(sqrt(greatest(0e0, s2 - s1 * s1 / m) / nullif(m - 1, 0e0)), 0e0) + 0.5e0)) as sd from sums),
bits as (select photo_id, cluster_id, max(h) as h, max(w) as w, sum(-n * log2((exp(-pow(e - 0.5e0, 2) / (2 * sd * sd)) + exp(-e * e / (2 * sd * sd)) + exp(-pow(e + 0.5e0, 2) / (2 * sd * sd))) / (3 * sd * sqrt(2 * pi())))) as residual from sd group by photo_id, cluster_id),
photos as (select photo_id, max(h) as h, max(w) as w, count(*) as k, sum(residual) as residual from bits group by photo_id)
select photo_id, round(log2(h * w), 6) as length, round(k * (log2(101) + log2(345) + log2(257)), 6) as centres, round(k * log2(100), 6) as deviations, round(residual, 3) as residual from photos""")
elias_delta = SqlOp("select n, length(bin(n)) - 1 + 2 * (length(bin(length(bin(n)))) - 1) + 1 as bits from (select distinct r8 * 37 + g8 + 1 as n from {px})")

# geometry over fixed shapes: a clockwise hull and a line segment in pixel coordinates
_HULL = [(3, 4), (4, 20), (9, 28), (13, 22), (14, 9), (8, 3)]


def _cross(a: tuple[float, float], b: tuple[float, float]) -> str:
    """Twice the signed area of the triangle of a, b and a pixel (x: cl, y: rw)."""
    return f"({b[0] - a[0]} * (rw - {a[1]}) - {b[1] - a[1]} * (cl - {a[0]}))"


def inside_hull(hull: list[tuple[float, float]]) -> SqlOp:
    """Whether a pixel lies in a convex hull of (x, y) in clockwise order, its edge included: a comparison for each facet."""
    facets = zip(hull, hull[1:] + hull[:1], strict=True)
    return SqlOp(f"select photo_id, rw, cl, {' and '.join(f'{_cross(a, b)} <= 0' for a, b in facets)} as inside from {{px}}")


hull_inside = inside_hull(_HULL)
#: Cross product of the vectors p and q, and whether q turns from p clockwise or counterclockwise; where they lie on one line, it does both.
TURN = "*, px * qy - py * qx as cross_product, px * qy - py * qx <= 0 as clockwise, px * qy - py * qx >= 0 as counterclockwise"
turn = SqlOp(f"select {TURN} from {{vectors}}")
_FROM, _TO = _HULL[0], _HULL[2]
#: The turn from a segment to each pixel.
turns = SqlOp(f"select photo_id, rw, cl, cross_product, clockwise, counterclockwise from (select {TURN} from (select photo_id, rw, cl, {_TO[0] - _FROM[0]} as px, {_TO[1] - _FROM[1]} as py, cl - {_FROM[0]} as qx, rw - {_FROM[1]} as qy from {{px}}) v) t")
hull_area = SqlOp("""
with b as (select photo_id, segment_id, min(cl) as x0, max(cl) as x1, min(rw) as y0, max(rw) as y1 from {segments} group by 1, 2),
p as (select photo_id, segment_id, t.i, case when t.i in (1, 2) then x0 else x1 + 1 end as x, case when t.i in (2, 3) then y1 + 1 else y0 end as y from b cross join (values (1), (2), (3), (4)) t(i)),
c as (select photo_id, segment_id, i, x - avg(x) over (partition by photo_id, segment_id) as x, y - avg(y) over (partition by photo_id, segment_id) as y from p),
n as (select photo_id, segment_id, x, y, coalesce(lead(x) over (partition by photo_id, segment_id order by i), first_value(x) over (partition by photo_id, segment_id order by i)) as nx, coalesce(lead(y) over (partition by photo_id, segment_id order by i), first_value(y) over (partition by photo_id, segment_id order by i)) as ny from c)
select photo_id, segment_id, round(sum(abs(x * ny - y * nx)) / 2, 6) as area from n group by 1, 2""")
_D1, _D2 = "sqrt(pow(cl - :x1, 2) + pow(rw - :y1, 2))", "sqrt(pow(cl - :x2, 2) + pow(rw - :y2, 2))"
_NORM = "sqrt(pow(:x2 - :x1, 2) + pow(:y2 - :y1, 2))"
_LINE = f"case when {_NORM} = 0 then {_D1} else abs((:y2 - :y1) * cl - (:x2 - :x1) * rw + :x2 * :y1 - :y2 * :x1) / {_NORM} end"
_DOT = "((cl - :x1) * (:x2 - :x1) + (rw - :y1) * (:y2 - :y1))"
line_distance = SqlOp(f"select photo_id, rw, cl, round({_LINE}, 6) as to_line, round(case when {_DOT} <= 0 then {_D1} when {_DOT} >= pow(:x2 - :x1, 2) + pow(:y2 - :y1, 2) then {_D2} else {_LINE} end, 6) as to_segment from {{px}}", x1=2.0, y1=3.0, x2=11.0, y2=25.0)


@lru_cache(maxsize=256)
def grid_distance(h: int, w: int) -> float:
    """Mean distance of two places drawn from a whole raster, with replacement."""
    r, c = np.arange(h), np.arange(w)
    rows, cols = np.where(r, 2.0, 1.0) * (h - r), np.where(c, 2.0, 1.0) * (w - c)
    return float((rows[:, None] * cols[None, :] * np.hypot(r[:, None], c[None, :])).sum() / (float(h) * w) ** 2)


def spread(dominant: DataFrame) -> DataFrame:
    """Mean distance of two pixels drawn from a photo's dominant ones, exactly, by the counts of all displacements (ds), and
    its share of the same of all pixels, at most 1 (norm_ds)."""

    def rows(photo, h, w, m):
        mask = np.zeros((2 * h, 2 * w))
        mask[:h, :w] = m["dominant"]
        f = np.fft.rfft2(mask)
        n = np.rint(np.fft.irfft2(f * np.conj(f), s=mask.shape))
        dr, dc = np.minimum(np.arange(2 * h), 2 * h - np.arange(2 * h)), np.minimum(np.arange(2 * w), 2 * w - np.arange(2 * w))
        ds, whole = float((n * np.hypot(dr[:, None], dc[None, :])).sum() / n.sum()), grid_distance(h, w)
        return {"photo_id": [photo], "ds": [round(ds, 6)], "norm_ds": [round(min(1.0, ds / whole), 6) if whole else None]}

    return per_photo(dominant, ["dominant"], rows, "photo_id long, ds double, norm_ds double")


def dispersion(dominant: DataFrame) -> DataFrame:
    return spread(dominant).select("photo_id", "ds")


def rle(clusters: DataFrame) -> DataFrame:
    def rows(photo, h, w, m):
        code = kernels.rle2d(m["cluster_id"])
        return {"photo_id": photo, "place": range(1, len(code) + 1), "value": [x[0] for x in code], "width": [x[1] for x in code], "max_width": [x[2] for x in code]}

    return per_photo(clusters, ["cluster_id"], rows, "photo_id long, place int, value int, width int, max_width int")


def rle_bits(clusters: DataFrame, k: int = 8) -> DataFrame:
    def rows(photo, h, w, m):
        b = kernels.mdl_rle2d(m["cluster_id"], k)
        return {"photo_id": [photo], "dims": [float(b[0])], "range": [b[1]], "values": [b[2]], "widths": [b[3]], "total": [sum(b)]}

    return per_photo(clusters, ["cluster_id"], rows, "photo_id long, dims double, range double, values double, widths double, total double")


def bucket_colours(n: int) -> np.ndarray:
    """L, u, v of the midpoints of n intervals a channel, red fastest."""
    from math import isfinite

    mid = (np.arange(n) + 0.5) / n
    b, g, r = (x.ravel() for x in np.meshgrid(mid, mid, mid, indexing="ij"))
    lin = lambda c: np.where(c <= 0.04045, c / 12.92, ((c + 0.055) / 1.055) ** 2.4)
    m = np.array([[0.4124564, 0.3575761, 0.1804375], [0.2126729, 0.7151522, 0.0721750], [0.0193339, 0.1191920, 0.9503041]])
    x, y, z = m @ np.stack([lin(r), lin(g), lin(b)])
    s = x + 15 * y + 3 * z
    white = -2 * 0.312713 + 12 * 0.329016 + 3
    light = np.where(y <= 216 / 24389, y * 24389 / 27, 116 * np.cbrt(y) - 16)
    assert isfinite(float(s.sum()))
    return np.stack([light, 13 * light * (4 * x / s - 4 * 0.312713 / white), 13 * light * (9 * y / s - 9 * 0.329016 / white)], axis=1)


#: Photos whose transport a task solves, and with few targets; how many targets are few.
PHOTOS, OF_FEW, FEW = 32, 256, 8


def _transported_few(costs: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                batch = whole.slice(at, 64)
                counts = batch.column(2).to_pylist()
                supply = np.zeros((len(counts), len(costs)), dtype=np.int64)
                supply[np.repeat(np.arange(len(counts)), [len(n) for n in counts]), np.concatenate(batch.column(1).to_pylist()) - 1] = np.concatenate(counts)
                demand = np.repeat(supply.sum(axis=1)[:, None], costs.shape[1], axis=1)
                supply *= costs.shape[1]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kernels.transport_few(supply, demand, costs) / supply.sum(axis=1))], names=["photo_id", "colorfulness"])

    return run


def _transported(costs: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for buckets, n in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                supply = np.array(n, dtype=np.int64) * costs.shape[1]
                total, _ = kernels.transport(supply, np.full(costs.shape[1], sum(n)), costs[np.array(buckets) - 1])
                out.append(total / supply.sum())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.float64())], names=["photo_id", "colorfulness"])

    return run


def colorfulness(buckets: DataFrame, mode: str = "uniform", n: int = 4) -> DataFrame:
    """Earth mover's distance of a photo's colours from an even (or, ``grey``, an even grey) spread; ``buckets``: photo_id, bucket, n.

    A photo is one row of at most n ** 3 counts, and the rows are dealt out evenly, whatever their size in bytes.
    """
    if mode not in ("uniform", "grey"):
        raise ValueError("mode is uniform or grey")
    luv = bucket_colours(n)
    target = np.arange(n**3) if mode == "uniform" else np.arange(n) * (n * n + n + 1)
    costs = np.sqrt(((luv[:, None] - luv[target][None]) ** 2).sum(axis=2))
    full = F.sort_array(F.collect_list(F.struct("bucket", F.col("n").cast("long").alias("n"))))
    rows = buckets.where("n > 0").groupBy("photo_id").agg(full.alias("b")).select("photo_id", "b.bucket", "b.n")
    few = costs.shape[1] <= FEW
    return spread_out(rows, OF_FEW if few else PHOTOS).mapInArrow((_transported_few if few else _transported)(costs), "photo_id long, colorfulness double")


def segmentation(px: DataFrame, k_max: int = 30, restarts: int = 3) -> DataFrame:
    """photo_id, h, w, rw, cl, segment_id, clusters: components of the clusters of least description length; seeds are the photo's id."""
    return clusters.segmented(clusters.LUV_PIXELS(px), k_max, restarts)


def kmeanspp(px: DataFrame, k: int = 4, restarts: int = 2) -> DataFrame:
    """Centres of each photo's colours (l, u, v), their sizes and the within sum of squares."""

    def rows(photo, h, w, m):
        x = np.stack([m[c].T.ravel() for c in ("l", "u", "v")], axis=1)
        centres, of, within = kernels.kmeans(x, k, np.random.default_rng(int(photo) & 0x7FFFFFFF), restarts=restarts)
        return {"photo_id": photo, "cluster_id": range(1, len(centres) + 1), "l": centres[:, 0], "u": centres[:, 1], "v": centres[:, 2], "n": np.bincount(of, minlength=len(centres)), "within": within}

    return per_photo(clusters.LUV_PIXELS(px), ["l", "u", "v"], rows, "photo_id long, cluster_id int, l double, u double, v double, n long, within double")
