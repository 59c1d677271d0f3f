"""Convex hulls of groups of points of any size, their areas, and what lies in them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import kernels

#: Points of a group that meet at once; larger groups are cut into stripes, and the hulls of these are merged.
POINTS, STRIPES = 100_000, 1024
HULL = "array<struct<x:double,y:double>>"


def _hulled(by: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = batch.column(len(by))  # of each group the points of its parts
            of, ends, xy = parts.offsets.to_pylist(), parts.values.offsets.to_pylist(), parts.values.values
            x, y = (xy.field(c).to_numpy(zero_copy_only=False).tolist() for c in (0, 1))
            hx, hy, offsets = [], [], [0]
            for i, j in zip(of, of[1:], strict=False):
                for px, py in kernels.hull_corners(list(zip(x[ends[i] : ends[j]], y[ends[i] : ends[j]], strict=True))):
                    hx.append(px)
                    hy.append(py)
                offsets.append(len(hx))
            corners = pa.StructArray.from_arrays([pa.array(hx, pa.float64()), pa.array(hy, pa.float64())], names=["x", "y"])
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(by)], pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), corners)], names=[*by, "hull"])

    return run


def hulls(points: DataFrame, by: list[str]) -> DataFrame:
    """``by``..., hull: the corners of the convex hull of each group's points (x, y), clockwise (y upwards), none on a line between others.

    Of the points of one x only the lowest and the highest can be corners, so the others never move; what is left of a
    large group is cut into stripes, whose hulls are merged: hulls of hulls. One point, or two ends, where there is no area.
    Rows with a null or non-finite coordinate are left out.
    """
    finite = lambda c: F.col(c).isNotNull() & (F.abs(c) < float("inf"))
    rows = points.select(*by, F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).where(finite("x") & finite("y"))
    ends = rows.groupBy(*by, "x").agg(F.min("y").alias("lo"), F.max("y").alias("hi"))
    spread = ends.groupBy(*by).agg(F.count("*").alias("_n"), F.min("x").alias("_x0"), F.max("x").alias("_x1"))
    large = spread.where(F.col("_n") > POINTS // 2)
    same = [F.col(f"e.{c}").eqNullSafe(F.col(f"s.{c}")) for c in by]
    cut = ends.alias("e").join(large.alias("s"), same, "left").select(*[F.col(f"e.{c}").alias(c) for c in by], "x", "lo", "hi", F.coalesce(F.least(F.floor((F.col("x") - F.col("_x0")) / (F.col("_x1") - F.col("_x0")) * STRIPES), F.lit(STRIPES - 1)), F.lit(0)).alias("_stripe"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in by)
    both = F.collect_list(F.array(F.struct("x", F.col("lo").alias("y")), F.struct("x", F.col("hi").alias("y"))))
    part = cut.groupBy(*by, "_stripe").agg(both.alias("p")).select(*by, "p").mapInArrow(_hulled(by), f"{kinds}, hull {HULL}")
    return part.groupBy(*by).agg(F.collect_list("hull").alias("p")).mapInArrow(_hulled(by), f"{kinds}, hull {HULL}")


def _facets(hull: Column, of) -> Column:
    """``of`` each corner and the next one, the last one's being the first."""
    return F.transform(hull, lambda a, i: of(a, F.get(hull, (i + 1) % F.size(hull))))


def area(hull: Column) -> Column:
    """Of triangles about the mean of the corners; 0 for fewer than three."""
    mean = lambda c: F.aggregate(hull, F.lit(0.0), lambda s, p: s + p[c]) / F.size(hull)
    of = lambda m: F.aggregate(_facets(hull, lambda a, b: F.abs((a.x - m.x) * (b.y - m.y) - (a.y - m.y) * (b.x - m.x))), F.lit(0.0), lambda s, v: s + v) / 2
    return F.element_at(F.transform(F.array(F.struct(mean("x").alias("x"), mean("y").alias("y"))), of), 1)


def inside(x: Column, y: Column, hull: Column, eps: float = 1e-9) -> Column:
    """Whether a point lies in a hull, its edge included: a clockwise turn from every facet; on two ends, or one point, within ``eps``."""
    near = lambda a, b: F.hypot(x - a, y - b) < eps
    first, second = F.get(hull, F.lit(0)), F.get(hull, F.lit(1))
    dx, dy = second.x - first.x, second.y - first.y
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((x - first.x) * dx + (y - first.y) * dy) / (dx * dx + dy * dy)))
    facets = F.forall(_facets(hull, lambda a, b: (b.x - a.x) * (y - a.y) - (b.y - a.y) * (x - a.x) <= eps), lambda ok: ok)
    return F.when(F.size(hull) == 1, near(first.x, first.y)).when(F.size(hull) == 2, near(first.x + t * dx, first.y + t * dy)).otherwise(facets)


def _edge_points(hulls: pa.Array) -> pa.Array:
    """Whole-numbered places on the edges of hulls with such corners."""
    offsets = hulls.offsets.to_numpy()
    first, last = offsets[:-1] - offsets[0], offsets[1:] - offsets[0]
    if not len(first):
        return pa.array([], pa.int64())
    x, y = (hulls.values.field(c).to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]].astype(np.int64) for c in (0, 1))
    after = np.arange(1, len(x) + 1)
    after[last - 1] = first
    return pa.array(np.add.reduceat(np.gcd(x[after] - x, y[after] - y), first), pa.int64())


def places_inside(hull: Column) -> Column:
    """How many whole-numbered places lie in a hull with such corners, its edge included, by its area and the places on its edge."""
    return (F.round(area(hull) + F.arrow_udf(_edge_points, "long")(hull) / 2) + 1).cast("long")


def segment_hulls(segments: DataFrame) -> DataFrame:
    """photo_id, segment_id, n, hull (x: column, y: -row), corners, area, inside (pixels in the hull), coverage (the segment's share of them)."""
    found = hulls(segments.select("photo_id", "segment_id", F.col("cl").alias("x"), (-F.col("rw")).alias("y")), ["photo_id", "segment_id"])
    found = segments.groupBy("photo_id", "segment_id").agg(F.count("*").alias("n")).hint("merge").join(found, ["photo_id", "segment_id"])
    found = found.withColumns({"corners": F.size("hull"), "area": area(F.col("hull")), "inside": places_inside(F.col("hull"))})
    return found.withColumn("coverage", F.col("n") / F.col("inside"))


def convexity(segments: DataFrame, least: float = 1 / 200, coverage: float = 0.8) -> DataFrame:
    """photo_id, convexity: the share of a photo in segments of at least ``least`` of it that fill ``coverage`` of their hulls."""
    size = segments.groupBy("photo_id").agg((F.max("h") * F.max("w")).alias("size"))
    large = segments.groupBy("photo_id", "segment_id").agg(F.count("*").alias("k")).join(size, "photo_id").where(F.col("k") >= F.col("size") * least).select("photo_id", "segment_id")
    # files of even segments are far smaller than their rows, so their size must not decide for a broadcast
    filled = segment_hulls(segments.hint("merge").join(large, ["photo_id", "segment_id"])).where(F.col("coverage") >= coverage)
    total = filled.groupBy("photo_id").agg(F.sum("n").alias("n"))
    return size.join(total, "photo_id", "left").select("photo_id", (F.coalesce("n", F.lit(0)) / F.col("size")).alias("convexity"))
