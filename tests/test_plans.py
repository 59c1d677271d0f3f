"""Plans that read a photo's pixels once, and hulls in whole batches."""

import numpy as np
import pyarrow as pa

from lumenframe.functions import kernels
from lumenframe.operators import color, hulls, segments
from lumenframe.sources import tables


def _count(df, what):
    return df._jdf.queryExecution().executedPlan().toString().count(what)


def test_pixels_are_read_once(spark, small):
    """One shuffle of the line items, and no join."""
    px = tables.px(spark, small)
    for op in (segments.clustering_mdl_terms, color.dominant_hue, color.dominant_pixels):
        plan = op(px)
        assert (_count(plan, "Exchange "), _count(plan, "Join ")) == (1, 0)


def test_segments_meet_pixels_once(spark, small):
    px = tables.px(spark, small)
    segs = px.selectExpr("photo_id", "h", "w", "rw", "cl", "cast(rw % 3 as bigint) as segment_id")
    assert _count(segments.top5_segments(segs, px), "Join ") == 1


def test_edge_points():
    """Of a slice of hulls as well; one point and two ends count as they do with facets there and back."""
    shapes = [[(0.0, 0.0)], [(0.0, 0.0), (4.0, 2.0)], [(0.0, 0.0), (0.0, 3.0), (3.0, 0.0)]]
    column = pa.array([[{"x": x, "y": y} for x, y in s] for s in shapes], pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())])))
    assert hulls._edge_points(column).to_pylist() == [0, 4, 9] and hulls._edge_points(column.slice(1)).to_pylist() == [4, 9] and hulls._edge_points(column[:0]).to_pylist() == []


def test_corners():
    """No point lies outside, and no corner on a line between others."""
    rng = np.random.default_rng(4)
    for n in (1, 2, 3, 9, 60):
        points = rng.integers(0, 6, (n, 2))
        hull = kernels.convex_hull(points)
        assert hull.dtype == points.dtype and kernels.inside_hull(points[:, 0], points[:, 1], hull).all()
        if len(hull) > 2:
            a, b, c = hull, np.roll(hull, -1, axis=0), np.roll(hull, -2, axis=0)
            assert ((b - a)[:, 0] * (c - b)[:, 1] - (b - a)[:, 1] * (c - b)[:, 0] < 0).all()
