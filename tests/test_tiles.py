import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lumenframe.functions import kernels
from lumenframe.operators import clusters, hulls, stencil, tiles

from .golden import frame

PIXELS = "photo_id long, h int, w int, rw int, cl int, cluster_id int"


def cells(spark, rasters):
    return spark.createDataFrame([(i, *m.shape, r + 1, c + 1, int(m[r, c])) for i, m in enumerate(rasters) for r in range(m.shape[0]) for c in range(m.shape[1])], PIXELS)


@pytest.mark.parametrize("side", [3, 4, 100])
@pytest.mark.parametrize("pad", [0.0, -0.5, "replicate"])
def test_conv2_fft(spark, side, pad):
    """Tiles smaller than the kernel, and one for the whole photo, against sums over a padded raster."""
    rng = np.random.default_rng(side)
    m, kernel = rng.normal(size=(9, 7)), rng.normal(size=(5, 11))
    padded = np.pad(m, ((2, 2), (5, 5)), mode="edge") if pad == "replicate" else np.pad(m, ((2, 2), (5, 5)), constant_values=pad)
    want = [[(padded[r : r + 5, c : c + 11] * kernel[::-1, ::-1]).sum() for c in range(7)] for r in range(9)]
    got = np.zeros((9, 7))
    rows = tiles.conv2_fft(frame(spark, np.stack([m] * 3, axis=2)), kernel.tolist(), "r", pad, side).collect()
    for r in rows:
        got[r.rw - 1, r.cl - 1] = r.v
    assert len(rows) == 63 and np.abs(got - want).max() < 1e-9


def test_conv2_fft_is_direct(spark):
    weights = [[v * (1 + (i - j) / 62) for j, v in enumerate(row)] for i, row in enumerate(stencil.gaussian_kernel(31, 5.0))]
    px = frame(spark, np.random.default_rng(0).random((20, 33, 3)))
    direct = {(r.rw, r.cl): r.v for r in stencil.conv2(weights)(px).collect()}
    assert all(abs(direct[r.rw, r.cl] - r.v) < 1e-6 for r in tiles.conv2_fft(px, weights, side=8).collect())
    for bad in ([[1.0, 1.0]], [[1.0], [1.0]]):
        with pytest.raises(ValueError):
            tiles.conv2_fft(px, bad)
    with pytest.raises(ValueError):
        tiles.conv2_fft(px, [[1.0]], pad="circular")


@pytest.mark.parametrize("side", [1, 4, 16, 512])
def test_components(spark, side):
    """Noise, stripes that wind through many tiles, and one value, against the components of the whole raster."""
    rng = np.random.default_rng(2)
    snake = np.zeros((17, 13), dtype=int)
    snake[::2], snake[1::4, -1], snake[3::4, 0] = 1, 1, 1
    rasters = [rng.integers(0, 2, (20, 11)), rng.integers(0, 3, (5, 33)), snake, np.ones((9, 9), dtype=int), np.zeros((1, 1), dtype=int)]
    got = [np.zeros(m.shape, dtype=int) for m in rasters]
    for r in tiles.components(cells(spark, rasters), side).collect():
        got[r.photo_id][r.rw - 1, r.cl - 1] = r.segment_id
    for m, g in zip(rasters, got, strict=True):
        assert (kernels.components(m) == g).all()
    assert tiles.components(cells(spark, rasters).limit(0), side).count() == 0


@pytest.mark.parametrize("seams", [0, 4, 1000])
def test_components_by_batches(spark, monkeypatch, seams):
    """Tiles share a batch, none is a group of its own; photos with more pairs at seams than a task takes are joined as a graph."""
    rng = np.random.default_rng(4)
    rasters = [rng.integers(0, 2, (h, w)) for h, w in ((30, 16), (1, 9), (9, 1), (4, 4), (17, 16))]
    plans, real = [], tiles.written
    monkeypatch.setattr(tiles, "written", lambda df, name: (plans.append(df._jdf.queryExecution().toString()), real(df, name))[1])
    df = tiles.components(cells(spark, rasters).repartition(5), 4, seams)
    assert "MapInArrow" in plans[0] and not any("FlatMapGroups" in p for p in plans)
    got = [np.zeros(m.shape, dtype=int) for m in rasters]
    for r in df.collect():
        got[r.photo_id][r.rw - 1, r.cl - 1] = r.segment_id
    assert all((kernels.components(m) == g).all() for m, g in zip(rasters, got, strict=True))


@pytest.mark.parametrize("least", [1, 7, 1000])
def test_whole_keys(least):
    """Batches cut anywhere give each key's rows at once."""
    rng = np.random.default_rng(5)
    key = np.sort(rng.integers(0, 12, 100))
    rows = pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.arange(100))], names=["k", "v"])
    cuts = np.unique(np.concatenate([[0, 100], rng.integers(0, 100, 9)]))
    out = list(tiles._whole((rows.slice(a, b - a) for a, b in zip(cuts[:-1], cuts[1:], strict=True)), 1, least))
    assert np.concatenate([v for _, v in out]).tolist() == list(range(100)) and sum(len(np.unique(k)) for k, _ in out) == len(np.unique(key))
    assert list(tiles._whole(iter([]), 1, least)) == []


def by_hand(x, y):
    """Corners of a hull, by trying all pairs."""
    p = sorted(set(zip(x.tolist(), y.tolist(), strict=True)))
    turn = lambda a, b, c: (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])
    within = lambda a, b, c: (c[0] - a[0]) * (c[0] - b[0]) + (c[1] - a[1]) * (c[1] - b[1]) <= 0
    return {a for a in p for b in p if a != b and all(turn(a, b, c) < 0 or (turn(a, b, c) == 0 and within(a, b, c)) for c in p)} or set(p)


@pytest.mark.parametrize("most", [100_000, 6])
def test_hulls(spark, monkeypatch, most):
    """Groups of one point, of a line, of a grid and of points anywhere; large groups by stripes."""
    monkeypatch.setattr(hulls, "POINTS", most)
    rng = np.random.default_rng(3)
    groups = {"one": ([2, 2], [3, 3]), "line": ([0, 1, 2, 3], [1, 3, 5, 7]), "up": ([4, 4, 4], [1, 5, 2]), "grid": (rng.integers(0, 9, 200), rng.integers(0, 9, 200)), "any": (rng.normal(size=300), rng.normal(size=300)), None: ([0, 1, 0], [0, 0, 1])}
    rows = [(k, float(a), float(b)) for k, (x, y) in groups.items() for a, b in zip(x, y, strict=True)] + [("one", None, 1.0), ("one", 1.0, float("nan")), ("any", float("inf"), 0.0)]
    found = hulls.hulls(spark.createDataFrame(rows, "name string, x double, y double").repartition(3), ["name"])
    got = {r.name: r for r in found.select("name", "hull", hulls.area(F.col("hull")).alias("area")).collect()}
    assert set(got) == set(groups)
    for k, (x, y) in groups.items():
        corners = [(p.x, p.y) for p in got[k].hull]
        assert len(set(corners)) == len(corners) and set(corners) == by_hand(np.array(x, dtype=float), np.array(y, dtype=float))
        if len(corners) > 2:
            a, b = np.array(corners), np.roll(np.array(corners), -1, axis=0)
            shoelace = (a[:, 0] * b[:, 1] - b[:, 0] * a[:, 1]).sum() / 2
            assert shoelace < 0 and abs(got[k].area + shoelace) < 1e-9
        else:
            assert got[k].area == 0


def test_published_hull(spark):
    x, y = [5, 4, 8, 9, 4, 10, 6, 4, 8, 8, 2, 6, 3, 4], [3, 3, 1, 10, 3, 8, 9, 9, 5, 1, 10, 1, 3, 1]
    corners = [(x[i - 1], y[i - 1]) for i in (10, 14, 13, 11, 4, 6)]
    hull = hulls.hulls(spark.createDataFrame([(1, float(a), float(b)) for a, b in zip(x, y, strict=True)], "g int, x double, y double"), ["g"])
    assert {(p.x, p.y) for p in hull.first().hull} == set(corners)
    px, py = [8, 4, 3, 2, 9, 10, 6, 6, 9, 0, 2, 2, 9.34, 9], [1, 1, 3, 10, 10, 8, 6, 1, 4.5, 0, 9.9, 10.1, 9.34, 4.4]
    points = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(px, py, strict=True))], "i int, a double, b double").crossJoin(hull)
    got = {r.i: r.ok for r in points.select("i", hulls.inside(F.col("a"), F.col("b"), F.col("hull")).alias("ok")).collect()}
    assert [got[i] for i in range(14)] == [True] * 9 + [False] * 5
    shapes = [([(2, 6), (2, 9), (4, 9), (4, 6)], 6.0), ([(1, 1), (2, 3), (3, 3), (4, 3), (5, 2), (5, 1), (4, 0), (3, -1)], 10.5)]
    df = spark.createDataFrame([([{"x": float(a), "y": float(b)} for a, b in s], want) for s, want in shapes], f"hull {hulls.HULL}, want double")
    assert all(r.got == pytest.approx(r.want) for r in df.select("want", hulls.area(F.col("hull")).alias("got")).collect())
    ends = spark.createDataFrame([([{"x": 1.9, "y": 3.9}, {"x": 2.05, "y": 4.05}],)], f"hull {hulls.HULL}")
    row = ends.select(*[hulls.inside(F.lit(a), F.lit(a + 2), F.col("hull")).alias(f"c{i}") for i, a in enumerate((1.89, 1.9, 2.0, 2.1))]).first()
    assert list(row) == [False, True, True, False]


def test_convexity(spark):
    rng = np.random.default_rng(5)
    rasters = [kernels.components(np.kron(rng.integers(0, 3, (4, 5)), np.ones((3, 4), dtype=int))), np.ones((20, 20), dtype=int), kernels.components(rng.integers(0, 2, (12, 30)))]
    segs = cells(spark, rasters).withColumnRenamed("cluster_id", "segment_id")
    got = {r.photo_id: r.convexity for r in hulls.convexity(segs).collect()}
    assert all(got[i] == pytest.approx(kernels.shape_convexity(m)) for i, m in enumerate(rasters)) and len(got) == 3


def test_table_clusters(spark):
    """Not much worse than a clustering in memory with as many restarts, and every pixel in one cluster."""
    rng = np.random.default_rng(6)
    img = np.clip(rng.choice(rng.random((12, 3)), 900)[:, :] + rng.normal(0, 0.05, (900, 3)), 0, 1).reshape(30, 30, 3)
    px = frame(spark, np.round(img * 255) / 255)
    found, within = clusters.table_clusters(px, k=10)
    rows = found.collect()
    luv = np.array([[r.l, r.u, r.v] for r in clusters.LUV_PIXELS(px).collect()])
    best = kernels.kmeans(luv, 10, np.random.default_rng(0), 50, 3)[2]
    assert [r.cluster_id for r in rows] and sum(r.n for r in rows) == 900 and sorted(r.cluster_id for r in rows) == list(range(1, 11))
    assert kernels.squares(luv, np.array([[r.l, r.u, r.v] for r in rows])).min(axis=1).sum() == pytest.approx(within) and within <= 1.05 * best
