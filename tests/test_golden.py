import math
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenframe.functions import kernels, vonmises
from lumenframe.operators import circular, color, segments, stencil
from lumenframe.sources import files

from .golden import frame, image, runif


def one(df):
    return df.collect()[0]


def test_generator():
    assert np.allclose(runif(3, 1), [0.2655087, 0.3721239, 0.5728534], atol=1e-7)


def test_hsv(spark):
    px = image(spark, (4, 5, 3), low=0.4)
    r = one(color.hsv_averages(px))
    assert (r.hue, r.saturation, r.intensity) == pytest.approx((201.3679604, 0.3379017, 0.852), abs=1e-3)
    r = one(color.hsv_central_averages(px))
    assert (r.hue, r.saturation, r.intensity) == pytest.approx((208.9954117, 0.3177584, 0.8340243), abs=1e-3)
    r = one(color.size_aspect(px))
    assert (r["size"], r.aspect, r.aspect_max) == (9, 0.8, 1.25)


def test_pixel(spark):
    px = frame(spark, np.array([[[165, 107, 11]]]) / 255)
    r = one(color.hsv_pixels(px))
    assert (r.hue, r.sat, r.val) == pytest.approx((37.4025966, 0.9333333, 0.6470588), abs=1e-5)
    r = one(color.xyz_pixels(px))
    assert (r.x, r.y, r.z) == pytest.approx((0.20835, 0.18539, 0.02797), abs=1e-4)
    r = one(color.xyy_pixels(px))
    assert (r.x, r.y) == pytest.approx((0.494065, 0.439613), abs=1e-4)
    r = one(color.luv_pixels(px))
    assert (r.l, r.u, r.v) == pytest.approx((50.143, 47.817, 48.631), abs=1e-2)


def test_grey(spark):
    r = one(color.hsv_pixels(frame(spark, np.full((1, 1, 3), 0.5))))
    assert r.hue is None and r.sat == 0 and r.val == 0.5
    r = one(color.luv_pixels(frame(spark, np.zeros((1, 1, 3)))))
    assert r.u is None and r.v is None and r.l == 0
    assert color.dominant_hue(frame(spark, np.full((3, 3, 3), 0.5))).count() == 0


def test_round_trip(spark):
    px = image(spark, (6, 7, 3))
    a, b = px.orderBy("rw", "cl").collect(), color.rgb_roundtrip(px).orderBy("rw", "cl").collect()
    assert all(abs(x[c] - y[c]) < 1e-5 for x, y in zip(a, b, strict=True) for c in "rgb")


def test_texture(spark):
    got = {r.channel: r for r in stencil.wavelet_texture(image(spark, (8, 10, 3), low=0.4)).collect()}
    want = {"hue": (0.2303976, 0.255253, 0.1964088), "sat": (0.1054641, 0.1160977, 0.1132417), "val": (0.08682113, 0.08736958, 0.1347886)}
    for c, levels in want.items():
        assert (got[c].level1, got[c].level2, got[c].level3) == pytest.approx(levels, abs=2e-6)
    assert [got[c].total for c in want] == pytest.approx([0.6820594, 0.3348034, 0.3089793], abs=3e-6)


def test_blur_annoyance(spark):
    ramp = np.linspace(0, 1, 24).reshape((2, 4, 3), order="F")
    assert one(stencil.blur_annoyance(frame(spark, ramp))).quality == pytest.approx(0.7208079, abs=1e-6)
    assert one(stencil.blur_annoyance(frame(spark, np.full((2, 4, 3), 0.6)))).quality is None


def test_mdwe(spark):
    grey = runif(20000, 42).reshape((100, 200), order="F")
    r = one(stencil.mdwe(frame(spark, np.stack([grey] * 3, axis=2))))
    assert (r.score, r.gaussian, r.jpeg2k) == pytest.approx((1.917252, 1, 1), abs=1e-5)


def test_colorfulness(spark):
    u = runif(60 * 3, 1)
    imgs = {1: np.dstack([np.full((3, 4), 1.0), np.zeros((3, 4)), np.zeros((3, 4))])}
    r = one(segments.colorfulness(color.color_buckets(frame(spark, imgs[1]))))
    assert r.colorfulness == pytest.approx(153.7, abs=0.1) and len(u)
    with pytest.raises(ValueError):
        segments.colorfulness(color.color_buckets(frame(spark, imgs[1])), "all")


def test_transport():
    rng = np.random.default_rng(1)
    for _ in range(5):
        x, y = rng.random((6, 2)), rng.random((6, 2))
        c = np.hypot(*(x[:, None] - y[None]).transpose(2, 0, 1))
        import itertools

        best = min(sum(c[i, p[i]] for i in range(6)) for p in itertools.permutations(range(6)))
        total, flow = kernels.transport(np.ones(6), np.ones(6), c)
        assert total == pytest.approx(best) and (flow.sum(axis=0) == 1).all() and (flow.sum(axis=1) == 1).all()


def test_run_lengths():
    rng = np.random.default_rng(2)
    for shape in ((7, 8), (8, 14), (60, 41)):
        m = rng.integers(0, 2, shape) * rng.integers(0, 2, shape)
        code = kernels.rle2d(m)
        assert (kernels.inverse_rle2d(*shape, code) == m).all() and all(w <= most for _, w, most in code)
    assert [kernels.elias_delta(n) for n in (1, 2, 3, 4, 15, 16)] == [1, 4, 4, 5, 8, 9]


def test_hull():
    square = np.array([[0, 0], [2, 0], [2, 2], [0, 2], [1, 1], [1, 0]])
    hull = kernels.convex_hull(square)
    assert sorted(map(tuple, hull)) == [(0, 0), (0, 2), (2, 0), (2, 2)]
    assert kernels.inside_hull(np.array([1, 2, 3, -1]), np.array([1, 2, 1, 0]), hull).tolist() == [True, True, False, False]
    assert kernels.shape_convexity(np.ones((20, 20), dtype=int)) == 1.0


def test_components():
    m = np.array([[1, 1, 2], [2, 1, 2], [2, 2, 2]])
    assert kernels.components(m).tolist() == [[1, 1, 2], [2, 1, 2], [2, 2, 2]]


def test_segmentation(spark):
    """Two halves of different colours, with some noise."""
    img = np.zeros((10, 20, 3)) + 0.2
    img[:, 10:] = [0.9, 0.1, 0.5]
    img += np.random.default_rng(0).normal(0, 0.002, img.shape)
    rows = segments.segmentation(frame(spark, img), 4, 1).collect()
    assert len(rows) == 200 and {r.clusters for r in rows} == {2} and len({r.segment_id for r in rows}) == 2
    assert all((r.segment_id == 1) == (r.cl <= 10) for r in rows)


def test_transport_few():
    """Many problems at once, with equal costs, empty sources and sinks that want nothing, against one at a time."""
    rng = np.random.default_rng(8)
    for trial in range(60):
        m, k, q = rng.integers(1, 12), rng.integers(1, 6), rng.integers(1, 5)
        costs = rng.integers(0, 4, (m, k)).astype(float) if trial % 2 else rng.random((m, k))
        supply = rng.integers(0, 9, (q, m)) * rng.integers(0, 2, (q, m))
        demand = np.array([rng.multinomial(x, np.ones(k) / k) for x in supply.sum(axis=1)])
        got = kernels.transport_few(supply, demand, costs, trial % 5)
        assert np.allclose(got, [kernels.transport(a, b, costs)[0] for a, b in zip(supply, demand, strict=True)], atol=1e-9)
    with pytest.raises(ValueError):
        kernels.transport_few(np.ones((1, 2), dtype=int), np.ones((1, 3), dtype=int), np.ones((2, 3)))


@pytest.mark.parametrize(("mode", "n"), [("uniform", 2), ("grey", 6), ("grey", 9)])
def test_colorfulness_of_counts(spark, mode, n):
    """Counts of the colours that a photo has give what those of all colours give, and what one transport gives."""
    imgs = np.random.default_rng(9).random((3, 5, 7, 3)) ** 3
    px = frame(spark, imgs[0], 0).union(frame(spark, imgs[1], 1)).union(frame(spark, imgs[2], 2))
    got = {r.photo_id: r.colorfulness for r in segments.colorfulness(color.bucket_counts(px, n=n), mode, n).collect()}
    assert got == {r.photo_id: pytest.approx(r.colorfulness) for r in segments.colorfulness(color.color_buckets(px, n=n), mode, n).collect()}
    luv = segments.bucket_colours(n)
    to = luv if mode == "uniform" else luv[np.arange(n) * (n * n + n + 1)]
    costs = np.sqrt(((luv[:, None] - to[None]) ** 2).sum(axis=2))
    for i, img in enumerate(imgs):
        c = np.minimum(np.floor(img * n), n - 1).astype(int).reshape(-1, 3)
        counts = np.bincount(c @ [1, n, n * n], minlength=n**3)
        total, _ = kernels.transport(counts * len(to), np.full(len(to), counts.sum()), costs)
        assert got[i] == pytest.approx(total / (counts.sum() * len(to)))


def test_transport_against_lines():
    """On a line the least cost is the area between the running sums; masses may be 0, alone, or tied."""
    rng = np.random.default_rng(4)
    for _ in range(300):
        m, n = rng.integers(1, 9, 2)
        supply, demand = rng.integers(0, 7, m), np.zeros(n, dtype=np.int64)
        np.add.at(demand, rng.integers(0, n, supply.sum()), 1)
        x, y = rng.integers(0, 10, m), rng.integers(0, 10, n)
        costs = np.abs(x[:, None] - y[None, :]).astype(float)
        total, flow = kernels.transport(supply, demand, costs)
        area = sum(abs(supply[x <= t].sum() - demand[y <= t].sum()) for t in range(10))
        assert abs(total - area) < 1e-9 and (flow.sum(axis=1) == supply).all() and (flow.sum(axis=0) == demand).all() and (flow >= 0).all()
    with pytest.raises(ValueError):
        kernels.transport(np.ones(2), np.ones(3), np.ones((2, 3)))


def test_squares():
    """Largest squares of equal values against a plain search."""
    rng = np.random.default_rng(1)
    for _ in range(60):
        m = rng.integers(0, 2, rng.integers(1, 9, 2))
        h, w = m.shape
        want = [[max(k for k in range(1, min(h - r, w - c) + 1) if (m[r : r + k, c : c + k] == m[r, c]).all()) for c in range(w)] for r in range(h)]
        assert kernels.squares_from(m).tolist() == want


def test_sampled_pixels(spark):
    """Rows and columns of a thinned photo, rounded half to even; every pixel of a small one."""
    from lumenframe.operators import clusters

    for h, w, most in ((11, 7, 30), (5, 4, 100), (1, 9, 4), (40, 3, 17)):
        luv = spark.createDataFrame([(1, h, w, r, c, float(r), float(c), 0.0) for r in range(1, h + 1) for c in range(1, w + 1)], "photo_id long, h int, w int, rw int, cl int, l double, u double, v double")
        thin = max(1.0, math.sqrt(h * w / most))
        rows, cols = ([int(x) + 1 for x in np.unique(np.rint(np.linspace(0, n - 1, max(1, math.ceil(n / thin)))))] for n in (h, w))
        got = one(clusters.samples(luv, most))
        assert (got.h, got.w) == (len(rows), len(cols)) and list(zip(got.u, got.l, strict=True)) == [(c, r) for c in cols for r in rows]


def test_gaussian_blur(spark):
    """The shift of one column's red, as published."""
    img = np.floor(256 * runif(144, 1)).reshape((4, 12, 3), order="F") / 255
    got = raster_of(stencil.gaussian_blur(frame(spark, img)).collect(), "r") - img[:, :, 0]
    assert got[:, 1].tolist() == pytest.approx([0.20684652, -0.39785871, -0.36144287, -0.05093839], abs=2e-6)
    assert len(stencil.gaussian(3, 1.0)) == 3 and stencil.gaussian(1, 99.0) == [1.0]


def test_turns(spark):
    """Turns along one line are both; else one."""
    given = [(0.0, 1.0, 0.0, 1.0, True, True), (0.0, 1.0, 0.0, -3.0, True, True), (-2.0, 3.0, 4.0, -6.0, True, True), (0.0, 1.0, 0.1, 1000.0, True, False), (0.0, 1.0, -0.1, 1000.0, False, True), (-2.0, 3.0, 4.0, -5.9, True, False), (-2.0, 3.0, 4.0, -6.1, False, True)]
    got = segments.turn(spark.createDataFrame(given, "px double, py double, qx double, qy double, a boolean, b boolean")).collect()
    assert all((r.clockwise, r.counterclockwise) == (r.a, r.b) for r in got) and len(got) == len(given)


def raster_of(rows, column):
    h, w = max(r.rw for r in rows), max(r.cl for r in rows)
    out = np.full((h, w), np.nan)
    for r in rows:
        out[r.rw - 1, r.cl - 1] = r[column]
    return out


def test_padding(spark):
    img = np.arange(1.0, 37.0).reshape((3, 4, 3), order="F")
    got = raster_of(stencil.padded(1, 2)(frame(spark, img)).collect(), "r")
    assert got.tolist() == [[1, 1, 1, 4, 7, 10, 10, 10]] + [[k, k, k, k + 3, k + 6, k + 9, k + 9, k + 9] for k in (1, 2, 3)] + [[3, 3, 3, 6, 9, 12, 12, 12]]
    got = stencil.padded(1, 2, -8)(frame(spark, img)).collect()
    assert raster_of(got, "g").tolist() == [[-8] * 8] + [[-8, -8, k, k + 3, k + 6, k + 9, -8, -8] for k in (13, 14, 15)] + [[-8] * 8] and {(r.h, r.w) for r in got} == {(5, 8)}
    one_pixel = raster_of(stencil.padded(2, 1)(frame(spark, np.full((1, 1, 3), 0.5))).collect(), "b")
    assert (one_pixel == 0.5).all() and one_pixel.shape == (5, 3)
    with pytest.raises(ValueError):
        stencil.padded(1, 1, "circular")


def test_conv2_shapes(spark):
    """Only inner places are computed; the border of the full result is the photo's own."""
    m = np.array([[1, 5, 2, 3], [8, 7, 3, 6], [3, 3, 9, 1]], dtype=float)
    f = [[1.0, 2.0, 3.0], [0.0, 0.0, 0.0], [6.0, 5.0, 4.0]]
    px = frame(spark, np.stack([m] * 3, axis=2))
    assert raster_of(stencil.conv2_inner(f, "r")(px).collect(), "v").tolist() == [[65, 76]]
    assert raster_of(stencil.conv2_inner(f, "r", "full")(px).collect(), "v").tolist() == [[1, 5, 2, 3], [8, 65, 76, 6], [3, 3, 9, 1]]
    big = np.random.default_rng(0).integers(0, 9, (8, 7)).astype(float)
    px = frame(spark, np.stack([big] * 3, axis=2))
    same, valid = (raster_of(stencil.conv2_inner(f, "r", s)(px).collect(), "v") for s in ("same", "valid"))
    assert same.shape == (6, 5) and valid.shape == (4, 3) and (valid == same[1:5, 1:4]).all()
    with pytest.raises(ValueError):
        stencil.conv2_inner(f, "r", "most")


def test_line_distance(spark):
    px = frame(spark, np.zeros((3, 2, 3)))
    got = {(r.cl, r.rw): r for r in segments.line_distance(px, x1=4.0, y1=3.0, x2=6.0, y2=2.0).collect()}
    assert got[1, 2].to_segment == pytest.approx(math.sqrt(10), abs=1e-6)


def test_circular(spark):
    a = spark.createDataFrame([("a", x / 10) for x in range(20)] + [("b", math.pi)], "g string, x double")
    got = {r.g: r for r in circular.circ_summary(a).collect()}
    assert got["a"].mean_dir == pytest.approx(0.95, abs=1e-6) and got["b"].rho == 1
    k = one(circular.bessel_ratio(spark.createDataFrame([(2.0,)], "k double")))
    assert (k.i0, k.i1) == pytest.approx((2.279585, 1.590637), abs=1e-6)


def test_von_mises(spark):
    x = np.linspace(0, vonmises.TAU, 4001)
    density = np.exp(2.5 * np.cos(x - 1)) / (vonmises.TAU * np.i0(2.5))
    area = np.concatenate([[0], np.cumsum((density[1:] + density[:-1]) / 2 * np.diff(x))])
    assert np.abs(vonmises.cdf(x[:-1], 1.0, 2.5) - area[:-1]).max() < 1e-6
    p = np.array([0.05, 0.5, 0.9])
    assert np.allclose(vonmises.cdf(vonmises.quantile(p, 1.0, 2.5), 1.0, 2.5), p, atol=1e-9)
    d = vonmises.draws(spark.range(4000)).agg(F.avg(F.cos(F.col("von_mises") - 1)).alias("r"), F.avg(F.cos(F.col("wrapped_normal") - 1)).alias("n"), F.avg(F.cos(F.col("wrapped_cauchy") - 1)).alias("c"))
    r = one(d)
    assert (r.r, r.n, r.c) == pytest.approx((0.6977, 0.5, 0.5), abs=0.04)


def png(pixels):
    h, w, n = pixels.shape
    raw = b"".join(b"\0" + row.tobytes() for row in pixels.astype(np.uint8))
    chunk = lambda t, d: struct.pack(">I", len(d)) + t + d + struct.pack(">I", zlib.crc32(t + d))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, {1: 0, 3: 2}[n], 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def test_images(spark, tmp_path):
    rgb = np.arange(24).reshape(2, 4, 3) * 10
    (tmp_path / "7.png").write_bytes(png(rgb))
    (tmp_path / "8.png").write_bytes(png(rgb[:, :, :1]))
    px = files.read_images(spark, str(tmp_path))
    got = {(r.photo_id, r.rw, r.cl): (r.r8, r.g8, r.b8) for r in px.collect()}
    assert all(got[7, y + 1, x + 1] == tuple(rgb[y, x]) for y in range(2) for x in range(4))
    assert all(got[8, y + 1, x + 1] == (rgb[y, x, 0],) * 3 for y in range(2) for x in range(4))
    files.write_measures(color.exposure_contrast(px), str(tmp_path / "out"))
    assert files.read_measures(spark, str(tmp_path / "out")).count() == 2


def test_stream(spark, tmp_path):
    from lumenframe.streaming.ingest import measure_arrivals

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "7.png").write_bytes(png(np.arange(24).reshape(2, 4, 3) * 10))
    measure_arrivals(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1


def test_conv2(spark):
    m = np.arange(1, 10).reshape((3, 3), order="F") / 1.0
    px = frame(spark, np.dstack([m] * 3))
    op = stencil.conv2([[-1.0, -2.0, -1.0], [0.0, 0.0, 0.0], [1.0, 2.0, 1.0]], "r")
    got = np.zeros((3, 3))
    for r in op(px).collect():
        got[r.rw - 1, r.cl - 1] = r.v
    padded, k = np.pad(m, 1), np.array([[1, 2, 1], [0, 0, 0], [-1, -2, -1]])
    assert np.allclose(got, [[(padded[i : i + 3, j : j + 3] * k).sum() for j in range(3)] for i in range(3)])
    with pytest.raises(ValueError):
        stencil.conv2([[1.0, 1.0]])
