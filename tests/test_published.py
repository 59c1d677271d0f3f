"""Values published with the measures' definitions."""

import numpy as np
import pytest

from lumenframe.operators import color, stencil

from .golden import frame, runif
from .test_golden import raster_of


@pytest.fixture(scope="module")
def img():
    return np.floor(256 * runif(144, 1)).reshape((4, 12, 3), order="F") / 255


@pytest.fixture(scope="module")
def px(spark, img):
    return frame(spark, img).cache()


def shift(op, px, img, column="r"):
    return (raster_of(op.collect(), column) - img[:, :, 0])[:, 1].tolist()


def test_luminance(px):
    assert px.selectExpr(f"avg({color.LUM}) as m").first().m == pytest.approx(0.5102388, abs=1e-6)


def test_blur_and_sharpness(px, img):
    assert shift(stencil.mean_blur(px), px, img) == pytest.approx([0.19084967, -0.43747277, -0.41176471, -0.08278867], abs=2e-6)
    assert shift(stencil.adjust_blur(px), px, img) == pytest.approx([0.09542484, -0.21873638, -0.20588235, -0.04139434], abs=2e-6)
    assert shift(stencil.adjust_blur(px, factor=1.0), px, img) == pytest.approx([-0.19084967, 0.10196078, 0.05490196, 0.08278867], abs=2e-6)
    rows = stencil.sharp_blur_amount(px).collect()
    sharp = [0.19084967, 0.43747277, 0.41176471, 0.08278867]
    assert raster_of(rows, "sharp_r")[:, 1].tolist() == pytest.approx(sharp, abs=2e-6) and raster_of(rows, "blur_r")[:, 1].tolist() == pytest.approx([1 - x for x in sharp], abs=2e-6)


def test_bright(px):
    assert raster_of(color.bright_rgb(px).collect(), "r")[:, 1].tolist() == pytest.approx([0, 1, 1, 0.628821], abs=2e-6)


def test_one_pixel(spark):
    px = frame(spark, np.array([[[200, 100, 150]]]) / 255)
    r = color.rgb_roundtrip(px).first()
    assert (r.r, r.g, r.b) == pytest.approx((200 / 255, 100 / 255, 150 / 255), abs=1e-6)
    a, b = color.hsv_pixels(px).first(), color.hsv_pixels(px, radians=1).first()
    assert a.hue == pytest.approx(330) and b.hue == pytest.approx(np.radians(330), abs=1e-6) and (a.sat, a.val) == (b.sat, b.val)
    assert color.rgb_roundtrip(px, radians=1).first() == r


def grey(spark, values):
    v = np.array(values, dtype=float)[None, :]
    return frame(spark, np.stack([v] * 3, axis=2) / 100)


def test_extrema(spark):
    for values, least, strict_least, most, strict_most in (
        ([11, 12, 14, 13, 15, 15, 17, 16], [1, 4, 6, 8], [4], [3, 5, 7], [3, 7]), ([11, 10, 14, 13, 15, 15, 17, 18], None, None, [1, 3, 5, 8], [3]), ([11, 11, 11], [1, 2, 3], [], [1, 2, 3], []),
    ):
        rows = stencil.local_extrema(grey(spark, values)).collect()
        at = lambda flag: sorted(r.cl for r in rows if r[flag])
        assert (at("maximum"), at("strict_maximum")) == (most, strict_most)
        assert least is None or (at("minimum"), at("strict_minimum")) == (least, strict_least)


def test_exposure_and_contrast(spark):
    u = runif(3200 * 3, 7)
    px = frame(spark, np.repeat((0.4 + np.floor(7 * u[:3200]) / 10).reshape(40, 80, 1), 3, axis=2))
    r = color.exposure_contrast(px).first()
    assert r.exposure == pytest.approx(0.84, abs=2e-2) and r.rms_contrast == pytest.approx(0.2, abs=1e-2)
    even = frame(spark, np.repeat((0.4 + 0.6 * u[3200:6400]).reshape(40, 80, 1), 3, axis=2))
    for interval, want in ((0.95, 0.57), (0.5, 0.3), (1.0, 0.6)):
        assert color.exposure_contrast(even, interval=interval).first().interval_contrast == pytest.approx(want, abs=2e-2)
    two = frame(spark, np.repeat(np.floor(2 * u[6400:]).reshape(40, 80, 1), 3, axis=2))
    r = color.exposure_contrast(two).first()
    assert r.rms_contrast == pytest.approx(0.5, abs=1e-3) and r.interval_contrast == pytest.approx(1.0, abs=1e-5)


def test_dominant_hue(spark):
    u = runif(80_000, 42)[20_000:].reshape(3, 20_000)
    img = np.stack([x.reshape((100, 200), order="F") for x in (0.3 + 0.6 * u[0], 0.55 + 0.4 * u[1], u[2])], axis=2)
    r = color.dominant_hue(frame(spark, img)).first()
    assert (r.mu, r.kappa, r.pi) == pytest.approx((1.844495, 1.048321, 0.57475), abs=1e-4)
