import math

import pytest

from lumenframe.functions import sql
from lumenframe.operators import color

from .golden import image


def test_functions(spark):
    names = sql.register_functions(spark)
    assert len(names) == len(sql.FUNCTIONS)
    one = lambda text: spark.sql(f"select {text} as v").first().v
    assert one("photo_luminance(1, 0.5, 0)") == pytest.approx(0.212673 + 0.715152 / 2)
    assert one("photo_hue(165 / 255D, 107 / 255D, 11 / 255D)") == pytest.approx(37.4025974) and one("photo_hue(0.5, 0.5, 0.5)") is None
    assert one("photo_saturation(0, 0, 0)") == 0 and one("photo_limited(3, 0, 1)") == 1
    assert one("photo_full_turn(-1)") == pytest.approx(2 * math.pi - 1) and one("photo_circular_distance(6, 0.2)") == pytest.approx(2 * math.pi - 5.8)
    assert one("photo_concentration(1)") is None and one("photo_concentration(0)") == 0
    total = spark.sql("select sum(photo_von_mises_density(id / 100D, 1, 2.5)) / 100 as v from range(0, 628)").first().v
    assert total == pytest.approx(1, abs=2e-3)


def test_over_rows(spark):
    px = image(spark, (5, 6, 3))
    px.createOrReplaceTempView("some_pixels")
    sql.register_functions(spark)
    got = {(r.rw, r.cl): r.h for r in spark.sql("select rw, cl, photo_hue(r, g, b) as h from some_pixels").collect()}
    assert all(got[r.rw, r.cl] == pytest.approx(r.hue, abs=1e-5) for r in color.hsv_pixels(px).collect())


def test_measures(spark):
    px = image(spark, (12, 16, 3))
    names = sql.register_measures(px)
    assert set(names) == {f"photo_{n}" for n in sql.MEASURES}
    row = spark.sql("select e.exposure, a.hue from photo_exposure_contrast e join photo_hsv_averages a using (photo_id)").first()
    assert row.exposure == color.exposure_contrast(px).first().exposure and row.hue == color.hsv_averages(px).first().hue
    assert all(spark.table(n).count() >= 0 for n in names)
