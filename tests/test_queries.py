import math

import duckdb
import numpy as np
import pytest

from lumenframe.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
FEW = "rasters vm_ml rao_spacing exposure_contrast hsv_pixels dominant_hue gaussian_blur blur_annoyance otsu wavelet_dof components top5_segments circ_summary kuiper watson_two change_point ratings_join error_metrics scrape_links emboss_full emboss_valid emboss_padded gaussian_blur_2d hsv_radians xyz_plain turns binomial hull_inside color_buckets dominant_hue_spread".split()


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{small}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", FEW)
def test_oracle(spark, duck, small, name):
    df = catalog.QUERIES[name](spark, small)
    cur = duck.execute(catalog.SQL[name])
    names = [x[0] for x in cur.description]
    want = sorted(map(repr, ([float(v) if isinstance(v, (int, float)) else v for v in r] for r in cur.fetchall())))
    got = sorted(repr([float(v) if isinstance(v, (int, float)) else v for v in r]) for r in df.select(*names).collect())
    assert got == want and sorted(df.columns) == sorted(names)


def test_measure_record(spark, small):
    df = catalog.QUERIES["measure_record"](spark, small)
    assert len(df.columns) == 72 and df.count() == 10 and df.columns[-1] == "DdcNormSpatial"
    spark.catalog.clearCache()


def test_probabilities(spark, small):
    """Probability plots of a fit that is no worse than uniform; p-values; draws within the circle."""
    rows = catalog.QUERIES["pp_data"](spark, small).collect()
    assert rows and all(0 < r.empirical < 1 and (r.fitted is None or -1e-9 <= r.fitted <= 1 + 1e-9) for r in rows)
    for name, cols in (("circ_cor_test", ["p_value"]), ("rao_homogeneity_test", ["p_polar", "p_disp"]), ("vm_mixed_cdf", ["p"])):
        assert all(-1e-9 <= r[c] <= 1 + 1e-9 for r in catalog.QUERIES[name](spark, small).collect() for c in cols)
    drawn = catalog.QUERIES["random_circular"](spark, small)
    assert all(0 <= r[c] <= 2 * math.pi for r in drawn.collect() for c in drawn.columns if c not in ("id", "stable"))


def test_distributions():
    from lumenframe.functions import vonmises

    assert abs(vonmises.chi_square_tail(3.841459, 1) - 0.05) < 1e-6 and abs(vonmises.chi_square_tail(9.487729, 4) - 0.05) < 1e-6 and abs(vonmises.chi_square_tail(11.0705, 5) - 0.05) < 1e-6
    p = np.array([0.01, 0.3, 0.5, 0.9])
    t = vonmises.cardioid_quantile(p, 0.4)
    assert np.allclose((t + 0.8 * np.sin(t)) / (2 * math.pi), p) and abs(vonmises.triangular_quantile(np.array([0.5]), 0.2)[0] - math.pi) < 1e-9


def test_too_many_buckets(spark):
    from lumenframe.operators import color

    with pytest.raises(ValueError):
        color.color_buckets.text(n=33)


@pytest.mark.parametrize("name", ["circ_reg", "colorfulness", "colorfulness_grey", "kmeanspp", "region_composition"])
def test_runs(spark, small, name):
    assert catalog.QUERIES[name](spark, small).count() > 0


def test_shaped(spark):
    from pyspark.errors import PySparkException
    from pyspark.sql import functions as F

    from lumenframe.operators import raster

    df = spark.createDataFrame([(list(range(1, 7)), 3), ([], 3)], "v array<int>, w int")
    assert [r[0] for r in df.select(raster.shaped(F.col("v"), F.col("w"))).collect()] == [[[1, 2, 3], [4, 5, 6]], []]
    with pytest.raises(PySparkException):
        df.select(raster.shaped(F.col("v"), F.lit(4))).collect()
