import numpy as np
import pytest

from lumenframe.plans import model

NAMES = ["Blur", "AverageHue", "AvgHuePatch1", "PositionPatch1", "DdcCompactness", "AverageCentralSaturation", "Odd"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(80, len(NAMES))).tolist()
    for i, r in enumerate(x):
        r[4], r[5] = (None, 1e-7)[i % 2] if i % 4 == 0 else 2.0 + r[4] ** 2, 0.5 if i % 8 else 0.0
        r[2], r[3], r[6] = (None, None, None) if i % 10 == 9 else r[2:4] + [r[6]]
    counts = rng.integers(0, 9, size=(80, 10))
    rated = [(i, int(c.sum()), float((c * np.arange(1, 11)).sum() / c.sum()), *map(int, c)) for i, c in enumerate(counts)]
    record = spark.createDataFrame([(i, *r) for i, r in enumerate(x)], "photo_id long, " + ", ".join(f"{n} double" for n in NAMES))
    ratings = spark.createDataFrame(rated, "photo long, num long, rating double, " + ", ".join(f"num{i} long" for i in range(1, 11)))
    return model.rated(record, ratings).cache()


def test_rated(rows):
    got = {r.photo: r for r in rows.collect()}
    assert len(got) == 80 and got[9].AvgHuePatch1 == 0 and got[9].PositionPatch1 == 22 and got[9].Odd is None
    assert all(r.bw == (i % 4 == 0) for i, r in got.items())


def test_correlation_matrix(rows):
    pdf = rows.toPandas()
    for kind, mine in (("all", pdf), ("colour", pdf[~pdf.bw]), ("bw", pdf[pdf.bw])):
        got = {(r.a, r.b): r.r for r in model.correlation_matrix(rows, kind).collect()}
        assert ("Blur", "AverageHue") in got or kind == "bw"
        assert (("Blur", "DdcCompactness") in got) == (kind == "colour")
        for (a, b), r in got.items():
            if mine[[a, b]].isna().any(axis=None):
                assert r is None
            elif mine[a].nunique() < 2 or mine[b].nunique() < 2:
                assert r == (1.0 if a == b else None)
            else:
                assert abs(r - np.corrcoef(mine[a], mine[b])[0, 1]) < 1e-9


@pytest.mark.parametrize("kind", ["all", "colour", "bw"])
def test_rating_model(rows, kind):
    pdf = rows.toPandas()
    names = model.measures_of(rows, kind)
    assert names == (NAMES if kind == "colour" else ["Blur", "PositionPatch1", "Odd"])
    mine = pdf if kind == "all" else pdf[pdf.bw == (kind == "bw")]
    mine = mine.dropna(subset=names)
    a = np.column_stack([np.ones(len(mine)), mine[names]])
    want = dict(zip(mine.photo, a @ np.linalg.lstsq(a, mine.rating.to_numpy(), rcond=None)[0], strict=True))
    got = {r.photo: r.prediction for r in model.rating_model(rows, kind).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-4 for k in want)
    assert model.rating_model(rows.where("false"), kind).count() == 0


def test_model_report(rows):
    r = model.model_report(rows, trees=5).first()
    n = len(rows.where("not bw").toPandas().dropna())
    assert r.n_train + r.n_test == n and r.n_test > 5
    assert r.low <= r.high and r.mean_sd > 0 and r.mean_abs > 0 and -1 <= r.reference_corr <= 1 and 0 <= r.chance_corr <= 1
    assert model.model_report(rows.where("false")).first().n_train == 0
