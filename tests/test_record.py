"""The search for a photo's clusters, and the plan of the measure record."""

import numpy as np

from lumenframe.functions import kernels
from lumenframe.operators import clusters, segments, stencil
from lumenframe.plans import catalog, model

PIXELS = "photo_id long, h int, w int, rw int, cl int, r8 int, g8 int, b8 int, r double, g double, b double"


def _exchanges(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange ")


def test_nearest_is_exact():
    """Ties and near ties go as they do by plain squares."""
    rng = np.random.default_rng(1)
    for n, k, grid in ((200, 7, 1.0), (300, 30, 20.0), (50, 12, 0.0), (1, 3, 5.0)):
        x, centres = rng.random((n, 3)) * 100, rng.random((k, 3)) * 100
        if grid:
            x, centres = np.rint(x / grid) * grid, np.rint(centres / grid) * grid
        lifted = np.concatenate([x, np.ones((n, 1))], axis=1)
        assert kernels.nearest(x, lifted, centres, 1e-5).tolist() == kernels.squares(x, centres).argmin(axis=1).tolist()


def test_pixels_move_once(spark):
    """A search of any numbers of clusters is one group a photo; a thinned photo is assigned and labelled whole."""
    rng = np.random.default_rng(2)
    rows = []
    for photo, h, w in ((1, 9, 16), (2, 130, 90)):
        for rw in range(1, h + 1):
            for cl in range(1, w + 1):
                r8, g8, b8 = (int(v) for v in (255 * (rw * 2 > h), 255 * (cl * 2 > w), rng.integers(0, 9)))
                rows.append((photo, h, w, rw, cl, r8, g8, b8, r8 / 255, g8 / 255, b8 / 255))
    px = spark.createDataFrame(rows, PIXELS)
    found = segments.segmentation(px, 6, 2)
    assert _exchanges(found) == 1
    got = {}
    for r in found.collect():
        got.setdefault(r.photo_id, {})[r.rw, r.cl] = (r.segment_id, r.clusters)
    luv = clusters.LUV_PIXELS(px)
    for s in clusters.samples(luv).collect():
        x = np.array([s.l, s.u, s.v]).T
        centres = clusters.least_centres(s.photo_id, x, s.h, s.w, 6, 2, 20)
        own = luv.where(f"photo_id = {s.photo_id}").orderBy("rw", "cl").collect()
        of = kernels.squares(np.array([[p.l, p.u, p.v] for p in own]), centres).argmin(axis=1).reshape(own[0].h, own[0].w)
        label = kernels.components(of)
        assert got[s.photo_id] == {(p.rw, p.cl): (label[p.rw - 1, p.cl - 1], len(centres)) for p in own}


def test_record_has_a_small_plan(spark, small):
    """Measures are tables before they meet: no plan of the driver holds them all, and nothing is broadcast."""
    plan = model.measure_record(catalog.tables.px(spark, small), 2, 1)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert _exchanges(plan) <= 2 and "Broadcast" not in text and "ArrowEvalPython" not in text and "MapInArrow" not in text


def test_batched_search_is_plain():
    """Seeds, means, assignments and description lengths of many runs at once are those of one run after another."""

    def plain(x, k, rng, rounds, restarts):
        found = []
        for _ in range(restarts):
            centres = kernels.seeded(x, k, rng)
            for _ in range(rounds):
                of = kernels.squares(x, centres).argmin(axis=1)
                moved = np.array([x[of == i].sum(axis=0) / max(1, (of == i).sum()) if (of == i).any() else centres[i] for i in range(len(centres))])
                if (np.abs(moved - centres) <= 1e-8 + 1e-5 * np.abs(centres)).all():
                    break
                centres = moved
            d = kernels.squares(x, centres)
            found.append((centres, d.argmin(axis=1), d.min(axis=1).sum()))
        return min(found, key=lambda f: f[2])

    rng = np.random.default_rng(6)
    for n, grid, same in ((400, 0.0, 400), (150, 10.0, 150), (90, 0.0, 5), (5000, 0.0, 5000), (1, 0.0, 1)):
        x = (rng.random((same, 3)) * [100, 200, 200] - [0, 90, 90])[rng.integers(0, same, n)]
        x = np.rint(x / grid) * grid if grid else x
        stream = lambda k: np.random.default_rng([7, k])
        starts = kernels.seedings(x, range(1, 13), 2, stream)
        for k, centres, of, within in kernels.clusterings(x, starts, 20):
            again = stream(k)
            assert all((a == kernels.seeded(x, k, again)).all() for a in starts[k])
            want = plain(x, k, stream(k), 20, 2)
            assert len(centres) == len(want[0]) and abs(within - want[2]) <= 1e-9 * max(1.0, want[2])
            assert (kernels.squares(x, centres).argmin(axis=1) == of).all()


def test_bits_of_few_wide_squares():
    """The squares counted are those of the code itself."""
    rng = np.random.default_rng(8)
    for h, w, k in ((9, 7, 2), (1, 6, 1), (30, 20, 1), (12, 12, 3), (25, 16, 30)):
        m = rng.integers(0, k, (h, w))
        m[: h // 2, : w // 2] = 0
        code = kernels.rle2d(m)
        got = kernels.mdl_rle2d(m, k)
        assert got[1] == np.log2(len(code)) and got[2] == (len(code) * np.log2(k) if k > 1 else 0) and abs(got[3] - np.log2([c[2] for c in code]).sum()) < 1e-9


def test_search_sees_every_pixel(spark):
    """A photo of 20,000 pixels whose second colour lies only in rows that a sample of 10,000 would leave out."""
    h, w = 200, 100
    of = np.unique(np.rint(np.linspace(0, h - 1, int(np.ceil(h / np.sqrt(h * w / 10_000))))).astype(int))
    seen = set((of + 1).tolist())
    rows = [(1, h, w, rw, cl, 255, v, 0, 1.0, v / 255, 0.0) for rw in range(1, h + 1) for v in [0 if rw in seen else 255] for cl in range(1, w + 1)]
    got = segments.segmentation(spark.createDataFrame(rows, PIXELS), 3, 1).collect()
    bands = 1 + sum((rw in seen) != (rw + 1 in seen) for rw in range(1, h))
    assert len(got) == h * w and {r.clusters for r in got} == {2} and len({r.segment_id for r in got}) == bands


def test_record_deals_pixels_by_photo(spark, small, monkeypatch):
    """What the driver plans for the record: few shuffles in all, as windows of a photo share one; the widths of edges are those of ``mdwe``."""
    shuffles, made, real = [], {}, model.written

    def spy(df, name):
        shuffles.append(df._jdf.queryExecution().executedPlan().toString().count("Exchange hash"))
        out = real(df, name)
        made.setdefault(tuple(out.columns), out)
        return out

    for module in (model, stencil):
        monkeypatch.setattr(module, "written", spy)
    px = catalog.tables.px(spark, small)
    model.measure_record(px, 1, 1)
    assert sum(shuffles) <= 45
    got, want = made["photo_id", "MdweBlur", "MdweGaussian", "MdweJpeg2k"].collect(), stencil.mdwe(px).collect()
    assert len(got) == 10 and sorted(map(tuple, got)) == sorted(map(tuple, want))
