import itertools

from lumenframe.plans import catalog


def test_more_than_six_clusters(spark, monkeypatch):
    """A photo of eight colours, in blocks, has eight clusters in the registered query."""
    rows = []
    for rw, cl in itertools.product(range(1, 33), range(1, 33)):
        c = (rw - 1) // 16 * 4 + (cl - 1) // 8
        r, g, b = (255 * (c >> i & 1) for i in (2, 1, 0))
        rows.append((1, 32, 32, rw, cl, r, g, b, r / 255, g / 255, b / 255))
    px = spark.createDataFrame(rows, "photo_id long, h int, w int, rw int, cl int, r8 int, g8 int, b8 int, r double, g double, b double")
    monkeypatch.setattr(catalog.tables, "px", lambda spark, sf_dir: px)
    got = catalog.QUERIES["photo_segmentation"](spark, "").collect()
    assert len(got) == 1024 and {x.clusters for x in got} == {8} and len({x.segment_id for x in got}) == 8


def test_whole_search(spark, small, monkeypatch):
    """Each query that segments searches as far as the operator does, so that they agree about a photo."""
    calls, real = [], catalog.segments.segmentation

    def spy(px, k_max=30, restarts=3):
        calls.append((k_max, restarts))
        return real(px, k_max, restarts)

    monkeypatch.setattr(catalog.segments, "segmentation", spy)
    for name in ("photo_segmentation", "region_composition"):
        catalog.QUERIES[name](spark, small)
    catalog.model.measure_record(catalog.tables.px(spark, small))
    assert calls == [(30, 3)] * 3


def test_record_is_kept(spark, small):
    """The record is written once for the same files, and another table has one of its own."""
    from lumenframe.sources import store

    made = []

    def make(n):
        made.append(n)
        return spark.range(n)

    events, orders = (catalog.tables.read(spark, small, t) for t in ("events", "orders"))
    assert [store.once(spark, "t", df, lambda n=n: make(n)).count() for n, df in ((3, events), (4, events), (5, orders), (6, events))] == [3, 3, 5, 3] and made == [3, 5]
