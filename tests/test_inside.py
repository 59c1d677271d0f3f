import duckdb

from lumenframe.plans import catalog
from lumenframe.sources import tables


def test_hulls_without_area(spark, monkeypatch):
    """A largest segment on one line, upright or level, or of one pixel: no pixel beyond its ends is inside, for both engines."""
    shapes = {1: ["abab", "bccc", "abab"], 2: ["abab", "baba", "abab"], 3: ["acab", "acba", "bcab"], 4: ["ccca", "cbab", "abca"]}
    colour = {"a": (0, 0, 0), "b": (255, 0, 0), "c": (0, 255, 0)}
    rows = [(photo, 3, 4, r, c, *colour[v], *(x / 255 for x in colour[v])) for photo, lines in shapes.items() for r, line in enumerate(lines, 1) for c, v in enumerate(line, 1)]
    px = spark.createDataFrame(rows, "photo_id long, h int, w int, rw int, cl int, r8 int, g8 int, b8 int, r double, g double, b double")
    monkeypatch.setattr(catalog.tables, "px", lambda spark, sf_dir: px)
    got = {(r.photo_id, r.rw, r.cl): r.inside for r in catalog.QUERIES["inside_largest"](spark, "").collect()}
    db = duckdb.connect()
    db.execute("create table given (photo_id bigint, h int, w int, rw int, cl int, r8 int, g8 int, b8 int, r double, g double, b double)")
    db.executemany("insert into given values (?, ?, ?, ?, ?, ?, ?, ?, ?, ?, ?)", rows)
    want = db.execute(catalog.SQL["inside_largest"].replace(tables.ANSI["px"], "select * from given")).fetchall()
    assert {(p, r, c): i for p, r, c, i in want} == got and len(got) == 48
    assert [sum(got[k] for k in got if k[0] == p) for p in shapes] == [3, 1, 3, 4]
