import math
import re

import duckdb
import pytest

from lumenframe.operators import circular
from lumenframe.plans import catalog

TWO_LEVEL = {"circ_range": "a", "rao_spacing": "a", "kuiper": "a", "watson_uniform": "a", "edf": "a", "watson_two": "two", "change_point": "ordered"}


def compare(df, con, sql):
    names = [x[0] for x in con.execute(sql).description]
    as_rows = lambda rows: sorted(repr([float(v) if isinstance(v, (int, float)) else v for v in r]) for r in rows)
    assert df.columns == names and as_rows(df.collect()) == as_rows(con.execute(sql).fetchall())


def test_watson_two_whole(spark, small):
    """Every event counts."""
    con = duckdb.connect()
    con.execute(f"create view events as select * from read_parquet('{small}/events.parquet')")
    df = catalog.QUERIES["watson_two"](spark, small)
    assert sum(df.first()[:2]) == spark.read.parquet(f"{small}/events.parquet").count()
    compare(df, con, catalog.SQL["watson_two"])


@pytest.mark.parametrize("name", TWO_LEVEL)
def test_ties_and_cells(spark, name):
    """Equal angles, gaps over many cells, both ends of the circle, a group of one row."""
    xs = [0.0, 0.0, 1e-4, 1e-4, 2 * math.pi - 1e-9, 2 * math.pi, 7.0, 0.7168146928204138, -3.0, 3.0, 3.0, 3.0, 3.0003, 5.5]
    rows = [(g, x + d, 1 + i % 2, i * i * 7 - 50) for g, d in (("p", 0.0), ("q", 0.3)) for i, x in enumerate(xs)] + [("one", 1.0, 1, 5)]
    df = spark.createDataFrame(rows, "g string, x double, side int, o long")
    con = duckdb.connect()
    con.execute("create table t (g varchar, x double, side int, o bigint)")
    con.executemany("insert into t values (?, ?, ?, ?)", rows)
    op = getattr(circular, name)
    compare(op(df), con, op.ansi({TWO_LEVEL[name]: "select * from t"}))


@pytest.mark.parametrize("name", TWO_LEVEL)
def test_no_window_over_a_group(spark, name):
    """Windows over rows hold a cell of a group; those over a whole group run over its cells."""
    df = getattr(circular, name)(spark.createDataFrame([("p", 1.0, 1, 1)], "g string, x double, side int, o long"))
    specs = re.findall(r"windowspecdefinition\(([^()]*)", df._jdf.queryExecution().analyzed().toString())
    assert specs and all("cell#" in s for s in specs if re.search(r"\b[xo]#", s))
    assert all(re.search(r"\bcell#", s) or not s.count("ASC") for s in specs)
