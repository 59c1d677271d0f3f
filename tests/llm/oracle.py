"""A query against its SQL, run by another engine."""

import duckdb

from lumenframe.llm import queries

TABLES = "documents embeddings pages benchmark labels conversations".split()


def both(spark, name, sf_dir):
    """Rows of the query and of its SQL, sorted, as tuples of one order of columns."""
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    cur = con.execute(queries.SQL[name])
    names = [x[0] for x in cur.description]
    df = queries.QUERIES[name](spark, sf_dir)
    assert sorted(df.columns) == sorted(names)
    return sorted(map(repr, (tuple(r) for r in df.select(*names).collect()))), sorted(map(repr, cur.fetchall()))
