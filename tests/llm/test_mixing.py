import duckdb
import pytest
from pyspark.sql import functions as F

from lumenframe.llm import mixing, queries


def fit(cells, targets, rounds=30):
    """Plain IPF over {(a, b): tokens}."""
    w = dict(cells)
    total = sum(w.values())
    for _ in range(rounds):
        for i, t in enumerate(targets):
            for v, share in t.items():
                s = sum(x for k, x in w.items() if k[i] == v)
                if s:
                    w = {k: x * share * total / s if k[i] == v else x for k, x in w.items()}
    return w


def test_rake(spark):
    cells = {("x", "p"): 10.0, ("x", "q"): 40.0, ("y", "p"): 30.0, ("y", "q"): 20.0}
    got = mixing.rake(spark.createDataFrame([(*k, int(v)) for k, v in cells.items()], "a string, b string, tokens long"), {"a": {"x": 0.3, "y": 0.7}, "b": {"p": 0.5, "q": 0.5}}).collect()
    want = fit(cells, [{"x": 0.3, "y": 0.7}, {"p": 0.5, "q": 0.5}])
    for r in got:
        assert abs(r.ratio * r.tokens - want[r.a, r.b]) < 1e-9
    assert abs(sum(r.ratio * r.tokens for r in got if r.a == "x") - 30) < 1e-6


def test_edges(spark):
    rows = [(1, "s", "a b"), (2, None, "c"), (3, "t", None), (4, "t", ""), (4, "t", ""), (5, "zz", "d e f")]
    df = spark.createDataFrame(rows, "id int, source string, text string")
    run = lambda d, **k: mixing.mix(d, {"source": F.col("source")}, {"source": {"s": 0.5, "t": 0.5, "absent": 0.2}}, mixing.tokens_of(F.col("text")), F.col("id"), **k)
    out = run(df, rate=1.0).collect()
    assert {r.id for r in out} >= {2, 5}  # OTHER keeps its share
    assert run(df).count() <= 6 and run(df.limit(0)).count() == 0


def test_query(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    cells = docs.select("source", "lang", queries.topic(F.col("text")).alias("topic"), mixing.tokens_of(F.col("text")).alias("t")).collect()
    sums = {}
    for r in cells:
        sums[r.source, r.lang, r.topic] = sums.get((r.source, r.lang, r.topic), 0) + r.t
    t = queries.TARGETS
    there = [{c[i] for c, x in sums.items() if x} for i in range(3)]
    shares = [{k: v / sum(t[d][x] for x in have if x in t[d]) for k, v in t[d].items() if k in have} for d, have in zip(t, there, strict=True)]
    want = fit(sums, shares)
    for r in queries.op1_mixing(spark, small).collect():
        c = (r.source, r.lang, r.topic)
        assert abs(r.probability - min(1, want[c] / sums[c] * queries.MIX_RATE)) < 1e-5


def test_weighted_shares(spark, small):
    """Expected shares of the weighted sample are the targets, though many cells want probabilities above 1."""
    docs = spark.read.parquet(f"{small.replace('sf0.001', 'sf0.01')}/documents.parquet")
    dims = {"source": F.col("source"), "lang": F.col("lang"), "topic": queries.topic(F.col("text"))}
    tagged = docs.select(*[mixing.category(c, queries.TARGETS[d]).alias(d) for d, c in dims.items()], mixing.tokens_of(F.col("text")).alias("tokens"))
    cells = [r for r in mixing.calibrated(tagged.groupBy(*dims).agg(F.sum("tokens").alias("tokens")), queries.TARGETS, queries.MIX_RATE).collect()]
    assert any(r.weight > 1 for r in cells) and all(0 <= r.probability <= 1 and (r.weight == 1 or r.probability == 1) for r in cells)
    total = sum(r.tokens * r.probability * r.weight for r in cells)
    assert total == pytest.approx(queries.MIX_RATE * sum(r.tokens for r in cells), rel=1e-6)
    for d, t in queries.TARGETS.items():
        other = sum(r.tokens * r.probability * r.weight for r in cells if r[d] == mixing.OTHER) / total
        there = {k: v for k, v in t.items() if any(r[d] == k and r.tokens for r in cells)}
        for k, v in there.items():
            got = sum(r.tokens * r.probability * r.weight for r in cells if r[d] == k) / total
            assert got == pytest.approx(v / sum(there.values()) * (1 - other), rel=1e-3), (d, k)
    by_cell = {(r.source, r.lang, r.topic): r.weight for r in cells}
    out = queries.mixed(docs).collect()
    assert all(r.mix_weight == pytest.approx(by_cell[r.mix_source, r.mix_lang, r.mix_topic]) for r in out)


def test_weighted_oracle(spark, small):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{small}/documents.parquet')")
    df = queries.op1_mixing_weighted(spark, small)
    want = con.execute(queries.SQL["op1_mixing_weighted"])
    assert [x[0] for x in want.description] == df.columns
    key = lambda r: (r[0], *r[1:5])
    got, want = sorted(map(tuple, df.collect()), key=key), sorted(want.fetchall(), key=key)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert all(g[5:] == pytest.approx(w[5:], abs=2e-6) for g, w in zip(got, want, strict=True))


def test_clashing_columns(spark):
    """Columns of the result's names are replaced; a very long text weighs all of its words; repeated rows go together."""
    rows = [(1, "s", "a b", 9, "x"), (2, "t", "word " * 300_000, 9, "x"), (2, "t", "word " * 300_000, 9, "x"), (3, "t", "c", 9, None)]
    df = spark.createDataFrame(rows, "id int, source string, text string, mix_tokens int, mix_source string")
    out = mixing.mix(df, {"source": F.col("source")}, {"source": {"s": 0.5, "t": 0.5}}, mixing.tokens_of(F.col("text")), F.col("id"), rate=1.0).collect()
    assert all(r.mix_source == r.source and r.mix_tokens == len(r.text.split()) for r in out) and len(out[0].asDict()) == 7
    assert sum(r.id == 2 for r in out) in (0, 2) and {r.id for r in out} >= {1}
