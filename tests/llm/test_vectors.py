import numpy as np
import pytest

from lumenframe.llm import hnsw, neardup, queries
from lumenframe.llm.vectors import unit

NAN, INF = float("nan"), float("inf")


def data(seed, n=400, dim=16):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim)).astype(np.float32)
    for i in range(n // 3):
        x[rng.integers(n)] = x[rng.integers(n)] + rng.normal(size=dim).astype(np.float32) * rng.choice([0, 0.05, 0.3, 0.4])
    x[10:30] = x[9] + rng.normal(size=(20, dim)).astype(np.float32) * 0.1
    x[40:60] = x[39]
    x[61] = x[60] * 7
    return [(i, [float(y) for y in v]) for i, v in enumerate(x)]


ODD = [(-5, None), (1000, []), (1001, [0.0] * 16), (1002, [NAN] + [1.0] * 15), (1003, [INF] + [1.0] * 15), (1004, [None] + [1.0] * 15), (1005, [1.0, 2.0])]
SCHEMA = "vec_id long, embedding array<float>"


def cosines(rows):
    x = np.array([v for _, v in rows], dtype=np.float64)
    norm = np.sqrt((x * x).sum(axis=1))
    return x @ x.T / (norm[:, None] * norm[None, :])


@pytest.mark.parametrize("block", [64, 4096])
def test_neardup(spark, monkeypatch, block):
    monkeypatch.setattr(neardup, "BLOCK", block)
    monkeypatch.setattr(neardup, "STRIP", 50)
    rows = data(1)
    got = {r.vec_id: r for r in neardup.dedup(spark.createDataFrame(rows + ODD, SCHEMA).repartition(3)).collect()}
    assert len(got) == len(rows) + len(ODD)
    near = cosines(rows) >= 0.9
    np.fill_diagonal(near, False)
    label = np.arange(len(rows))
    for _ in rows:
        label = np.array([min([label[i], *label[near[i]]]) for i in range(len(rows))])
    for i, _ in rows:
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (near[i].sum(), label[i], label[i] == i)
    for i, _ in ODD:
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)


def test_bounds():
    x = np.array([v for _, v in data(2)], dtype=np.float64)
    pairs, doubtful, side = set(), 0, neardup.Side.of(np.arange(len(x)), np.arange(len(x)), np.ones(len(x), dtype=np.int64), x)
    for i, j, sure in neardup.tile(side, side, 0.9, True):
        linked = sure | neardup.exact(x[i], x[j], 0.9) if len(i) else sure
        assert (neardup.exact(x[i[sure]], x[j[sure]], 0.9)).all() if sure.any() else True
        pairs |= set(zip(i[linked].tolist(), j[linked].tolist(), strict=True))
        doubtful += (~sure).sum()
    near = cosines(list(enumerate(x))) >= 0.9
    np.fill_diagonal(near, False)
    assert pairs == set(zip(*(a.tolist() for a in np.nonzero(near)), strict=True)) and doubtful < len(pairs)


@pytest.mark.parametrize("shard", [100, 8192])
def test_hnsw(spark, monkeypatch, shard):
    monkeypatch.setattr(hnsw, "SHARD", shard)
    monkeypatch.setattr(hnsw, "BLOCK", 10)
    rows = data(3)
    got = hnsw.neighbours(spark.createDataFrame(rows + ODD, SCHEMA).repartition(3), "vec_id % 10 = 0").collect()
    c = cosines(rows)
    found = {}
    for r in got:
        found.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    hits = 0
    for q in range(0, 400, 10):
        mine = [found[q][i] for i in range(1, 6)]
        assert all(i != q and abs(s - c[q, i]) < 1e-12 for i, s in mine) and mine == sorted(mine, key=lambda x: (-x[1], x[0]))
        best = sorted((round(-c[q, i], 9), i) for i in range(400) if i != q)[:5]
        hits += len({i for _, i in best} & {i for i, _ in mine})
    assert hits >= 0.95 * 200 and set(found) == set(range(0, 400, 10))


def test_repeated_rows(spark):
    """Rows that repeat count once; an id with two vectors is found by the nearer one; neither is a neighbour of itself."""
    rows = [(0, [1.0, 0.0])] * 3 + [(7, [1.0, 0.1])] * 9 + [(3, [1.0, 0.5]), (3, [0.0, 1.0]), (9, [0.0, 2.0]), (0, [1.0, 0.0])]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA + ", rank int, v string")
    got = sorted((r.query_id, r["rank"], r.vec_id) for r in hnsw.neighbours(df, "vec_id % 50 = 0").collect())
    assert got == [(0, 1, 7), (0, 2, 3), (0, 3, 9)]
    linked = sorted((r.vec_id, r.n_links, r.component_id) for r in neardup.dedup(df.where("vec_id in (0, 7)")).collect())
    assert linked == [(0, 12, 0)] * 4 + [(7, 12, 0)] * 9


def test_repeated_ids(spark):
    """A row links by its own vector, whatever other vectors its id has."""
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (5, [1.0, 0.1]), (9, [-1.0, 0.0])]
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in neardup.dedup(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [(1, 0, 1, True), (1, 1, 1, True), (5, 1, 1, False), (9, 0, 9, True)]


def test_ties(spark):
    """Of equal cosines the smaller ids are nearer, within a shard and across shards."""
    for rows in ([(i, [2.0 ** (i % 7 - 3) * (1 + i // 7), 3.0 * 2.0 ** (i % 7 - 3) * (1 + i // 7)]) for i in range(20)], [(i, [2.0 ** ((i * 13) % 20), 2.0 ** ((i * 13) % 20 + 1)]) for i in range(20)]):
        exact = [r for r in rows if np.log2(r[1][0]) % 1 == 0]
        got = [(r["rank"], r.vec_id) for r in hnsw.neighbours(spark.createDataFrame(exact, SCHEMA).repartition(3), "vec_id = 0").collect()]
        assert sorted(got) == [(i, v) for i, (v, _) in enumerate(exact[1:6], 1)]


def test_hubs(spark):
    """Components with a hub whose edges come by a broadcast are those without."""
    from lumenframe.operators.graph import components

    edges = [(0, i) for i in range(1, 60)] + [(i, i + 1) for i in range(100, 140)] + [(140, 59), (7, 7), (200, 201), (201, 200), (300, None)]
    df = spark.createDataFrame(edges, "a long, b long").repartition(3)
    want = {i: 0 for i in [*range(60), *range(100, 141)]} | {200: 200, 201: 200}
    for hub in (3, 100_000):
        assert {r.node: r.label for r in components(df, hub).collect()} == want


def test_few(spark):
    rows = [(0, [1.0, 0.0]), (50, [1.0, 1.0]), (7, [0.0, 1.0])]
    got = sorted((r.query_id, r["rank"], r.vec_id) for r in hnsw.neighbours(spark.createDataFrame(rows, SCHEMA), "vec_id % 50 = 0").collect())
    assert got == [(0, 1, 50), (0, 2, 7), (50, 1, 0), (50, 2, 7)]
    assert hnsw.neighbours(spark.createDataFrame([], SCHEMA), "vec_id % 50 = 0").count() == 0
    assert neardup.dedup(spark.createDataFrame([], SCHEMA)).count() == 0


def test_query(spark, small):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{small}/embeddings.parquet").collect()]
    c = cosines(rows)
    place = {v: i for i, (v, _) in enumerate(rows)}
    hits = n = 0
    for r in queries.op2_hnsw(spark, small).collect():
        q = place[r.query_id]
        fifth = sorted((-c[q, i] for i in range(len(rows)) if i != q))[4]
        hits, n = hits + (-r.score <= fifth + 1e-12), n + 1
    assert n == 5 * sum(v % 50 == 0 for v, _ in rows) and hits >= 0.97 * n
    near = c >= 0.9
    assert all(r.n_links == near[place[r.vec_id]].sum() - 1 for r in queries.op8_neardup(spark, small).collect())
