import random
import re

import numpy as np
import pytest

from lumenframe.llm import jaccard, queries, shingles

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


def sets(texts, n):
    out = {}
    for d, t in texts.items():
        w = WORD.findall(lower(t or ""))
        out[d] = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    return out


def brute(texts, n, num, den):
    s = sets(texts, n)
    ids = sorted(s)
    root = {d: d for d in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    by = {}
    for d in ids:
        for g in s[d]:
            by.setdefault(g, []).append(d)
    seen = set()
    for g in by.values():
        for i, a in enumerate(g):
            for b in g[i + 1 :]:
                if (a, b) not in seen:
                    seen.add((a, b))
                    if den * len(s[a] & s[b]) >= num * len(s[a] | s[b]):
                        x, y = sorted((find(a), find(b)))
                        root[y] = x
    return {d: (len(s[d]), find(d)) for d in ids}


def near(rnd, words, times):
    words = list(words)
    for _ in range(times):
        i = rnd.randrange(len(words))
        words[i : i + rnd.randint(0, 1)] = [rnd.choice("abcdefgh") * rnd.randint(1, 3)]
    return words


def corpus(seed, m=220):
    rnd = random.Random(seed)
    vocab = ["".join(rnd.choices("abcdefghijklmnopqrstuvwxyzé", k=rnd.randint(1, 7))) for _ in range(400)]
    passage = rnd.choices(vocab, k=60)
    base = [rnd.choices(vocab, k=rnd.choice([3, 4, 5, 8, 15, 30, 60, 150, 400, 900])) for _ in range(40)]
    texts = [None, "", " \n\t ", "one", "ONE", "one two three", "x" * 3000, "A b C d e", "a B c D e"]
    for _ in range(m):
        w = list(rnd.choice(base))
        if rnd.random() < 0.3:
            i = rnd.randrange(len(w) + 1)
            w[i:i] = passage
        texts.append(rnd.choice([" ", "\n", "  "]).join(near(rnd, w, rnd.choice([0, 0, 1, 1, 2, 3, 6, 12]))))
    return dict(enumerate(texts))


@pytest.mark.parametrize(("seed", "n", "num", "limits"), [
    (2, 5, 80, {}), (4, 4, 85, {"members": 8}), (5, 4, 40, {"members": 4, "hashes": 2000, "heavy_least": 5, "heavy_most": 1 << 14}),
])
def test_brute_force(spark, seed, n, num, limits):
    """Whole, with heavy keys, and with clusters and tiles cut into blocks."""
    texts = corpus(seed)
    df = spark.createDataFrame([(d, t, "x", 1, 2) for d, t in texts.items()], "doc_id long, text string, label string, n int, component_id int").repartition(3)
    out = jaccard.join(df, n=n, num=num, **limits)
    assert out.columns == ["doc_id", "n_shingles", "class_id", "component_id"]
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out.collect()} == brute(texts, n, num, 100)


def test_large_cluster(spark, monkeypatch):
    """Near copies that share many tiles are compared as one: each has one row, not one for each tile."""
    rnd = random.Random(7)
    base = [f"w{i}" for i in range(120)]
    texts = {d: " ".join(near(rnd, base, rnd.randint(1, 4))) for d in range(90)}
    texts |= {100 + d: " ".join(near(rnd, base[::-1], 1)) for d in range(3)}
    counts, real = [], jaccard._larger
    monkeypatch.setattr(jaccard, "_larger", lambda tiles, *a: (counts.append(tiles.count()), real(tiles, *a))[1])
    out = jaccard.join(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), n=4, num=85, members=16)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out.collect()} == brute(texts, 4, 85, 100)
    assert len(counts) == 1 and 16 < counts[0] <= 90


def test_sizes_far_apart(spark):
    """Sets of 8 and of 20 shingles that share 8: 40 of 100."""
    words = [f"w{i}" for i in range(23)]
    df = spark.createDataFrame([(1, " ".join(words[:11])), (2, " ".join(words)), (3, " ".join(words[4:15]))], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in jaccard.join(df, n=4, num=40).collect()} == {1: 1, 2: 1, 3: 1}
    assert {r.doc_id: r.component_id for r in jaccard.join(df.where("doc_id < 3"), n=4, num=41).collect()} == {1: 1, 2: 2}


def test_repeated_ids(spark):
    """Rows of one id and text are copies; an id with two texts links where either does."""
    a, b, c = (" ".join(f"{k}{i}" for i in range(60)) for k in "abc")
    rows = [(5, a), (5, a), (7, a), (5, b), (9, b + " more"), (4, c), (4, c), (3, "c0 " + c), (8, c + " x")]
    got = sorted((r.doc_id, r.n_shingles, r.class_id, r.component_id) for r in jaccard.join(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(3, 57, 3, 3), (4, 56, 4, 3), (4, 56, 4, 3), (5, 56, 5, 5), (5, 56, 5, 5), (5, 56, 5, 5), (7, 56, 5, 5), (8, 57, 8, 3), (9, 57, 9, 5)]


def test_empty(spark):
    assert jaccard.join(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    rows = jaccard.join(spark.createDataFrame([(1, None), (2, ""), (None, "a b")], "doc_id long, text string")).collect()
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in rows} == {(1, 0, 1), (2, 0, 2), (None, 1, None)}


@pytest.mark.parametrize(("num", "den"), [(85, 100), (80, 100), (40, 100), (1, 1)])
def test_shares(num, den):
    """What linked sets share of their keys is more than either may drop."""
    rng = np.random.default_rng(5)
    for size in [1, 2, 3, 5, 6, 7, 10, 20, 50, 200, 1000]:
        for _ in range(20):
            x = np.unique(rng.integers(0, 1 << 63, size, dtype=np.uint64))
            y = np.unique(np.concatenate([x[rng.permutation(len(x))[rng.integers(0, max(1, size * (den - num) // den) + 1) :]], rng.integers(0, 1 << 63, rng.integers(0, size // 5 + 1), dtype=np.uint64)]))
            if len(y) and jaccard.enough(len(np.intersect1d(x, y)), len(x) + len(y), num, den):
                given, drop = jaccard.shares(np.array([len(x), len(y)]), num, den)
                assert len(np.intersect1d(x[: given[0]], y[: given[1]])) > drop.max()
                band = np.searchsorted(jaccard.edges(num, den), [len(x), len(y)], side="right")
                assert abs(band[0] - band[1]) <= 1


@pytest.mark.parametrize("cross", [False, True])
def test_connect(cross):
    rng = np.random.default_rng(6)
    pool = np.unique(rng.integers(0, 1 << 63, 400, dtype=np.uint64))
    sets = [np.unique(rng.choice(pool[: 100 * (1 + i % 4)], rng.integers(1, 300))) for i in range(120)]
    sets += [np.unique(np.concatenate([s[rng.integers(0, 4) :], rng.integers(0, 1 << 63, 2, dtype=np.uint64)])) for s in sets]
    label, side, up = np.arange(len(sets)) + 1000, rng.random(len(sets)) < 0.5, rng.random(len(sets)) < 0.3
    root = {int(x): int(x) for x in label}

    def find(x):
        return x if root[x] == x else find(root[x])

    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            both = len(np.intersect1d(x, y))
            if both * 100 >= 70 * (len(x) + len(y) - both) and not (up[i] and up[j]) and (not cross or side[i] != side[j]):
                a, b = sorted((find(int(label[i])), find(int(label[j]))))
                root[b] = a
    got = dict(jaccard.connect(label, sets, up, side, cross, 70, 100))
    assert {int(x): got.get(int(x), int(x)) for x in label} == {int(x): find(int(x)) for x in label}


def test_long_texts(monkeypatch):
    text = b" ".join(b"w%d" % (i % 977) for i in range(3000)) + b" " + b"z" * 900
    whole = list(shingles.sets_of([b"a b c d e", text, None], 4))
    monkeypatch.setattr(shingles, "PIECE", 500)
    assert all(np.array_equal(a, b) for a, b in zip(whole, shingles.sets_of([b"a b c d e", text, None], 4), strict=True))


def test_query(spark, small):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in queries.op3_jaccard(spark, small).collect()}
    assert got == brute(texts, 4, 85, 100)
