import re
from collections import Counter
from math import floor, log

import numpy as np
import pytest

from lumenframe.llm import lexical
from lumenframe.llm.terms import LETTERS_AND_DIGITS, PIECE, counts

from .oracle import both

SMALL = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(SMALL))


def plain(docs, items, k):
    """Every score of every row, sorted."""
    found = [Counter(terms(t)) for _, t in docs]
    n, size = sum(1 for c in found if c), sum(c.total() for c in found)
    df = Counter(t for c in found for t in c)
    out = []
    for item, text in set(items):
        if item is None:
            continue
        scored = []
        for (doc, _), c in zip(docs, found, strict=True):
            m = 75 + (25 * c.total() * n) // size if size else 0
            s = sum(floor(1000 * log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m)) for t in terms(text) if t in c)
            if s > 0 and doc is not None:
                scored.append((-s, doc))
        out += [(item, i, doc, -s) for i, (s, doc) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out)


@pytest.fixture(scope="module")
def docs():
    rng = np.random.default_rng(3)
    words = np.array([f"w{i}" for i in range(60)] + ["Ünï", "É9", "x_y", "I'm", "10.5"])
    rows = [(int(i), " ".join(rng.choice(words, rng.integers(0, 40), p=np.arange(65, 0, -1) / np.arange(66).sum()))) for i in range(300)]
    rows += [(i + 400, "w1 w2 w2 w50") for i in range(60)] + [(1, "w3"), (1, "w3"), (700, None), (701, ""), (None, "w1 w4 w4"), (702, "w7 " * 30000), (-5, "w1 w2 w2 w50"), (703, "a" * (PIECE + 50) + " w59")]
    return rows


def test_search(spark, docs):
    items = [(0, "w1 w2 w2 W50 nowhere"), (1, "w59, w58; w3"), (2, ""), (3, None), (4, "w7 w7 w7 É9 ünï"), (4, "w7 w7 w7 É9 ünï"), (5, " ".join(f"w{i}" for i in range(60))), (6, "x_y 10 5"), (6, "w8"), (None, "w1")]
    d = spark.createDataFrame([(i, t, 1, 2.0) for i, t in docs], "doc_id long, text string, rank int, score double").repartition(5)
    q = spark.createDataFrame([(i, t, "z") for i, t in items], "item_id int, text string, doc_id string")
    for k, together in ((20, 10**6), (7, 8), (500, 30)):
        assert sorted(tuple(r) for r in lexical.search(d, q, k, together=together).collect()) == plain(docs, items, k)
    assert lexical.search(d.limit(0), q).count() == 0 and lexical.search(d, q.limit(0)).count() == 0
    assert lexical.search(d, q).dtypes == [("item_id", "int"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]


def test_shards():
    """Many shards in turn, with many ties, against the sums of all postings."""
    rng = np.random.default_rng(1)
    for size in (1, 2, 3, 64, 500):
        best = (np.zeros(0, dtype=np.int64),) * 2
        scores = {}
        for shard in range(3):
            ids = np.sort(rng.choice(10_000, size, replace=False)) * 3 + shard
            keep = rng.random((size, 12)) < 0.4
            place, term = np.nonzero(keep)
            value = rng.integers(1, 6, len(place))
            tree = lexical.Shard(ids, place, term, value, 13)
            best = tree.top(np.array([0, 3, 4, 11, 12]), np.array([1, 2, 1, 5, 7]), 9, *best)
            for p, t, v in zip(place, term, value, strict=True):
                scores[ids[p]] = scores.get(ids[p], 0) + int(v) * {0: 1, 3: 2, 4: 1, 11: 5}.get(int(t), 0)
        want = sorted((-s, i) for i, s in scores.items() if s)[:9]
        assert list(zip(-best[0], best[1], strict=True)) == want


def test_terms():
    text = "Ab" * 10 + " é" + "Q" * (2 * PIECE) + "-" + "b" * (PIECE - 3) + " " + "c d " * PIECE + "É"
    assert counts(text.encode(), LETTERS_AND_DIGITS) == Counter(t.encode() for t in terms(text))
    assert counts(None, LETTERS_AND_DIGITS) == counts(b"", LETTERS_AND_DIGITS) == counts(b" -- ", LETTERS_AND_DIGITS) == Counter()


def test_oracle(spark, small):
    got, want = both(spark, "op11_lexical", small)
    assert got == want and len(got) > 100
