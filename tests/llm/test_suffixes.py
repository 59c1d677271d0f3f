import random

import numpy as np
import pytest

from lumenframe.llm import queries, suffixes


def brute(texts, length):
    """Covered bytes of each text, by a table of all strings."""
    count = {}
    for t in texts:
        for i in range(len(t) - length + 1):
            count[t[i : i + length]] = count.get(t[i : i + length], 0) + 1
    out = []
    for t in texts:
        mask = np.zeros(len(t), dtype=bool)
        for i in range(len(t) - length + 1):
            if count[t[i : i + length]] > 1:
                mask[i : i + length] = True
        edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(int), [0]])))
        out.append([(int(a), int(b)) for a, b in zip(edge[0::2], edge[1::2], strict=True)])
    return out


def corpus(seed, length, n=60):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choices("abcdeé", k=rnd.randint(1, 4)))
    shared = ["".join(word() + " " for _ in range(length // 2)) for _ in range(4)]
    texts = [None, "", "a", "a" * (length - 1), "a" * length, "a" * 5 * length, "ab" * 3 * length, "ab" * 2 * length + "c", "a" * (length + 1)]
    for _ in range(n):
        t = "".join(word() + " " for _ in range(rnd.randint(0, length)))
        for _ in range(rnd.randint(0, 2)):
            s = rnd.choice(shared)
            a = rnd.randint(0, len(s) // 2)
            i = rnd.randint(0, len(t))
            t = t[:i] + s[a : a + rnd.randint(length // 2, len(s))] + t[i:]
        texts.append(t)
    return texts + rnd.choices(texts, k=8)


def compare(spark, texts, **k):
    df = spark.createDataFrame([(i if i % 9 else None, t, i, b"x") for i, t in enumerate(texts)], "doc_id long, text string, start int, bytes binary").repartition(3)
    raw = [(t or "").encode() for t in texts]
    want = sorted(((i if i % 9 else -1), len(t), s, b"".join(t[a:b] for a, b in zip([0, *(x[1] for x in s)], [*(x[0] for x in s), len(t)], strict=True))) for i, (t, s) in enumerate(zip(raw, brute(raw, k["length"]), strict=True)))
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, [(x.a, x.b) for x in r.spans], bytes(r.kept)) for r in suffixes.dedup(df, **k).collect())
    assert got == want


@pytest.mark.parametrize(("seed", "length", "gram", "most", "tile"), [(1, 40, 8, 2048, 1 << 20), (2, 40, 8, 3, 1 << 20), (3, 50, 20, 1, 3000)])
def test_brute_force(spark, monkeypatch, seed, length, gram, most, tile):
    monkeypatch.setattr(suffixes, "MOST", most)
    monkeypatch.setattr(suffixes, "TILE", tile)
    compare(spark, corpus(seed, length), length=length, gram=gram)


def test_empty(spark):
    assert suffixes.dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_long_text(monkeypatch):
    monkeypatch.setattr(suffixes, "PIECE", 1000)
    rnd = np.random.default_rng(1)
    text = rnd.integers(97, 100, 5000).astype(np.uint8).tobytes()
    got = sorted(p - 0 + o + a for owner, buf, ok in suffixes._pieces([b"", text, b"zz"], 40) for at, n, _ in [suffixes.runs_of(buf, ok, 40, 8)] for (i, o, place) in owner for p, m in zip((at - place).tolist(), n.tolist(), strict=True) for a in range(m))
    assert got == list(range(len(text) - 39))


def test_repeated():
    rnd = np.random.default_rng(2)
    for symbols in (1, 2, 5, 200):
        text = rnd.integers(1, symbols + 1, 3000).astype(np.uint16)
        text[1000:1100] = text[200:300]
        text[[0, 700, 2999]] = 0
        for length in (3, 12, 60):
            seen = {}
            for i in range(1, len(text) - length + 1):
                w = text[i : i + length]
                if (w > 0).all():
                    seen.setdefault(w.tobytes(), []).append(i)
            want = sorted(i for x in seen.values() if len(x) > 1 for i in x)
            got = [i for i in suffixes.repeated(text, length).tolist() if i + length <= len(text) and (text[i : i + length] > 0).all()]
            assert got == want


def test_query(spark, small):
    import hashlib

    docs = sorted((r.doc_id, (r.text or "").encode()) for r in spark.read.parquet(f"{small}/documents.parquet").collect())
    found = brute([t for _, t in docs], 400)
    got = {r.doc_id: r for r in queries.op5_suffixes(spark, small).collect()}
    assert len(got) == len(docs)
    for (d, t), s in zip(docs, found, strict=True):
        kept = b"".join(t[a:b] for a, b in zip([0, *(x[1] for x in s)], [*(x[0] for x in s), len(t)], strict=True))
        assert (got[d].n_bytes, got[d].n_removed, got[d].n_spans, got[d].kept_sha256) == (len(t), sum(b - a for a, b in s), len(s), hashlib.sha256(kept).hexdigest())
