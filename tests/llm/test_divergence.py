import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from lumenframe.llm import divergence

from .oracle import both
from .test_lexical import SMALL


def plain(rows, least, ranks):
    groups, docs = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        found = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(SMALL))
        groups[lang or "", source or ""].update(found)
        docs[lang or ""].update(set(found))
    out = []
    for lang in {g[0] for g in groups}:
        kept = sorted(t for t, n in docs[lang].items() if n >= least)
        own = {s: c for (g, s), c in groups.items() if g == lang}
        own_p = {s: [1 + 10**9 * (c[t] + 5) // (sum(c[u] for u in kept) + 5 * len(kept)) for t in kept] for s, c in own.items()}
        whole = sum(own.values(), Counter())
        q = [1 + 10**9 * (whole[t] + 5) // (sum(whole[u] for u in kept) + 5 * len(kept)) for t in kept]
        for s, p in own_p.items():
            pairs = sorted((-sum(abs(a - b) for a, b in zip(p, o, strict=True)), x) for x, o in own_p.items() if x != s)
            terms = sorted((b - a, t) for t, a, b in zip(kept, p, q, strict=True) if own[s][t] and a > b)[:ranks]
            for part, found in (("pair", pairs), ("term", terms)):
                out += [(lang, s, part, item, -v, i) for i, (v, item) in enumerate(found, 1)]
    return sorted(out)


@pytest.mark.parametrize("sources,words,least", [(3, 40, 2), (70, 30, 2), (4, 5000, 1), (5, 20, 1000)])
def test_audit(spark, sources, words, least):
    """Also with more groups than a run has, more terms than a block has, and no kept term."""
    rng = np.random.default_rng(sources)
    names = np.array([f"{'ABé'[i % 3]}{'xyz'[i // 3 % 3]}{''.join(chr(97 + int(d)) for d in str(i))}" for i in range(words)])
    rows = [(" ".join(rng.choice(names, max(words // 50, 12))), f"l{i % 2}", f"s{i % sources}") for i in range(max(4 * sources, 200))]
    rows += [(" ".join(names), "l1", "all"), (None, "l0", "empty"), ("", "l0", "empty"), ("12 3", None, None), (None, None, "x"), ("same words", "l9", "a"), ("same words", "l9", "b"), ("same words", "l9", "b"), ("Ä" * 9 + " b " * 40000, "l0", None)]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "text string, lang string, source string, term int, n int").repartition(4)
    got = sorted(tuple(r) for r in divergence.audit(df, least_docs=least, ranks=7).collect())
    assert got == plain(rows, least, 7)
    assert divergence.audit(df.limit(0)).count() == 0


def test_frequencies():
    rng = np.random.default_rng(2)
    n = rng.integers(0, 8 * 10**15, 2000)
    total = n + 5 + rng.integers(0, 10**15, 2000)
    total[:1000] = total[:1000] // 10**9 + 1
    n[:1000] //= 10**10
    assert divergence.frequencies(n, total).tolist() == [1 + 10**9 * (int(a) + 5) // int(b) for a, b in zip(n, total, strict=True)]


def test_oracle(spark, small):
    got, want = both(spark, "op12_divergence", small)
    assert got == want and len(got) > 100
