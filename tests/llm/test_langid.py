import zlib
from collections import Counter

import numpy as np

from lumenframe.llm import langid, queries


def grams(text):
    out = Counter()
    for w in "".join(c if c.isalpha() else " " for c in text.lower()).split():
        out.update(w)
        p = f" {w} "
        out.update(p[i : i + 2] for i in range(len(p) - 1))
        out.update(p[i : i + 3] for i in range(len(p) - 2))
    return out


def code(g):
    n = 0
    for c in g:
        n = n << 21 | ord(c)
    return n


def ranked(c, most=300):
    return sorted(c, key=lambda g: (-c[g], code(g)))[:most]


def test_counts(monkeypatch):
    text = "Élan vital, à la carte; ÅNGSTRÖM 42 naïve—x  y😀z " * 3
    want = sorted((code(g), n) for g, n in grams(text).items())
    for piece in (1 << 18, 40, 7):
        monkeypatch.setattr(langid, "PIECE", piece)
        g, c = langid.counted(text)
        assert list(zip(g.tolist(), c.tolist(), strict=True)) == want
    assert langid.ranked(g, c, 20).tolist() == [code(x) for x in ranked(grams(text), 20)]


def test_brute_force(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").collect()
    held = {r.doc_id: zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in docs}
    sums = {}
    for r in docs:
        if not held[r.doc_id]:
            sums.setdefault(r.lang, Counter()).update(grams(r.text))
    profiles = {lang: {g: i for i, g in enumerate(ranked(c))} for lang, c in sorted(sums.items())}
    got = {r.doc_id: r for r in queries.op4_langid(spark, small).collect()}
    right = 0
    for r in docs:
        mine = ranked(grams(r.text))
        far = {lang: sum(abs(p[g] - i) if g in p else 300 for i, g in enumerate(mine)) for lang, p in profiles.items()}
        lang = min(far, key=far.get)
        assert (got[r.doc_id].lang_pred, got[r.doc_id].held_out) == (lang, held[r.doc_id])
        assert abs(got[r.doc_id].score - (1 - far[lang] / 300 / len(mine))) < 1e-12
        right += held[r.doc_id] and lang == r.lang
    assert right >= 0.95 * sum(held.values())


def test_edges(spark):
    rows = [(1, "the cat and the dog", "en", "a"), (2, "le chat et le chien", "fr", "b"), (3, None, "en", None), (4, "", "fr", None), (5, "12 !?", None, None), (None, "the dog", None, None), (1, "the cat and the dog", "en", "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, pred string")
    profiles = langid.fit(df, langid.F.lit(True))
    got = {(r.doc_id, r.text): (r.lang_pred, r.pred) for r in langid.predict(df, profiles).collect()}
    assert got[1, rows[0][1]] == ("en", "a") and got[2, rows[1][1]] == ("fr", "b") and got[None, "the dog"] == ("en", None)
    assert all(got[k][0] == "und" for k in [(3, None), (4, ""), (5, "12 !?")])
    assert langid.fit(df.limit(0), langid.F.lit(True)) == [] and langid.predict(df, []).where("lang_pred <> 'und'").count() == 0


def test_sample(spark):
    """A sample smaller than the labelled rows: those of the smallest hashed ids, whatever their groups."""
    rows = [(i, f"w{chr(97 + i % 23)}x {chr(97 + i % 19) * 2} {chr(97 + i % 7)}", "en" if i % 3 else "fr") for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    order = [r.doc_id for r in df.orderBy(langid.F.xxhash64("doc_id"), "doc_id").collect()]
    got = dict(langid.fit(df, langid.F.lit(True), sample=9, most=20))
    for lang in ("en", "fr"):
        own = [d for d in order if rows[d][2] == lang][:9]
        total = sum((grams(rows[d][1]) for d in own), Counter())
        assert got[lang] == [code(g) for g in ranked(total, 20)]
