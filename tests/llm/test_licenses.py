import random

from lumenframe.llm import licenses, queries

KNOWN = licenses.templates()


def brute(text):
    w = licenses.words_of(text or "")
    s = [" ".join(w[i : i + 5]) for i in range(len(w) - 4)]
    return {(t.number, at, round(n / len(t.shingles), 9)) for t in KNOWN for at in range(0, len(s), t.step) if (n := len(set(s[at : at + t.window]) & set(t.shingles))) >= t.need}


def scan(spark, texts):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "id int, text string, s string")
    return {r.id: {(x.notice, x.at, round(x.contained, 9)) for x in r.licenses} for r in licenses.scan(df).collect()}


def test_settings():
    assert all(t.miss < 1e-4 for t in KNOWN)
    words = set(licenses.needed_words(KNOWN))
    for t in KNOWN:
        assert sum(not words & set(s.split()) for s in t.shingles) < t.need


def test_brute_force(spark):
    rnd = random.Random(1)
    filler = ["lorem", "ipsum", "license", "software", "the", "under", "x1", "é"]
    texts = [None, "", "license", "under the mit license", "LICENSED UNDER CC BY-NC 4.0.", "é released\nunder the MIT License, yes", "MIT License the under released"]
    for _ in range(120):
        parts = []
        for _ in range(rnd.randint(1, 3)):
            w = rnd.choice(licenses.NOTICES)[1].split()
            for _ in range(rnd.choice([0, 0, 1, 2])):
                w[rnd.randrange(len(w))] = rnd.choice(filler)
            parts += rnd.choices(filler, k=rnd.randint(0, 60)) + w
        texts.append(" ".join(parts))
    got = scan(spark, texts)
    want = {i: brute(t) for i, t in enumerate(texts)}
    assert all(got[i] <= want[i] for i in want)
    assert sum(map(len, got.values())) >= 0.999 * sum(map(len, want.values())) > 100
    assert licenses.scan(spark.createDataFrame([], "text string")).count() == 0


def test_query(spark, small):
    names = {t.number: t.name for t in KNOWN}
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    rows = queries.op9_licenses(spark, small).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert r.licenses == ",".join(sorted({names[n] for n, _, _ in brute(texts[r.doc_id])}))


def test_odd_rows(spark):
    """A column of the result's name, repeated rows, and a very long text."""
    notice = licenses.NOTICES[0][1]
    rows = [(1, notice, "mine", 5), (1, notice, "mine", 5), (2, "lorem ipsum dolor " * 4000 + notice + " sit amet" * 3000, None, None), (3, None, "x", 1)]
    out = licenses.scan(spark.createDataFrame(rows, "id int, text string, licenses string, notice int")).collect()
    assert sorted(out[0].asDict()) == ["id", "licenses", "notice", "text"] and len(out) == 4
    found = [(r.id, {(x.notice, x.at, round(x.contained, 9)) for x in r.licenses}) for r in out]
    assert sorted(i for i, _ in found) == [1, 1, 2, 3] and all(f == brute(next(t for i, t, *_ in rows if i == k)) for k, f in found)
    assert all(f for k, f in found if k != 3)
