import re

import pytest

from lumenframe.llm import urls

from .oracle import both


@pytest.fixture(scope="module")
def model(spark):
    return urls.fit(urls.labelled(spark))


def plain(url, rules=urls.RULES):
    m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    host, path = ("".join(c.lower() if "A" <= c <= "Z" else c for c in m[1]), m[2]) if m else ("", "")
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: (len(r.text), [-ord(c) for c in r.text])) if fits else None
    return host, path, best and best.text, best and best.verdict


def test_rules(spark, model):
    given = [None, "", "://", "no scheme", "http://", "http://COM/", "http://com", "http://a.com/x?y#z", "http://acom/", "http://Example.com/en/", "http://www.example.com/en/1", "http://x.www.example.com/en/1", "http://example.com/en",
             "http://example.com/EN/", "ftp://b.net/es/q", "http://b.net/fr/", "http://b.net/de/", "http://b.net?x=/es/", "http://É.NET/fr/x", "a\nb://h.com/c\nd?e", "http://u@c.com:80/", "http://x.com/://y.net/es/", "http://b.net/es/" + "a" * 200_000, "http://b.net/es/"]
    df = spark.createDataFrame([(i, u, "h", 3) for i, u in enumerate(given)], "page_id int, url string, host string, score int").repartition(3)
    got = {r.page_id: r for r in urls.judge(df, model).collect()}
    assert len(got) == len(given)
    for i, u in enumerate(given):
        host, path, rule, verdict = plain(u)
        r = got[i]
        assert (r.host, r.path, r.rule) == (host, path, rule) and r.url == u
        assert r.verdict == verdict if rule else (r.verdict in ("allow", "block") and 0 <= r.score <= 1 and (r.score > 0.5) == (r.verdict == "block"))
    assert urls.judge(df.limit(0), model).count() == 0


def test_unseen(spark, model):
    """Of names that the labelled table does not have no clean one is blocked, and most others are (0.79 of all are right)."""
    bad, good = "royal-casinos adult-films spam-house cheap-pill-store sportsbets trackads loan-payday video-poker".split(), "mathematics grandmother station-north thorough nations bother thirteen fashions".split()
    assert not set(bad + good) & {*urls.BLOCKED, *urls.ALLOWED}
    df = spark.createDataFrame([(u, k) for k, names in ((0, good), (1, bad)) for u in urls.addresses(names)], "url string, blocked int")
    judged = urls.judge(df, model, rules=()).collect()
    assert sum((r.verdict == "block") == r.blocked for r in judged) >= 0.75 * len(judged) and not any(r.verdict == "block" for r in judged if not r.blocked)
    assert [r.verdict == "block" for r in urls.judge(urls.labelled(spark), model, rules=()).collect()].count(True) > 0


def test_features(spark):
    """Buckets against a plain count."""
    text = "Äx.net/" + "😀y"
    def grams(s, salt):
        for n in urls.GRAMS:
            for i in range(len(s) - n + 1):
                h = salt * 16 + n
                for c in s[i : i + n]:
                    h = (h * urls.FACTOR + ord(c)) % urls.MODULUS
                yield h % urls.BUCKETS
    df = spark.createDataFrame([(text, "/p"), ("", "")], "host string, path string")
    from pyspark.sql import functions as F
    got = [sorted(r[0]) for r in df.select(urls.buckets(F.col("host"), F.col("path"))).collect()]
    assert got == [sorted([*grams(f"^{h}$", 1), *grams(f"{p}$", 2)]) for h, p in ((text, "/p"), ("", ""))]


def test_fit(spark):
    one = spark.createDataFrame([("http://a.org/", 1), (None, 1), ("x", None)], "url string, blocked int")
    assert {r.verdict for r in urls.judge(one, urls.fit(one), rules=()).collect()} == {"block"}
    for rows in (one.limit(0), one.where("blocked is null")):
        with pytest.raises(ValueError):
            urls.fit(rows)
    with pytest.raises(ValueError):
        urls.fit(one, most=1)


def test_oracle(spark, small):
    got, want = both(spark, "op13_urls", small)
    assert got == want
