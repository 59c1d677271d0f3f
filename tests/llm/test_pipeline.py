from collections import Counter

import corpus_pipeline
from lumenframe.llm import queries
from lumenframe.llm.common import Scratch

from . import test_jaccard, test_langid, test_packing, test_secrets


def test_stages(spark, small):
    """Every stage's decisions against plain versions, and run() against the stages one after the other."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    stages, scratch = dict(corpus_pipeline.STAGES), Scratch(spark, "t")

    def apply(name, df):
        out = scratch.save(stages[name](spark, df, small), name)
        return out, {r.doc_id: r for r in out.collect()} if name != "packed" else out.collect()

    sums = {}
    for r in rows.values():
        sums.setdefault(r.lang, Counter()).update(test_langid.grams(r.text))
    profiles = {lang: {g: i for i, g in enumerate(test_langid.ranked(c))} for lang, c in sorted(sums.items())}
    df, got = apply("language", docs)
    want = {}
    for d, r in rows.items():
        mine = test_langid.ranked(test_langid.grams(r.text or ""))
        far = {lang: sum(abs(p[g] - i) if g in p else 300 for i, g in enumerate(mine)) for lang, p in profiles.items()}
        lang = min(far, key=far.get)
        if mine and 1 - far[lang] / 300 / len(mine) >= corpus_pipeline.LEAST_SCORE:
            want[d] = lang
    assert {d: r.lang for d, r in got.items()} == want

    part = test_jaccard.brute({d: rows[d].text for d in want}, 5, 80, 100)
    df, got = apply("near_duplicates", df)
    assert set(got) == {d for d, (_, c) in part.items() if c == d} and len(got) < len(want)

    df, got = apply("no_secrets", df)
    for d, r in got.items():
        text, clean, at = rows[d].text, "", 0
        for s, _, e, _ in sorted(test_secrets.base(text) + test_secrets.entropy_spans(text)):
            if s >= at:
                clean += text[at:s] + "[SECRET]"
            at = max(at, e)
        assert r.text == clean + text[at:] and r.n_chars == len(r.text)

    before = got
    df, got = apply("mixture", df)
    assert set(got) < set(before) and all(got[d] == before[d] for d in got)
    assert set(got) == {r.doc_id for r in queries.mixed(spark.createDataFrame(list(before.values()), df.schema)).collect()}

    df, pieces = apply("packed", df)
    test_packing.verify(pieces, {d: r.text for d, r in got.items()})
    ran = corpus_pipeline.run(spark, small).collect()
    test_packing.verify(ran, {d: r.text for d, r in got.items()})


def test_odd_rows(spark, small):
    """Every stage with nulls in every column, empty and long texts, repeated rows, an empty table and clashing columns."""
    words = [r.text for r in spark.read.parquet(f"{small}/documents.parquet").where("lang = 'en'").orderBy("doc_id").limit(40).collect()]
    rows = [(i, t, ("en", "de", None)[i % 3], ("src0", "x", None)[i % 3], len(t)) for i, t in enumerate(words)]
    rows += [(None, words[0], "en", "src0", 3), (100, None, None, None, None), (101, "", "en", "src1", 0), (102, "12 34", None, "src0", 5), (103, words[1] * 300, "en", None, None), (0, words[0], "en", "src0", None), (0, words[0], "en", "src0", None)]
    docs = spark.createDataFrame([(*r, "x", 1, 0.5, "y") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, lang_pred string, component_id int, mix_weight double, ids string")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, small)
        kept[name] = out.collect()
        assert stage(spark, docs.limit(0), small).count() == 0
        assert name == "packed" or tuple(out.columns) == corpus_pipeline.COLUMNS
    ids = lambda name: Counter(r.doc_id for r in kept[name])
    assert not {100, 101, 102} & set(ids("language")) and {103, 5} < set(ids("language")) and ids("language")[0] == 3
    assert {100, 101, 102, None} < set(ids("near_duplicates")) and ids("near_duplicates")[0] == 3
    assert ids("no_secrets") == Counter(r[0] for r in rows) and {r.doc_id: r.text for r in kept["no_secrets"]}[100] is None
    assert set(ids("mixture")) <= {r[0] for r in rows}
    assert {r.doc_id for r in kept["packed"]} == {r[0] for r in rows}
    pieces = [r for r in kept["packed"] if r.doc_id == 100]
    assert len(pieces) == 1 and pieces[0].length == 1 == pieces[0].doc_tokens
