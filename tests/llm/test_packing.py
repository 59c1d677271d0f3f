import zlib
from collections import defaultdict

import numpy as np
from tokenizers import Tokenizer

from lumenframe.llm import packing, queries


def verify(rows, texts):
    tok = Tokenizer.from_file(packing.tokenizer_path())
    ids = {d: np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], dtype="<u4") for d, t in texts.items()}
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    assert set(by_doc) == set(texts)
    for d, pieces in by_doc.items():
        at = 0
        for r in sorted(pieces, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids[d]) and r.length > 0
            assert r.ids_crc32 == zlib.crc32(ids[d][at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids[d])
    for pieces in by_seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == 4096 or (at < 4096 and at & (at - 1) == 0)
    return by_seq


def test_query(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").collect()
    verify(queries.op7_packing(spark, small).collect(), {r.doc_id: r.text for r in docs})


def test_edges(spark):
    texts = dict(enumerate([None, "", "a", "<|endoftext|> x", "a\x1cb !\x1c!", "İstanbul ΣΑΣ é é", "   \n", "it's we'll 123", "word " * 30000, "x" * 50000, "b " * 4095]))
    df = spark.createDataFrame([(d, t, 0) for d, t in texts.items()], "doc_id long, text string, start int").repartition(2)
    verify(packing.pack(df, buffer_tokens=9000).collect(), texts)
    assert packing.pack(df.limit(0)).count() == 0


def test_control_characters(spark):
    """Every character below U+0250 alone, in a word and beside others, and all control characters in one text."""
    controls = "".join(map(chr, [*range(0x09), *range(0x0E, 0x20), 0x7F]))
    texts = [t for c in map(chr, range(0x250)) for t in (c, f"a{c}b", f"{c}[0m x", f"A {c}' 1{c}{c}")] + [controls, " ".join(controls), "\x1b[1mBold\x1b[0m\x00\x00", "\x07", "x\x1bé\x7f"]
    words, tok = packing.WordCache(packing.tokenizer_path()), Tokenizer.from_file(packing.tokenizer_path())
    for t in texts * 2:  # the second time from the cache
        assert words.encode(t).tolist() == tok.encode(t, add_special_tokens=False).ids, repr(t)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    verify(packing.pack(df).collect(), dict(enumerate(texts)))


def test_balance():
    rnd = np.random.default_rng(1)
    lengths = [int(x) for x in rnd.integers(1, 3000, 2000)]
    full, left = packing.plan(lengths, 4096, 1.0, 1 / 2048)
    assert all(sum(n for _, _, n in s) == 4096 for s in full) and sum(n for _, _, n in left) < 4096
    cost = np.array([sum(packing.cost(n, 1.0, 1 / 2048) for _, _, n in s) for s in full])
    order = [(d, 0, n) for d, n in enumerate(lengths)]
    plain, seq, room = [], [], 4096
    for d, s, n in order:  # filled one after the other
        while n:
            k = min(n, room)
            seq.append(k)
            n, room = n - k, room - k
            if not room:
                plain.append(sum(packing.cost(x, 1.0, 1 / 2048) for x in seq))
                seq, room = [], 4096
    assert cost.std() < 0.7 * np.std(plain)
