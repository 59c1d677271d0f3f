import gzip
import hashlib
import io
import os

from lumenframe.llm import queries, warc
from lumenframe.llm.common import Scratch


def test_every_split(spark):
    """Records are found once whatever the splits, also with archives inside payloads."""
    inner = b"".join(warc.encode(warc.Record(100 + i, "in", os.urandom(300), "x", None, False)) for i in range(3))
    raw, starts = b"", []
    for i, payload in enumerate([b"", b"a" * 5000, inner, os.urandom(2000), inner + b"tail", warc.MAGIC * 50]):
        starts.append(len(raw))
        raw += warc.encode(warc.Record(i, "u", payload, hashlib.sha256(payload).hexdigest(), None, False))
    assert gzip.decompress(raw).count(b"WARC/1.1") >= 6
    # stored blocks: the inner members' bytes show in the archive as they are
    z = warc.zlib.compressobj(0, warc.zlib.DEFLATED, 31)
    starts.append(len(raw))
    raw += z.compress(gzip.decompress(warc.encode(warc.Record(6, "u", inner, "y", None, False)))) + z.flush()
    assert raw.count(inner[:50])
    for split in [17, 100, 333, 1000, 5000, len(raw)]:
        got = [(at, f["page_id"]) for s in range(0, len(raw), split) for at, f in warc.records_in(io.BytesIO(raw), len(raw), s, s + split)]
        assert got == list(zip(starts, range(7), strict=True)), split


def test_damage():
    """Records before and after a damaged or cut member are read, and all records of a member."""
    parts = [warc.encode(warc.Record(i, "u", os.urandom(400), "d", None, False)) for i in range(20)]
    ids = lambda raw: [f["page_id"] for _, f in warc.records_in(io.BytesIO(raw), len(raw), 0, len(raw))]
    hurt = parts[:10] + [parts[10][:200] + bytes(40) + parts[10][240:]] + parts[11:]
    assert ids(b"".join(hurt)) == [*range(10), *range(11, 20)]
    assert ids(b"".join(parts)[:-5]) == list(range(19)) and ids(b"junk" + b"".join(parts) + b"junk\x1f\x8b\x08") == list(range(20))
    two = gzip.compress(gzip.decompress(parts[0]) + gzip.decompress(parts[1]))
    assert ids(two + parts[2]) == [0, 1, 2]
    assert ids(parts[0] + b"junk" + b"".join(parts[1:])) == list(range(20))


def test_damage_at_every_distance():
    """A damaged record costs that record alone, wherever a range begins before it, and archives within records stay unread."""
    inner = b"".join(warc.encode(warc.Record(100 + i, "in", os.urandom(300), "x", None, False)) for i in range(3))
    stored = warc.zlib.compressobj(0, warc.zlib.DEFLATED, 31)
    z = stored.compress(gzip.decompress(warc.encode(warc.Record(7, "u", inner * 90, "y", None, False)))) + stored.flush()  # several blocks
    parts = [warc.encode(warc.Record(i, "u", os.urandom(900), "d", None, False)) if i != 7 else z for i in range(16)]
    starts = [sum(map(len, parts[:i])) for i in range(16)]
    raw = b"".join(parts)
    for bad in (3, 9, 15):
        hurt = bytearray(raw)
        hurt[starts[bad] + 300 : starts[bad] + 340] = bytes(40)
        for begin in [*range(0, starts[7], 97), *(starts[7] + x for x in range(0, len(z), 2311)), *range(starts[8], len(raw), 97)]:
            got = [f["page_id"] for _, f in warc.records_in(io.BytesIO(bytes(hurt)), len(hurt), begin, len(hurt))]
            assert got == [i for i in range(16) if starts[i] >= begin and i != bad], (bad, begin)
    hurt = raw[: starts[5]] + raw[starts[5] + 1 :]  # a byte less
    assert [f["page_id"] for _, f in warc.records_in(io.BytesIO(hurt), len(hurt), 1, len(hurt))] == [i for i in range(1, 16) if i != 5]


def test_round_trip(spark):
    same, rows = "é" * 60, [(5, "u5", "é" * 60), (2, "u2", "é" * 60), (9, None, "é" * 60), (1, "u", None), (3, "u", ""), (4, "a\r\nb", ""), (6, "u", "short"), (7, "u", "short"), (8, "u", "x" * 200000), (None, "u", "é" * 60), (2, "u2", "é" * 60)]
    df = spark.createDataFrame([(*r, "d", 7) for r in rows], "page_id long, url string, html string, digest string, revisit int").repartition(3)
    scratch = Scratch(spark, "t")
    files = scratch.save(warc.write(warc.deduplicated(df), f"{scratch.root}/a", archive_bytes=300), "files")
    got = sorted((r.page_id is None, r.page_id or 0, r.warc_type, r.refers_to, r.payload_bytes, r.payload_digest, r.payload and bytes(r.payload)) for r in warc.read(spark, files, scratch.root, split=64).collect())
    want = []
    for i, _, h in rows:
        p = (h or "").encode()
        again = h == same and i is not None and i > 2
        want.append((i is None, i or 0, "revisit" if again else "response", 2 if again else None, len(p), hashlib.sha256(p).hexdigest(), None if again else p and p))
    assert got == sorted(want)
    assert warc.read(spark, scratch.save(warc.write(warc.deduplicated(df.limit(0)), f"{scratch.root}/b"), "none"), scratch.root).count() == 0


def test_query(spark, small):
    pages = spark.read.parquet(f"{small}/pages.parquet").collect()
    got = {r.page_id: r for r in queries.op10_warc(spark, small).collect()}
    assert len(got) == len(pages)
    for r in pages:
        p = (r.html or "").encode()
        assert got[r.page_id].payload_bytes == len(p) and got[r.page_id].payload_digest == hashlib.sha256(p).hexdigest()
