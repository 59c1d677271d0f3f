"""WARC archives: a writer of per-record gzip members, and a splittable reader over byte ranges."""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAGIC = b"\x1f\x8b\x08"
#: Records of equal payloads of at least so many bytes are stored once.
MIN_REVISIT = 100
#: Bytes of an archive that a task scans.
SPLIT = 32 << 20
READ = 1 << 16
#: Bytes before a candidate in which a stored block of deflate that holds it would begin: such a block has at most
#: 65,535 bytes, after 4 bytes of its length. Only in stored blocks do bytes of an archive show within a record.
BACK = 65_539
WINDOW = bytes(32768)
#: Tasks that read, at most.
TASKS = 100_000
#: An archive is closed beyond so many bytes, and the next one begun.
ARCHIVE = 256 << 20

FILES = "path string, bytes long, records long"
RECORDS = "path string, position long, warc_type string, record_id string, target_uri string, page_id long, refers_to long, payload_digest string, payload_bytes long, payload binary"


class Record(NamedTuple):
    page_id: int | None
    url: str | None
    payload: bytes
    digest: str
    refers_to: int | None
    revisit: bool


def urn(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def encode(r: Record) -> bytes:
    """One gzip member: WARC headers, then an HTTP message; that of a revisit has no body."""
    payload = r.payload or b""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if r.revisit else http + payload
    url = (r.url or "").replace("\r", "%0D").replace("\n", "%0A")
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if r.revisit else 'response'}", f"WARC-Record-ID: {urn(r.page_id)}", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Target-URI: {url}", f"WARC-Payload-Digest: sha256:{r.digest or str()}"]
    if r.revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {urn(r.refers_to)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(head).encode() + block + b"\r\n\r\n") + z.flush()


def page_of(value: str | None) -> int | None:
    digits = (value or "").removeprefix("<urn:page:").removesuffix(">")
    return int(digits) if digits.removeprefix("-").isdigit() else None


def decode(raw: bytes) -> tuple[dict, bytes] | None:
    """The fields of the record that these bytes begin with, and what follows it; None if there is none."""
    head, sep, rest = raw.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not sep or not lines[0].startswith(b"WARC/"):
        return None
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.decode("utf-8", "replace").partition(":") for x in lines[1:])}
    if not fields.get("content-length", "").isdigit():
        return None
    size, kind = int(fields["content-length"]), fields.get("warc-type")
    block = rest[:size]
    if "application/http" in fields.get("content-type", ""):
        http, _, payload = block.partition(b"\r\n\r\n")
        length = next((int(v) for k, _, v in (x.partition(b":") for x in http.split(b"\r\n")) if k.strip().lower() == b"content-length" and v.strip().isdigit()), len(payload))
    else:
        payload, length = block, len(block)
    digest = fields.get("warc-payload-digest", "")
    digest = digest.partition(":")[2] or digest or None
    if kind != "revisit":  # what is there counts, not what the headers say
        digest, length = hashlib.sha256(payload).hexdigest(), len(payload)
    return {
        "warc_type": kind, "record_id": fields.get("warc-record-id"), "target_uri": fields.get("warc-target-uri"), "page_id": page_of(fields.get("warc-record-id")), "refers_to": page_of(fields.get("warc-refers-to")),
        "payload_digest": digest, "payload_bytes": length, "payload": None if kind == "revisit" else payload,
    }, rest[size:].lstrip(b"\r\n")


def decoded(raw: bytes) -> Iterator[dict]:
    """The fields of all records of a member."""
    while raw and (found := decode(raw)):
        yield found[0]
        raw = found[1]


class Range:
    """Bytes of an archive from a position on, read as they are asked for; what lies before the position is let go."""

    def __init__(self, file, size: int, start: int) -> None:
        self.file, self.size, self.at, self.held = file, size, start, bytearray()

    def bytes_from(self, position: int, count: int) -> bytes:
        while self.at + len(self.held) < min(self.size, position + count):
            want = min(max(READ, position + count - self.at - len(self.held)), self.size - self.at - len(self.held))
            self.file.seek(self.at + len(self.held))
            more = self.file.read(want)
            if not more:
                break
            self.held += more
        return bytes(self.held[position - self.at : position - self.at + count])

    def let_go(self, position: int) -> None:
        position -= BACK
        if position > self.at + (READ << 2):
            del self.held[: position - self.at]
            self.at = position


def member(data: Range, position: int) -> tuple[bytes, int] | None:
    """The content and the end of the gzip member at a position; None if there is none, or none of a WARC record."""
    z, out, at = zlib.decompressobj(31), [], position
    try:
        while not z.eof:
            if not (raw := data.bytes_from(at, READ)):
                return None
            out.append(z.decompress(raw))
            at += len(raw)
            if len(out) == 1 and not b"WARC/".startswith(out[0][:5]):
                return None
    except zlib.error:
        return None
    return b"".join(out), at - len(z.unused_data)


def enclosing(data: Range, start: int, end: int) -> int | None:
    """The end of the gzip member in one of whose stored blocks the bytes from start to end lie; None if there is none.

    A block's header is its length and the complement of it. Where one before ``start`` reaches as far as ``end``, what
    follows the block has to inflate (whatever came before it) to the end of a member, and there another begins, or the file ends.
    """
    low = max(data.at, start - BACK)
    raw = np.frombuffer(data.bytes_from(low, start - low), dtype=np.uint8).astype(np.int64)
    if len(raw) < 4:
        return None
    length, complement = raw[:-3] + 256 * raw[1:-2], raw[2:-1] + 256 * raw[3:]
    k = np.arange(len(length))
    for at in (np.flatnonzero((length ^ complement == 0xFFFF) & (low + k + 4 + length >= end)) + low).tolist():
        for last in (b"\1", b"\0"):
            z, to = zlib.decompressobj(-15, zdict=WINDOW), at
            try:
                z.decompress(last)
                while not z.eof and (more := data.bytes_from(to, READ)):
                    z.decompress(more)
                    to += len(more)
            except zlib.error:
                continue
            close = to - len(z.unused_data) + 8  # after the checksum and the size
            if z.eof and (close == data.size or data.bytes_from(close, 3) == MAGIC):
                return close
    return None


def first_member(data: Range, start: int, end: int) -> int | None:
    """Where the first record that starts in [start, end) begins.

    A candidate is gzip magic whose member decodes, checksum and all, to a WARC header. It counts unless it lies within
    another record; then the search goes on behind that one. Damage after it does not matter.
    """
    at = start
    while at < end:
        raw = data.bytes_from(at, READ)
        i = raw.find(MAGIC)
        if i < 0:
            if len(raw) < READ:
                return None
            at += len(raw) - 2
            data.let_go(at)
            continue
        at += i
        if at >= end:
            return None
        found = member(data, at)
        if found and decode(found[0]):
            outer = enclosing(data, at, found[1])
            if outer is None:
                return at
            at = outer
        else:
            at += 1
    return None


def records_in(file, size: int, start: int, end: int) -> Iterator[tuple[int, dict]]:
    """Position and fields of the records of members that start in [start, end), past any damage.

    The first byte of an archive, and the end of a record, are where the next one begins. If none does, and where a
    range starts, the next one is searched for.
    """
    data, at, known = Range(file, size, max(0, start - BACK)), start, start == 0
    while at is not None and at < min(end, size):
        found = member(data, at) if known else None
        if found and decode(found[0]):
            yield from ((at, fields) for fields in decoded(found[0]))
            at = found[1]
        else:
            at, known = first_member(data, at + known, end), True
        if at is not None:
            data.let_go(at)


def write(pages: DataFrame, directory: str, archive_bytes: int = ARCHIVE) -> DataFrame:
    """Write rows (page_id, url, payload binary, digest, refers_to, revisit) as archives in ``directory``, a URI that
    all executors share; returns (path, bytes, records) of each archive. A null page_id makes a record without one in its
    name, a null url an empty address, a null payload an empty one, a null digest none.

    Each task writes archives of its own under a fresh name, so that a repeated task never touches those of
    another attempt; save the result, which lists the archives that count.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(directory)
        store.create_dir(root, recursive=True)
        out, path, size, n = None, "", 0, 0

        def done() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([size], pa.int64()), pa.array([n], pa.int64())], names=["path", "bytes", "records"])

        for batch in batches:
            for i in range(batch.num_rows):
                if out is None:
                    path, size, n = f"{root}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = store.open_output_stream(path, compression=None)
                raw = encode(Record(*(c[i].as_py() for c in batch.columns)))
                out.write(raw)
                size, n = size + len(raw), n + 1
                if size >= archive_bytes:
                    yield done()
                    out = None
        if out is not None:
            yield done()

    return pages.select("page_id", "url", "payload", "digest", "refers_to", "revisit").mapInArrow(run, FILES)


def read(spark: SparkSession, files: DataFrame, directory: str, split: int = SPLIT, with_payload: bool = True) -> DataFrame:
    """The records of archives (path, bytes), scanned by byte ranges of ``split`` bytes, each owned by one task.

    ``payload`` is null for revisits (and for all if not ``with_payload``); ``payload_bytes`` and
    ``payload_digest`` are those of the payload as it was read, for revisits those that it refers to. Bytes that
    are no records are passed over, and so are damaged members, each alone. Members may hold several records. Equal records are all returned;
    an archive listed twice is read twice. Payloads of any size are read whole; no archives give no rows, and
    columns of ``files`` beyond path and bytes are not looked at.
    """
    names = [x.split()[0] for x in RECORDS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(directory)
        kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.binary()]

        def batch_of(rows: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], t) for n, t in zip(names, kinds, strict=True)], names=names)

        for batch in batches:
            for path, size, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with store.open_input_file(path) as file:
                    rows, held = [], 0
                    for at, fields in records_in(file, size, start, start + split):
                        rows.append(fields | {"path": path, "position": at} | ({} if with_payload else {"payload": None}))
                        held += len(rows[-1]["payload"] or b"")
                        if len(rows) == 2000 or held > 8 << 20:
                            yield batch_of(rows)
                            rows, held = [], 0
                    if rows:
                        yield batch_of(rows)

    ranges = files.where("bytes > 0").select("path", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(split).cast("long"))).alias("start"))
    many = files.where("bytes > 0").agg(F.sum(F.ceil(F.col("bytes") / split))).first()[0] or 1
    return ranges.repartition(min(int(many), TASKS)).mapInArrow(run, RECORDS)


def deduplicated(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = MIN_REVISIT) -> DataFrame:
    """Rows for ``write``: of equal payloads of at least ``least`` bytes the smallest id is a response, others revisit it.

    Null html counts as empty; html of any length is taken whole. Rows with a null id, and rows that repeat the
    response's id, are responses too; other repeated rows are revisits each. Other columns are not looked at.
    Equal payloads meet only as partial minima of their digests; the pages are then joined with the revisits
    alone, so the size of a group of copies does not matter.
    """
    payload = F.coalesce(pages[html_col].cast("string"), F.lit("")).cast("binary")
    rows = pages.select(pages[id_col].cast("long").alias("page_id"), pages[url_col].cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    brief = rows.where(F.octet_length("payload") >= least).select("page_id", "digest")
    first = brief.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1")
    again = brief.join(first, "digest").where("page_id > refers_to").select("page_id", "digest", "refers_to").distinct()
    return rows.join(again, ["page_id", "digest"], "left").withColumn("revisit", F.col("refers_to").isNotNull())
