"""Repeated byte strings: suffix-array dedup by interval expansion on a Burrows-Wheeler transform.

Strings of ``length`` bytes that occur again anywhere are found without ever holding the corpus in one place:

1. Every start of such a string belongs to the smallest hash of a GRAM-byte piece inside it (its anchor), so
   equal strings always have equal anchors. Consecutive starts of one anchor form a run; the run's slice is the
   text of all its strings. Equal slices are counted before anything is shuffled.
2. A slice that occurs twice is repeated as a whole. Anchors with several different slices become tiles.
3. A tile's slices form one text, whose Burrows-Wheeler transform is searched breadth first: intervals of
   strings grow to the left, and each end of an interval that is met for the first time at depth d has a common
   prefix of d symbols. The search stops at ``length``; ends not met by then have longer common prefixes, and
   the suffixes on both sides of them are repeated.
4. An anchor with more slices than a tile holds has its runs cut into shorter ones that lie alike before it;
   their anchor is all that their strings share. The last of these are single strings, which are only counted.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, id_join
from .shingles import _power_tables, mix

LENGTH = 400
GRAM = 32
#: Bytes of text anchored at once, and bytes of slices in one transform.
PIECE = 1 << 20
TILE = 1 << 19
#: Slices of an anchor beyond which its runs are cut into shorter ones, of so many starts.
MOST = 2048
STEPS = (16, 1)

_TABLE = np.random.default_rng(77).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def sliding_minimum(x: np.ndarray, w: int) -> np.ndarray:
    """The smallest of every w consecutive values."""
    n = len(x) - w + 1
    padded = np.full(-(-len(x) // w) * w, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[: len(x)] = x
    blocks = padded.reshape(-1, w)
    to_left = np.minimum.accumulate(blocks, axis=1).ravel()
    to_right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(to_right[:n], to_left[w - 1 : w - 1 + n])


def runs_of(buf: np.ndarray, last_start: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First start, number of starts and anchor of each run; ``last_start``: whether a string may start at a byte."""
    grams, w = _grams(buf, gram), length - gram + 1
    low = sliding_minimum(grams, w)
    ok = last_start[: len(low)]
    new = np.ones(len(low), dtype=bool)
    # a new value, or the same one at a later place: equal strings of one text are never in one run
    new[1:] = (low[1:] != low[:-1]) | (grams[: len(low) - 1] == low[:-1]) | ~ok[:-1]
    new &= ok
    first = np.flatnonzero(new)
    if not len(first):
        return first, first, low[:0]
    stop = np.flatnonzero(ok & ~np.append(ok[1:] & ~new[1:], False)) + 1
    many = -(-(stop - first) // w)  # long runs are cut
    at = np.repeat(first, many) + w * (np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many))
    return at, np.minimum(np.repeat(stop, many) - at, w), low[at]


def _pieces(texts: list[bytes], length: int) -> Iterator[tuple[list[tuple[int, int]], np.ndarray, np.ndarray]]:
    """Groups of texts (or stretches of long ones): (text, offset, place) of each, their bytes, where strings may start."""
    owner: list[tuple[int, int, int]] = []
    parts: list[bytes] = []
    size = 0

    def done():
        buf = np.frombuffer(b"".join(parts), dtype=np.uint8)
        ok = np.zeros(len(buf), dtype=bool)
        for (_, _, place), p in zip(owner, parts, strict=True):
            ok[place : place + len(p) - length + 1] = True
        return owner, buf, ok

    for i, text in enumerate(texts):
        for at in range(0, len(text) - length + 1, PIECE):
            part = text[at : at + PIECE + length - 1]
            if size and size + len(part) > PIECE:
                yield done()
                owner, parts, size = [], [], 0
            owner.append((i, at, size))
            parts.append(part)
            size += len(part)
    if parts:
        yield done()


def anchored(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """All runs: anchor, slice (digest), row (key), start, starts."""
    schema = "anchor long, slice binary, row binary, start long, starts int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in range(0, whole.num_rows, 512):
                batch = whole.slice(part, 512)
                rows, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                for owner, buf, ok in _pieces(texts, length):
                    at, n, anchor = runs_of(buf, ok, length, gram)
                    raw = buf.tobytes()
                    piece = np.searchsorted([p for _, _, p in owner], at, side="right") - 1
                    slices = [hashlib.blake2b(raw[a : a + m + length - 1], digest_size=16).digest() for a, m in zip(at.tolist(), n.tolist(), strict=True)]
                    start = at - np.array([p - o for _, o, p in owner])[piece]
                    keys = pa.array([rows[i] for i, _, _ in owner], pa.binary()).take(pa.array(piece))
                    yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(slices, pa.binary()), keys, pa.array(start, pa.int64()), pa.array(n.astype(np.int32))], names=["anchor", "slice", "row", "start", "starts"])

    return docs.select("row", "bytes").mapInArrow(run, schema)


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Positions by their first ``depth`` symbols (below 257) at least, by prefix doubling; only ties are sorted again."""
    n, h = len(text), 7
    padded = np.concatenate([text.astype(np.int64) + 1, np.zeros(h, dtype=np.int64)])
    key = np.zeros(n, dtype=np.int64)
    for i in range(h):
        key = key * 259 + padded[i : i + n]
    order = np.argsort(key).astype(np.int32)
    group = np.cumsum(np.concatenate([[0], key[order][1:] != key[order][:-1]]))
    # the rank of a group of equals is the place of its first member
    begin = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    heads = np.zeros(n, dtype=bool)
    heads[begin] = True
    rank = np.empty(n + 1, dtype=np.int32)
    rank[order], rank[n] = begin[group], -1
    while h < depth:
        edge = np.concatenate([np.diff(begin), [n - begin[-1]]]) if len(begin) else np.zeros(0, dtype=np.int64)
        open_ = np.repeat(edge > 1, edge)
        if not open_.any():
            break
        place = np.flatnonzero(open_)
        pos = order[place]
        key = rank[pos].astype(np.int64) * (n + 2) + rank[np.minimum(pos + h, n)] + 1
        by = np.argsort(key)
        order[place] = pos[by]
        key = key[by]
        fresh = place[np.concatenate([[True], key[1:] != key[:-1]])]
        heads[fresh] = True
        begin = np.flatnonzero(heads)
        where = np.searchsorted(fresh, place, side="right") - 1
        rank[order[place]] = fresh[where]
        h *= 2
    return order


def repeated(text: np.ndarray, length: int) -> np.ndarray:
    """Positions at which a string of ``length`` symbols starts that also starts elsewhere; symbol 0 separates."""
    n = len(text)
    sa = suffix_array(text, length)
    left = text[sa - 1]  # the transform; position 0 is a separator, and so is what comes before it
    lf = np.empty(n, dtype=np.int32)
    lf[np.argsort(left, kind="stable")] = np.arange(n, dtype=np.int32)
    left = left.astype(np.int64)
    run_at = np.flatnonzero(np.concatenate([[True], left[1:] != left[:-1]]))
    run_of = np.cumsum(np.concatenate([[0], left[1:] != left[:-1]]))
    run_end = np.append(run_at[1:], n)
    open_ = np.ones(n + 1, dtype=bool)
    open_[[0, n]] = False
    lo, hi = np.array([0]), np.array([n])
    for depth in range(length):
        if not len(lo):
            break
        r0, r1 = run_of[lo], run_of[hi - 1]
        same = r0 == r1
        a, b, c = [lf[lo[same]]], [lf[hi[same] - 1] + 1], [left[lo[same]]]
        if not same.all():
            l2, h2, r0, r1 = lo[~same], hi[~same], r0[~same], r1[~same]
            many = r1 - r0 + 1
            of = np.repeat(np.arange(len(many)), many)
            run = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + r0[of]
            first, last, sym = np.maximum(l2[of], run_at[run]), np.minimum(h2[of], run_end[run]), left[run_at[run]]
            by = np.argsort(of * 257 + sym, kind="stable")
            kind = (of * 257 + sym)[by]
            begin = np.flatnonzero(np.concatenate([[True], kind[1:] != kind[:-1]]))
            end = np.append(begin[1:], len(by)) - 1
            a.append(lf[first[by[begin]]])
            b.append(lf[last[by[end]] - 1] + 1)
            c.append(sym[by[begin]])
        lo, hi, sym = np.concatenate(a), np.concatenate(b), np.concatenate(c)
        if depth:  # strings that go on to the left of a separator are no strings of a slice
            lo, hi = lo[sym > 0], hi[sym > 0]
        else:  # the root's separators: all suffixes that start with one
            zero = sym == 0
            lo[zero], hi[zero] = 0, np.count_nonzero(text == 0)
        new = open_[hi]
        lo, hi = lo[new], hi[new]
        open_[hi] = False
    hit = open_[:n]
    return np.unique(np.concatenate([sa[hit], sa[np.flatnonzero(hit) - 1]]))


def _ranges(starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ascending numbers as half-open ranges."""
    cut = np.flatnonzero(np.concatenate([[True], np.diff(starts) > 1])) if len(starts) else np.zeros(0, dtype=np.int64)
    return starts[cut], starts[np.append(cut[1:], len(starts)) - 1] + 1 if len(starts) else starts


def _tile(held: list[pa.RecordBatch], length: int) -> pa.RecordBatch:
    """(anchor, slice, a, b) of the ranges of repeated starts within the slices of some anchors."""
    own = pa.Table.from_batches(held)
    texts, seen, keep = own.column(2).to_pylist(), set(), []
    for i, k in enumerate(zip(own.column(0).to_pylist(), own.column(1).to_pylist(), strict=True)):  # a repeated row's slice counts once
        if k not in seen:
            seen.add(k)
            keep.append(i)
    own, texts = own.take(pa.array(keep)), [texts[i] for i in keep]
    place = np.cumsum([1, *(len(t) + 1 for t in texts)])
    symbols = np.zeros(place[-1], dtype=np.uint16)
    for p, t in zip(place.tolist(), texts, strict=False):
        symbols[p : p + len(t)] = np.frombuffer(t, dtype=np.uint8).astype(np.uint16) + 1
    hits = repeated(symbols, length)
    slot = np.searchsorted(place, hits, side="right") - 1
    offset = hits - place[np.minimum(slot, len(texts) - 1)]
    fits = (slot >= 0) & (slot < len(texts)) & (offset <= np.array([len(t) for t in texts])[np.minimum(slot, len(texts) - 1)] - length)
    slot, offset = slot[fits], offset[fits]
    a, b = _ranges(slot * (1 << 40) + offset)
    who = pa.array(a >> 40)
    return pa.RecordBatch.from_arrays([x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in (own.column(0).take(who), own.column(1).take(who), pa.array(a & ((1 << 40) - 1)), pa.array((b - 1 & ((1 << 40) - 1)) + 1))], names=["anchor", "slice", "a", "b"])


def _search(length: int):
    """Rows come sorted by anchor; whole anchors are searched as soon as they fill a tile, so a task holds one tile."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, last = [], 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            anchor = batch.column(0).to_numpy()
            total = np.concatenate([[0], np.cumsum(pa.compute.binary_length(batch.column(2)).to_numpy() + 1)])
            cuts = (np.flatnonzero(anchor[1:] != anchor[:-1]) + 1).tolist()
            start = 0
            for at in cuts if anchor[0] == last or last is None else [0, *cuts]:
                if size + total[at] - total[start] >= TILE:
                    held += [batch.slice(start, at - start)] if at > start else []
                    yield _tile(held, length)
                    held, size, start = [], 0, at
            held.append(batch.slice(start))
            size, last = size + total[-1] - total[start], anchor[-1]
        if held:
            yield _tile(held, length)

    return run


def _grams(buf: np.ndarray, gram: int) -> np.ndarray:
    """The hash of every ``gram`` bytes."""
    power, inverse = _power_tables(max(len(buf) + 1, PIECE + 1))
    sums = np.zeros(len(buf) + 1, dtype=np.uint64)
    np.cumsum(_TABLE[buf] * power[: len(buf)], out=sums[1:])
    return mix((sums[gram:] - sums[:-gram]) * inverse[: len(buf) - gram + 1])


def _cells(text: bytes, anchor: int, length: int, step: int, gram: int) -> Iterator[tuple[int, int, bytes]]:
    """Runs of at most ``step`` starts that lie alike before the anchor's first place, and the bytes all such strings share."""
    starts = np.arange(len(text) - length + 1)
    if step == 1:
        yield from ((a, a + 1, text[a : a + length]) for a in starts.tolist())
        return
    at = np.flatnonzero(_grams(np.frombuffer(text, dtype=np.uint8), gram).view(np.int64) == anchor)
    place = at[np.searchsorted(at, starts)]
    cell = (place - starts) // step
    cut = np.flatnonzero(np.concatenate([[True], (cell[1:] != cell[:-1]) | (place[1:] != place[:-1])]))
    for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(starts)], strict=True):
        first = int(place[a] - cell[a] * step)
        yield a, b, text[first : first - step + 1 + length]


def _shorter(length: int, step: int, gram: int):
    """Runs of at most ``step`` starts: their anchor is the digest of what their strings share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[] for _ in range(7)]
            for anchor, piece, n, text in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                for a, b, core in _cells(text, anchor, length, step, gram):
                    part = text[a : b + length - 1]
                    key = int.from_bytes(hashlib.blake2b(core, digest_size=8).digest(), "little", signed=True)
                    for c, v in zip(cols, (anchor, piece, a, key, hashlib.blake2b(part, digest_size=16).digest(), n, part), strict=True):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.binary()), strict=True)], names=["anchor", "slice", "at", "anchor2", "slice2", "n", "text"])

    return run


def _resolve(slices: DataFrame, scratch: Scratch, length: int, gram: int, level: int = 0) -> DataFrame:
    """Ranges (anchor, slice, a, b) of repeated starts of different slices (anchor, slice, n, text, k of the anchor)."""
    schema = "anchor long, slice binary, a long, b long"
    found = slices.where(F.col("k") <= MOST).select("anchor", "slice", "text").repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_search(length), schema)
    found = scratch.save(found, f"found-{level}")
    hot = slices.where(F.col("k") > MOST)
    if level == len(STEPS) or hot.isEmpty():
        return found
    step = STEPS[level]
    sub = scratch.save(hot.select("anchor", "slice", "n", "text").mapInArrow(_shorter(length, step, gram), "anchor long, slice binary, at long, anchor2 long, slice2 binary, n long, text binary"), f"sub-{level}")
    each = sub.groupBy("anchor2", "slice2").agg(F.sum("n").alias("n"), F.any_value("text").alias("text"))
    each = scratch.save(each, f"each-{level}")
    count = each.groupBy("anchor2").agg(F.count("*").alias("k")).where("k > 1")
    parts = scratch.save(each.join(count, "anchor2").select(F.col("anchor2").alias("anchor"), F.col("slice2").alias("slice"), "n", "text", "k"), f"parts-{level}")
    inner = _resolve(parts, scratch, length, gram, level + 1).select(F.col("anchor").alias("anchor2"), F.col("slice").alias("slice2"), "a", "b")
    whole = each.where("n > 1").select("anchor2", "slice2", F.lit(0).cast("long").alias("a"), (F.octet_length("text") - length + 1).cast("long").alias("b"))
    up = sub.select("anchor", "slice", "at", "anchor2", "slice2").join(inner.union(whole), ["anchor2", "slice2"])
    return found.union(up.select("anchor", "slice", (F.col("at") + F.col("a")).alias("a"), (F.col("at") + F.col("b")).alias("b")))


def spans(docs: DataFrame, scratch: Scratch, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(row, a, b): ranges of bytes that repeated strings cover, unmerged; ``docs`` has row (key) and bytes."""
    runs = scratch.save(anchored(docs, length, gram), "runs")
    each = runs.groupBy("anchor", "slice").agg(F.count("*").alias("n"), F.min(F.struct("row", "start", "starts")).alias("at"))
    each = scratch.save(each, "each")
    count = each.groupBy("anchor").agg(F.sum("n").alias("total"), F.count("*").alias("k")).where("total > 1")
    each = scratch.save(each.join(count, "anchor").select("anchor", "slice", "n", "k", "at.*"), "candidates")
    scratch.drop("each")
    whole = runs.join(each.where("n > 1").select("anchor", "slice"), ["anchor", "slice"]).select("row", F.col("start").alias("a"), (F.col("start") + F.col("starts")).alias("b"))
    mixed = each.where("k > 1")
    need = scratch.save(mixed.groupBy("row").agg(F.collect_list(F.struct("anchor", "slice", "n", "k", "start", "starts")).alias("need")), "need")
    texts = id_join(docs, scratch.save(need.select("row"), "need-rows"), "row", "left_semi").join(need, "row")
    cut = texts.select("bytes", F.explode("need").alias("x")).select("x.*", F.substring("bytes", F.col("x.start").cast("int") + 1, F.col("x.starts") + (length - 1)).alias("text"))
    slices = scratch.save(cut.select("anchor", "slice", "n", "k", "text"), "slices")
    part = _resolve(slices, scratch, length, gram).join(mixed.where("n = 1").select("anchor", "slice", "row", "start"), ["anchor", "slice"])
    part = part.select("row", (F.col("start") + F.col("a")).alias("a"), (F.col("start") + F.col("b")).alias("b"))
    return whole.union(part).select("row", "a", (F.col("b") - 1 + length).alias("b"))


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[list] = [[] for _ in range(4)]
        for text, found in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            kept, at, n = [], 0, 0
            removed: list[list[int]] = []
            for x in sorted((x["a"], x["b"]) for x in found):
                if removed and x[0] <= removed[-1][1]:
                    removed[-1][1] = max(removed[-1][1], x[1])
                else:
                    removed.append(list(x))
            for a, b in removed:
                kept.append(text[at:a])
                at, n = b, n + b - a
            for c, v in zip(out, (b"".join([*kept, text[at:]]), n, len(removed), [{"a": a, "b": b} for a, b in removed]), strict=True):
                c.append(v)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(t) for t in batch.column(1).to_pylist()], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[3], pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))), pa.array(out[0], pa.binary())], names=["doc_id", "n_bytes", "n_removed", "spans", "kept"])


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """doc_id, n_bytes, n_removed, spans (array of byte ranges a, b), kept (the bytes that remain) of every row.

    Each byte goes that is covered by a string of ``length`` bytes which also starts anywhere else, in any
    document or in the same one, as the input stands. Null text counts as empty; texts shorter than ``length``
    stay whole; rows that repeat each other are copies, whatever their ids (null ones too); ids may repeat. Texts of
    any length are searched whole, other columns are not looked at, and an empty table gives an empty one.
    """
    scratch = Scratch(docs.sparkSession, "suffixes")
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    rows = docs.select(docs[id_col].alias("doc_id"), text.cast("binary").alias("bytes"))
    rows = rows.withColumn("row", F.unhex(F.md5(F.concat(F.encode(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), "UTF-8"), F.lit(b":"), "bytes"))))
    found = spans(rows, scratch, length, gram).groupBy("row").agg(F.collect_set(F.struct("a", "b")).alias("found"))
    found = scratch.save(found, "spans")
    ids = scratch.save(found.select("row"), "rows")
    touched = id_join(rows, ids, "row", "left_semi").join(found, "row").select("doc_id", "bytes", "found")
    kind = dict(rows.dtypes)["doc_id"]
    touched = touched.mapInArrow(_kept, f"doc_id {kind}, n_bytes long, n_removed long, spans array<struct<a:long,b:long>>, kept binary")
    clean = id_join(rows, ids, "row", "left_anti").select("doc_id", F.octet_length("bytes").cast("long"), F.lit(0).cast("long"), F.array().cast("array<struct<a:long,b:long>>"), "bytes")
    return touched.union(clean)
