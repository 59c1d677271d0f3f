"""N-gram Jaccard join: rare keys, size-banded tiles, hashed bitmap bounds, then exact intersections.

Two sets link when ``den * |x & y| >= num * |x | y|``. The join is exact for sets of 64-bit shingle hashes:

1. Documents become sets; documents of equal sets form a class, and only its smallest id goes on.
2. A set of s elements that links has at least ceil(s * num / den) in common with its partner, so the partner
   has one of any s - ceil(s * num / den) + 1 of them. A set gives its s - ceil(s * num / den) + l smallest
   hashes as keys: linked sets then share at least l of them, and each may drop its l - 1 commonest keys (see
   ``shares``). Passages that many documents share are common, so their shingles are what is dropped.
3. Documents that keep the same key, in one size band or the next, form a tile; tiles of the same members are
   one. Documents that tiles connect form a cluster. Clusters of a bounded size are compared as a whole, so
   that each set moves once; larger ones as a whole or tile by tile, whichever has fewer pairs, and what is
   beyond that bound block by block.
4. A comparison bounds overlaps from above by bit counts of hashed bitmaps and intersects the sorted hash
   arrays of the pairs that pass. It returns which labels become one, never pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.graph import components
from .common import Scratch, id_join
from .shingles import sets_of

#: Sets, and elements of theirs, that are compared at once.
MEMBERS, HASHES = 4096, 1 << 20
#: A tenth of a set's elements are keys beyond those it needs, for which it may drop as many common ones.
MORE = 10
#: A key is heavy if more than one in so many keys is this one (and so many at least): there are at most so many of them.
HEAVY, HEAVY_LEAST = 1 << 18, 1024
#: Keys counted at once in search of heavy ones.
COUNTED = 1 << 20
WIDEST = 1 << 17
LIMIT = (1 << 24) - 1


@lru_cache
def edges(num: int, den: int, limit: int = 1 << 40) -> tuple[int, ...]:
    """Lower ends of the size bands: linked sets lie in one band or in two neighbouring ones."""
    out = [1]
    while out[-1] < limit:
        out.append(max(out[-1] + 1, out[-1] * 9 // 8, -(-out[-1] * den // num)))
    return tuple(out)


def shares(sizes: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """The number of keys of sets of these sizes, and how many of their commonest ones they may drop.

    A set of s elements, of which c = ceil(s * num / den) at least are shared by a link, gives s - c + l(s) keys,
    its smallest hashes. What is shared and no key of both is no key of the one whose keys end first: at most
    c - l elements, so l(s) keys at least are shared, of the smaller l of two sets. Of these, the rarest one is
    preceded in either set by l - 1 commoner ones; the smallest partner has c elements.
    """
    least = -(-sizes * num // den)
    extra = lambda s: np.minimum(1 + s // MORE, -(-s * num // den))
    return sizes - least + extra(sizes), extra(least) - 1


def enough(overlap, total, num: int, den: int):
    """Whether an overlap (or its bound) of sets with ``total`` elements in all makes a link."""
    return overlap * (num + den) >= num * total


def bitmaps(sets: list[np.ndarray], width: int) -> np.ndarray:
    """A row of words for each set: a bit for each hash, by its lowest digits."""
    bits = np.zeros((len(sets), width), dtype=bool)
    rows = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    bits[rows, (np.concatenate(sets) & np.uint64(width - 1)).astype(np.int64)] = True
    return np.packbits(bits, axis=1, bitorder="little").view(np.uint64)


def connect(labels: np.ndarray, sets: list[np.ndarray], up: np.ndarray, side: np.ndarray, cross: bool, num: int, den: int) -> list[tuple[int, int]]:
    """Which labels links make one, as pairs (label, smallest label).

    Sets that are both ``up`` are not compared (they meet in their own band), and only those of different sides
    if ``cross``; sets of one label need no comparison.
    """
    names, label = np.unique(labels, return_inverse=True)
    size = np.array([len(s) for s in sets])
    order = np.argsort(size, kind="stable")
    size, label, up, side = size[order], label[order], up[order], side[order]
    sets = [sets[i] for i in order.tolist()]
    merged = np.arange(len(names))
    flat, first = np.concatenate(sets), np.concatenate([[0], np.cumsum(size)])
    reach = np.searchsorted(size, size * den // num, side="right")
    width = np.array([min(WIDEST, max(64, 8 << int(s - 1).bit_length())) for s in size.tolist()])
    bounds = np.flatnonzero(np.concatenate([[True], width[1:] != width[:-1], [True]]))
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        rows = bitmaps(sets[a : int(reach[b - 1])], int(width[a]))
        held = np.bitwise_count(rows).sum(axis=1, dtype=np.int64)
        at = a
        while at < b:
            to = min(b, at + max(1, (1 << 19) // ((int(reach[at]) - at) * rows.shape[1] + 1)))
            end = int(reach[to - 1])
            x, y = slice(at - a, to - a), slice(at - a, end - a)
            common = np.bitwise_count(rows[x, None] & rows[None, y]).sum(axis=2, dtype=np.int64)
            bound = np.minimum(size[at:to, None] - held[x, None] + common, size[None, at:end] - held[None, y] + common)
            passing = enough(bound, size[at:to, None] + size[None, at:end], num, den)
            passing &= (np.arange(at, end)[None] > np.arange(at, to)[:, None]) & ~(up[at:to, None] & up[None, at:end])
            if cross:
                passing &= side[at:to, None] != side[None, at:end]
            for i in np.flatnonzero(passing.any(axis=1)).tolist():
                own = label[at + i]
                near = at + np.flatnonzero(passing[i])
                near = near[merged[label[near]] != merged[own]]
                if not len(near):
                    continue
                n = size[near]
                starts = np.cumsum(n) - n
                theirs = flat[np.repeat(first[near] - starts, n) + np.arange(n.sum())]
                mine = sets[at + i]
                found = mine[np.minimum(np.searchsorted(mine, theirs), len(mine) - 1)] == theirs
                shared = np.add.reduceat(found, starts, dtype=np.int64)
                linked = near[enough(shared, n + len(mine), num, den)]
                if len(linked):
                    groups = np.unique(merged[np.append(label[linked], own)])
                    merged[np.isin(merged, groups)] = groups[0]
            at = to
    moved = np.flatnonzero(merged != np.arange(len(names)))
    return list(zip(names[moved].tolist(), names[merged[moved]].tolist(), strict=True))


def _texts(batch: pa.RecordBatch, i: int) -> list[bytes | None]:
    return batch.column(i).cast(pa.binary()).to_pylist()


def _digest(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def _part(digest: bytes) -> int:
    """Tells apart different texts of one id."""
    return int.from_bytes(digest[:3], "little") >> 1


def _sets(docs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """doc_id, n (size of its set), part, print (digest of the set) and keys (its smallest hashes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                sets = list(sets_of(_texts(batch, 1), n))
                sizes = np.array([len(s) for s in sets])
                prints = [_digest(s) for s in sets]
                given = shares(sizes, num, den)[0].tolist()
                yield pa.RecordBatch.from_arrays([
                    batch.column(0), pa.array(sizes, pa.int64()), pa.array([_part(p) for p in prints], pa.int32()), pa.array(prints, pa.binary()), pa.array([s[:k].tobytes() for s, k in zip(sets, given, strict=True)], pa.binary()),
                ], names=["doc_id", "n", "part", "print", "keys"])

    return docs.mapInArrow(run, "doc_id long, n long, part int, print binary, keys binary")


def _hashes(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, part, n and hashes (the whole set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                sets = list(sets_of(_texts(batch, 1), n))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([_part(_digest(s)) for s in sets], pa.int32()), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["doc_id", "part", "n", "hashes"])

    return docs.mapInArrow(run, "doc_id long, part int, n long, hashes binary").where("n > 0")


def _heavy(firsts: DataFrame, most: int, least: int) -> np.ndarray:
    """The heavy keys, commonest first: at most ``most``, whatever the number of documents.

    A key that makes up one in ``most`` of all keys does so in some task's chunk; keys are added up over the
    chunks that hold them twice. (What is missed has but one row in a chunk.)
    """
    total = (firsts.agg(F.sum(F.octet_length("keys").cast("long"))).first()[0] or 0) // 8
    floor = max(least, -(-total // most))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def counted() -> pa.RecordBatch:
            keys, n = np.unique(np.frombuffer(b"".join(held), dtype=np.int64), return_counts=True)
            keep = n >= max(2, size * floor // max(1, total))
            return pa.RecordBatch.from_arrays([pa.array(keys[keep]), pa.array(n[keep])], names=["key", "n"])

        held: list[bytes] = []
        size = 0
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                held.append(raw)
                size += len(raw) // 8
                if size >= COUNTED:
                    yield counted()
                    held, size = [], 0
        if held:
            yield counted()

    found = firsts.select("keys").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= floor)
    rows = sorted(((r.n, r.key) for r in found.collect()), reverse=True)
    return np.array([k for _, k in rows], dtype=np.int64).view(np.uint64)


def _rows(firsts: DataFrame, heavy: np.ndarray, of_heavy: bool, num: int, den: int) -> DataFrame:
    """Rows (key, doc_id, meta) of the keys that are not heavy, or of the heavy ones that cannot be dropped.

    ``meta`` holds what may still be dropped (24 bits), twice the size band and whether linked sets may lie in the
    next one (16 bits), and the part (23 bits).
    """
    by_key = np.argsort(heavy)
    known = heavy[by_key]
    low = np.array(edges(num, den))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                batch = whole.slice(at, 2048)
                doc, size, part = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
                raw = batch.column(3).to_pylist()
                flat = np.frombuffer(b"".join(raw), dtype=np.uint64)
                owner = np.repeat(np.arange(len(raw)), [len(x) // 8 for x in raw])
                drop = np.minimum(shares(size, num, den)[1], LIMIT)
                hot = np.zeros(len(flat), dtype=bool)
                if len(known):
                    place = np.minimum(np.searchsorted(known, flat), len(known) - 1)
                    hot = known[place] == flat
                pick, left = np.flatnonzero(~hot), drop
                if hot.any():
                    at_hot = np.flatnonzero(hot)
                    at_hot = at_hot[np.lexsort((by_key[place[at_hot]], owner[at_hot]))]
                    own = owner[at_hot]
                    nth = np.arange(len(own)) - np.searchsorted(own, own)
                    left = np.maximum(drop - np.bincount(own, minlength=len(raw)), 0)
                    if of_heavy:
                        pick = at_hot[nth >= drop[own]]
                elif of_heavy:
                    continue
                band = np.searchsorted(low, size, side="right") - 1
                level = band * 2 + (low[band + 1] * num <= size * den)
                meta = left.astype(np.int64) | (level << 24) | (part.astype(np.int64) << 40)
                for i in range(0, len(pick), 1 << 18):
                    p = pick[i : i + (1 << 18)]
                    yield pa.RecordBatch.from_arrays([pa.array(flat[p].view(np.int64)), pa.array(doc[owner[p]]), pa.array(meta[owner[p]])], names=["key", "doc_id", "meta"])

    return firsts.select("doc_id", "n", "part", "keys").mapInArrow(run, "key long, doc_id long, meta long")


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by key, those of keys with several rows, and these keys' numbers of rows."""

    def several(cols: list[np.ndarray]) -> pa.RecordBatch:
        first = np.flatnonzero(np.concatenate([[True], cols[0][1:] != cols[0][:-1]])) if len(cols[0]) else np.zeros(0, dtype=np.int64)
        many = np.diff(np.append(first, len(cols[0])))
        times = np.repeat(many, many)
        return pa.RecordBatch.from_arrays([*(pa.array(c[times > 1]) for c in cols), pa.array(times[times > 1])], names=["key", "doc_id", "meta", "times"])

    held: list[np.ndarray] | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        cols = cols if held is None else [np.concatenate(x) for x in zip(held, cols, strict=True)]
        cut = int(np.searchsorted(cols[0], cols[0][-1]))
        if cut:
            yield several([c[:cut] for c in cols])
        held = [c[cut:] for c in cols]
    if held is not None:
        yield several(held)


def _grouped(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """The groups of rows sorted by their first ``keys`` columns, one by one."""
    held: list[pa.RecordBatch] = []
    last: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(keys)]
        new = np.zeros(batch.num_rows, dtype=bool)
        for c in cols:
            new[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(new).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            key = tuple(c[a] for c in cols)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def _compared(rows: DataFrame, keys: list[str], cross: bool, num: int, den: int) -> DataFrame:
    """Labels (a, b) that become one in the groups of ``rows`` (keys, up, side, label, hashes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int]] = []
        for group in _grouped(batches, len(keys)):
            up, side, label = (group.column(len(keys) + i).to_numpy() for i in range(3))
            if len(label) > 1 and (label != label[0]).any():
                sets = [np.frombuffer(x, dtype=np.uint64) for x in group.column(len(keys) + 3).to_pylist()]
                out += connect(label, sets, up, side, cross, num, den)
            if len(out) >= 1 << 16:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], names=["a", "b"])
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], names=["a", "b"])

    rows = rows.select(*keys, "up", "side", "label", "hashes").repartition(*keys).sortWithinPartitions(*keys)
    return rows.mapInArrow(run, "a long, b long")


def _tiles(firsts: DataFrame, scratch: Scratch, num: int, den: int, heavy_most: int, heavy_least: int) -> tuple[DataFrame, DataFrame]:
    """The tiles of several documents (tile, rep, m: smallest member, members), those of equal members once, and their members: tile, doc_id, part, up, rep."""
    heavy = _heavy(firsts, heavy_most, heavy_least)
    light = _rows(firsts, heavy, False, num, den).repartition("key").sortWithinPartitions("key").mapInArrow(_counted, "key long, doc_id long, meta long, times long")
    of_one = Window.partitionBy("doc_id", F.shiftright("meta", 40)).orderBy(F.desc("times"), "key")
    kept = light.withColumn("nth", F.row_number().over(of_one)).where(F.col("nth") > F.col("meta").bitwiseAND(F.lit(LIMIT))).select("key", "doc_id", "meta")
    if len(heavy):
        kept = kept.union(_rows(firsts, heavy, True, num, den))
    kept = scratch.save(kept, "kept")
    level = F.shiftright("meta", 24).bitwiseAND(F.lit(0xFFFF))
    kept = kept.select("key", "doc_id", F.shiftright("meta", 40).cast("int").alias("part"), F.shiftright(level, 1).alias("band"), level.bitwiseAND(F.lit(1)).alias("upper"))
    own = F.struct(F.xxhash64("key", "band").alias("tile"), F.lit(False).alias("up"))
    above = F.struct(F.xxhash64("key", F.col("band") + 1).alias("tile"), F.lit(True).alias("up"))
    tiles = kept.select("doc_id", "part", F.explode(F.when(F.col("upper") == 1, F.array(own, above)).otherwise(F.array(own))).alias("x")).select("x.tile", "doc_id", "part", "x.up")
    whole = tiles.groupBy("tile").agg(
        F.count("*").alias("m"), F.sum(F.col("up").cast("long")).alias("ups"), F.min("doc_id").alias("rep"), F.max("doc_id").alias("last"),
        F.bit_xor(F.xxhash64("doc_id", "part", "up")).alias("s1"), F.bit_xor(F.xxhash64(F.lit(7), "up", "part", "doc_id")).alias("s2"),
    ).where("m > ups and rep <> last")
    chosen = scratch.save(whole.groupBy("s1", "s2", "m").agg(F.min(F.struct("tile", "rep")).alias("x")).select("x.tile", "x.rep", "m"), "heads")
    out = scratch.save(tiles.join(chosen.select("tile", "rep"), "tile").select("tile", "doc_id", "part", "up", "rep"), "tiles")
    scratch.drop("kept")
    return chosen, out


def _cheaper(large: DataFrame, heads: DataFrame, tiles: DataFrame, sets: DataFrame, scratch: Scratch) -> DataFrame:
    """Members (tile, doc_id, part, up) to compare for the clusters (doc_id, cluster) that are too large to be compared at once.

    A document has as many rows as tiles, and tiles overlap: a cluster that has fewer pairs in all than its tiles have is one tile.
    """
    size = large.groupBy("cluster").agg(F.count("*").alias("c"))
    pairs = heads.join(large, heads.rep == large.doc_id).groupBy("cluster").agg(F.sum(F.col("m").cast("double") * F.col("m")).alias("pairs"))
    one = size.join(pairs, "cluster").where(F.col("c").cast("double") * F.col("c") <= F.col("pairs")).select("cluster", F.lit(True).alias("one"))
    large = scratch.save(large.join(one, "cluster", "left").select("doc_id", "cluster", F.coalesce("one", F.lit(False)).alias("one")), "large")
    whole = id_join(sets.select("doc_id", "part"), large.where("one").select("doc_id", "cluster"), "doc_id", "inner").select(F.xxhash64("cluster", F.lit("whole")).alias("tile"), "doc_id", "part", F.lit(False).alias("up"))
    apart = id_join(tiles, large.where("not one").select("doc_id"), "doc_id", "left_semi").select("tile", "doc_id", "part", "up")
    return scratch.save(whole.union(apart), "members")


def _larger(tiles: DataFrame, sets: DataFrame, known: DataFrame, scratch: Scratch, members: int, hashes: int, num: int, den: int) -> DataFrame:
    """Links of the clusters that are too large to be compared at once: by their tiles, whose blocks first meet themselves, then others."""
    parts = ["doc_id", "part"]
    sized = tiles.join(sets.select(*parts, "n"), parts).groupBy("tile").agg(F.greatest(F.ceil(F.count("*") / members), F.ceil(F.sum("n") / hashes)).cast("int").alias("blocks"))
    rows = tiles.select("tile", *parts, "up").join(sized, "tile").withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
    rows = scratch.save(rows, "blocks")
    sets = sets.select(*parts, "hashes")
    inside = rows.join(sets, parts).select("tile", "block", "up", F.lit(False).alias("side"), F.col("doc_id").alias("label"), "hashes")
    links = scratch.save(_compared(inside, ["tile", "block"], False, num, den).union(known), "links-inside")
    cut = rows.where("blocks > 1")
    if cut.isEmpty():
        return links
    labels = scratch.save(components(links), "inside")
    cut = cut.join(labels, cut.doc_id == labels.node, "left").select("tile", *parts, "up", "block", "blocks", F.coalesce("label", "doc_id").alias("label"))
    mixed = cut.groupBy("tile").agg(F.min("label").alias("l0"), F.max("label").alias("l1")).where("l0 <> l1").select("tile")
    cut = cut.join(mixed, "tile").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).where("other <> block")
    cut = cut.select("tile", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "up", (F.col("block") > F.col("other")).alias("side"), "label", *parts)
    return links.union(scratch.save(_compared(cut.join(sets, parts), ["tile", "x", "y"], True, num, den), "links-across"))


def _links(docs: DataFrame, heads: DataFrame, tiles: DataFrame, scratch: Scratch, n: int, num: int, den: int, members: int, hashes: int) -> DataFrame:
    """(a, b): labels of linked documents that become one."""
    clusters = scratch.save(components(tiles.where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))), "clusters")
    ids = clusters.select(F.col("node").alias("doc_id"))
    sets = scratch.save(_hashes(id_join(docs, ids, "doc_id", "left_semi"), n), "hashes")
    of = clusters.select(F.col("node").alias("doc_id"), F.col("label").alias("cluster"))
    sizes = sets.select("doc_id", "n").join(of, "doc_id").groupBy("cluster").agg(F.count("*").alias("m"), F.sum("n").alias("n"))
    small = (F.col("m") <= members) & (F.col("n") <= hashes)
    of = scratch.save(of.join(sizes.select("cluster", small.alias("small")), "cluster"), "sized")
    rows = id_join(sets, of.where("small"), "doc_id", "inner").select("cluster", F.lit(False).alias("up"), F.lit(False).alias("side"), F.col("doc_id").alias("label"), "hashes")
    links = scratch.save(_compared(rows, ["cluster"], False, num, den), "links")
    large = of.where("not small").select("doc_id", "cluster")
    if not large.isEmpty():
        sets = id_join(sets, large.select("doc_id"), "doc_id", "left_semi")
        links = _larger(_cheaper(large, heads, tiles, sets, scratch), sets, links, scratch, members, hashes, num, den)
    return links


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, num: int = 80, den: int = 100, members: int = MEMBERS, hashes: int = HASHES, heavy_most: int = HEAVY, heavy_least: int = HEAVY_LEAST) -> DataFrame:
    """doc_id, n_shingles, class_id (smallest id of an equal set), component_id (smallest id reachable by links).

    Exact for any ``0 < num <= den``: links of any two documents with ``den * intersection >= num * union`` count,
    whatever the sizes of groups; ties at the threshold link. Words are runs of other than ASCII white space,
    A-Z as a-z; a text of fewer than ``n`` words is one shingle; a text without words, null included, links with
    nothing. Texts of any length are taken whole. Rows with a null id form no links and are returned with null
    class and component; rows with equal ids and texts count as copies, rows with equal ids and different texts as
    one document, which links where any of its texts does. Each row of ``docs`` gives one row; its other
    columns, whatever their names, are not returned. An empty table gives an empty one.
    """
    scratch = Scratch(docs.sparkSession, "jaccard")
    docs = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    rows = ["doc_id", "part"]
    sets = scratch.save(_sets(docs, n, num, den), "sets")
    there = sets.where("n > 0 and doc_id is not null")
    classes = there.groupBy("print").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("members"))
    known = scratch.save(there.select(*rows, "print").join(classes.where("members > 1"), "print").select(*rows, "class_id").distinct(), "classes")
    copies = scratch.save(known.where("doc_id <> class_id").select(*rows), "copies")
    again = scratch.save(there.groupBy("doc_id").agg(F.count("*").alias("m")).where("m > 1").select("doc_id"), "again")
    firsts = id_join(there.select(*rows, "n", "keys"), copies, rows, "left_anti")
    repeated = not again.isEmpty()
    if repeated:
        firsts = id_join(firsts, again, "doc_id", "left_anti").union(id_join(firsts, again, "doc_id", "left_semi").dropDuplicates(rows))
    heads, tiles = _tiles(firsts, scratch, num, den, heavy_most, heavy_least)
    links = _links(docs, heads, tiles, scratch, n, num, den, members, hashes)
    if repeated:
        links = links.union(id_join(known, again, "doc_id", "left_semi").select(F.col("doc_id").alias("a"), F.col("class_id").alias("b")))
    whole = scratch.save(components(links), "whole")
    scratch.drop("hashes")
    out = sets.select(*rows, F.col("n").alias("n_shingles")).join(known, rows, "left").withColumn("class_id", F.coalesce("class_id", "doc_id"))
    out = out.join(whole, out.class_id == whole.node, "left")
    return out.select("doc_id", "n_shingles", "class_id", F.coalesce("label", "class_id").alias("component_id"))
