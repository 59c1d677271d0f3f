"""Embedding near-dedup: all pairs by int8 tile products with rigorous bounds, the doubtful ones in full precision."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import HUB, components, keyed
from .common import Scratch
from .vectors import matrix, prepared, unit, usable

#: Most vectors of a block and most components of all its vectors (a block moves as int8, one byte each); a tile compares
#: two blocks, in strips of rows and columns. Small tables are cut into ``LEAST`` blocks, so that there are tiles for all cores.
BLOCK, COMPONENTS, LEAST, STRIP = 32768, 1 << 21, 8, 512
#: Tasks that compare tiles; beyond it a task has several.
MOST_TASKS = 1 << 15
#: Covers the rounding of single-precision scaling, far above its size.
SLACK = 1e-5


def quantise(u: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Int8 vectors, their scales, and the norms of what they leave of the unit vectors u."""
    scale = np.abs(u).max(axis=1) / 127
    q = np.rint(u / scale[:, None]).astype(np.int8)
    rest = u - q * scale[:, None]
    return q, scale, np.sqrt(np.einsum("ij,ij->i", rest, rest)) + 1e-12


def roots(parent: np.ndarray) -> None:
    while not np.array_equal(up := parent[parent], parent):
        parent[:] = up


def joined(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Union of the sets of a and b; every set's root is its smallest member."""
    while len(a):
        roots(parent)
        low, high = np.minimum(parent[a], parent[b]), np.maximum(parent[a], parent[b])
        open_ = low < high
        a, b = a[open_], b[open_]
        np.minimum.at(parent, high[open_], low[open_])


class Side:
    """The quantised vectors of one side of a tile: numbers of classes, their smallest ids and members, int8 vectors, scales, norms of what is left."""

    def __init__(self, ids: np.ndarray, rep: np.ndarray, members: np.ndarray, q: np.ndarray, s: np.ndarray, e: np.ndarray) -> None:
        self.ids, self.rep, self.members, self.q, self.s, self.e = ids, rep, members, q, s, e
        # exact in single precision up to 1,040 components (1,040 * 127 * 127 < 2 ** 24), and in double beyond
        self.kind = np.float32 if q.shape[1] <= 1040 else np.float64

    @classmethod
    def of(cls, ids: np.ndarray, rep: np.ndarray, members: np.ndarray, x: np.ndarray) -> Side:
        return cls(ids, rep, members, *quantise(unit(x)))


def tile(x: Side, y: Side, threshold: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs (i, j) whose cosine may be >= threshold, strip by strip, and which of them certainly are.

    With u = s q + e and v = t r + f the cosine u.v differs from st q.r by at most |e| + |f| + |e||f|. The product
    of int8 values is exact, so a pair gets the same bounds in whatever tile it is compared.
    """
    for at in range(0, len(x.q), STRIP):
        q, s, e = x.q[at : at + STRIP].astype(x.kind), x.s[at : at + STRIP], x.e[at : at + STRIP]
        for to in range(0, len(y.q), 8 * STRIP):
            r, t, f = y.q[to : to + 8 * STRIP].astype(x.kind), y.s[to : to + 8 * STRIP], y.e[to : to + 8 * STRIP]
            g = q @ r.T
            i, j = np.nonzero(g * t[None, :].astype(x.kind) >= ((threshold - 2 * SLACK - e - f.max() * (1 + e)) / s)[:, None].astype(x.kind))
            near = g[i, j].astype(np.float64) * s[i] * t[j]
            off = e[i] + f[j] + e[i] * f[j] + SLACK
            keep = near + off >= threshold
            if same:
                keep &= i + at != j + to
            yield i[keep] + at, j[keep] + to, (near - off)[keep] >= threshold


class Links:
    """Links of two sides (or of one with itself) as counts for each vector and components, never as pairs."""

    def __init__(self, x: Side, y: Side, same: bool) -> None:
        self.x, self.y, self.same = x, y, same
        self.ids, self.rep = (x.ids, x.rep) if same else (np.concatenate([x.ids, y.ids]), np.concatenate([x.rep, y.rep]))
        self.order = np.lexsort((self.ids, self.rep))  # positions in ascending order of ids: a set's root is its smallest one
        self.place = np.empty(len(self.ids), dtype=np.int64)
        self.place[self.order] = np.arange(len(self.ids))
        self.parent, self.links = np.arange(len(self.ids)), np.zeros(len(self.ids), dtype=np.int64)

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        np.add.at(self.links, i, self.y.members[j])
        if not self.same:
            np.add.at(self.links, len(self.x.ids) + j, self.x.members[i])
            j = len(self.x.ids) + j
        joined(self.parent, self.place[i], self.place[j])

    def rows(self, doubtful: np.ndarray) -> pa.RecordBatch:
        """A row for each vector that is linked or (for a later look) in doubt."""
        hit = np.flatnonzero((self.links > 0) | doubtful)
        roots(self.parent)
        root = self.order[self.parent[self.place[hit]]]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (self.ids[hit], self.rep[hit], self.links[hit], self.ids[root], self.rep[root], doubtful[hit])], names=["no", "rep", "links", "root", "root_rep", "doubtful"])


def _vectors(table: pa.Table, name: str, dim: int) -> np.ndarray:
    return np.concatenate([matrix(c, dim) for c in table.column(name).chunks])


def _pack(table: pa.Table) -> pa.Table:
    """The row of a block: its vectors as int8."""
    dim = table.column("dim")[0].as_py()
    side = Side.of(*(table.column(c).to_numpy() for c in ("no", "rep", "members")), _vectors(table, "v", dim))
    return pa.table({"block": table.column("block").slice(0, 1), "dim": table.column("dim").slice(0, 1)} | {k: pa.array([np.ascontiguousarray(v).tobytes()]) for k, v in vars(side).items() if k in PACKED})


#: What a packed block holds, as bytes.
PACKED = {"ids": np.int64, "rep": np.int64, "members": np.int64, "q": np.int8, "s": np.float64, "e": np.float64}
LINKED = "no long, rep long, links long, root long, root_rep long"
FOUND = f"lo long, hi long, {LINKED}, doubtful boolean"


def _compare(threshold: float):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        lo, hi, dim = (k.as_py() for k in key)
        sides = []
        for row in table.sort_by("block").to_pylist():
            got = {k: np.frombuffer(row[k], dtype=kind) for k, kind in PACKED.items()}
            sides.append(Side(**got | {"q": got["q"].reshape(-1, dim)}))
        if len(sides) < 1 + (lo != hi):  # no vectors of this length in the other block
            return SHAPE.empty_table()
        x, y, same = sides[0], sides[-1], lo == hi
        out, doubtful = Links(x, y, same), np.zeros(len(x.ids) + (0 if same else len(y.ids)), dtype=bool)
        for i, j, sure in tile(x, y, threshold, same):
            out.add(i[sure], j[sure])
            doubtful[i[~sure]] = True
            doubtful[j[~sure] + (0 if same else len(x.ids))] = True
        found = pa.Table.from_batches([out.rows(doubtful)])
        return found.add_column(0, "lo", pa.array(np.full(found.num_rows, lo))).add_column(1, "hi", pa.array(np.full(found.num_rows, hi)))

    return run


#: Pairs that are recomputed at once.
AT_ONCE = 1 << 16
SHAPE = pa.schema([(c, pa.int64()) for c in ("lo", "hi", "no", "rep", "links", "root", "root_rep")] + [("doubtful", pa.bool_())])


def exact(a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """Whether the cosines of the rows of a and b are >= threshold, in double precision."""
    na, nb = np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1)
    if np.isfinite(na).all() and np.isfinite(nb).all() and na.min() > 1e-150 and nb.min() > 1e-150:
        return np.einsum("ij,ij->i", a, b) / (na * nb) >= threshold
    return np.einsum("ij,ij->i", unit(a), unit(b)) >= threshold


def _recompute(threshold: float):
    """The doubtful pairs of a tile, among the vectors that have any, from the vectors themselves."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        lo, hi, dim = (k.as_py() for k in key)
        v, block = _vectors(table, "v", dim), table.column("block").to_numpy()
        own, same = [table.column(c).to_numpy() for c in ("no", "rep", "members")], lo == hi
        first, second = np.flatnonzero(block == lo), np.flatnonzero(block == hi)
        x, y = (Side.of(*(c[k] for c in own), v[k]) for k in (first, second))
        out = Links(x, y, same)
        for i, j, sure in tile(x, y, threshold, same):
            i, j = i[~sure], j[~sure]
            for at in range(0, len(i), AT_ONCE):
                a, b = i[at : at + AT_ONCE], j[at : at + AT_ONCE]
                linked = exact(v[first[a]], v[second[b]], threshold)
                out.add(a[linked], b[linked])
        found = pa.Table.from_batches([out.rows(np.zeros(len(out.ids), dtype=bool))])
        return found.select(["no", "rep", "links", "root", "root_rep"])

    return run


def dedup(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.9) -> DataFrame:
    """vec_id, n_links (other vectors of cosine >= threshold), component_id, kept (the smallest of its component).

    All pairs are compared, by tiles of two blocks; equal vectors form one class first, so copies, however many,
    take one place. Blocks move as int8; a tile's output is a row for each of its linked or doubtful vectors, with
    their number of certain links and their component within the tile, never the pairs. For each tile the doubtful
    vectors alone are then fetched in full, and what is between the bounds is recomputed. The work is quadratic in
    the number of distinct vectors, at about 64 multiplications a pair; a block of 3 MB moves for a billion pairs. Vectors that are null, empty, zero or hold null or non-finite
    components, and rows without an id, link with nothing (an id's component is itself). Vectors of different
    lengths never link. Rows with equal ids are vectors of their own, with links and a component each.
    """
    scratch = Scratch(vectors.sparkSession, "neardup")
    rows = prepared(vectors, id_col, vector_col)
    classes = rows.groupBy("v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("members"))
    # a class's number, not its smallest id: an id may have several vectors
    classes = scratch.save(classes.select(F.monotonically_increasing_id().alias("no"), "v", "rep", "members"), "classes")
    n, dim, most = classes.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(1)), F.coalesce(F.max("members"), F.lit(0))).first()
    blocks = max(1, -(-n // min(BLOCK, max(1, COMPONENTS // dim))), min(LEAST, n // (4 * STRIP)))
    classes = classes.select("*", F.pmod(F.xxhash64("no"), F.lit(blocks)).cast("long").alias("block"), F.size("v").alias("dim"))
    packed = classes.repartition(blocks, "block").groupBy("block", "dim").applyInArrow(_pack, "block long, dim int, " + ", ".join(f"{k} binary" for k in PACKED))
    packed = scratch.save(packed, "blocks")
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))
    tiles = packed.select("*", other.alias("other")).select("*", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi")).drop("other")
    count = min(blocks * (blocks + 1) // 2, MOST_TASKS)
    seen = scratch.save(tiles.repartition(count, "lo", "hi", "dim").groupBy("lo", "hi", "dim").applyInArrow(_compare(threshold), FOUND), "seen")
    doubt = seen.where("doubtful").select("lo", "hi", "no")
    doubt = doubt.join(classes, "no").repartition(count, "lo", "hi", "dim").groupBy("lo", "hi", "dim").applyInArrow(_recompute(threshold), LINKED)
    found = scratch.save(seen.where("links > 0").drop("lo", "hi", "doubtful").union(doubt), "found")
    links = found.groupBy("no").agg(F.sum("links").alias("links"))
    # nodes are (smallest id, number), so that a component's label says its smallest id
    labels = components(found.select(F.struct("rep", "no").alias("a"), F.struct(F.col("root_rep").alias("rep"), F.col("root").alias("no")).alias("b")))
    labels = labels.select(F.col("node.no").alias("no"), F.col("label.rep").alias("label"))
    of = classes.join(links, "no", "left").join(labels, "no", "left")
    of = of.select("v", F.col("members").alias("n"), (F.coalesce("links", F.lit(0)) + F.col("members") - 1).alias("n_links"), F.coalesce("label", "rep").alias("component_id"))
    met = rows.join(of, "v") if most <= HUB else keyed(rows, scratch.save(of, "of"), "v")  # no task reads more copies of a vector
    linked = met.select("vec_id", "n_links", "component_id")
    alone = vectors.select(vectors[id_col].cast("long").alias("vec_id"), vectors[vector_col].cast("array<double>").alias("v")).where(F.col("vec_id").isNull() | ~usable(F.col("v"))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
