"""Approximate nearest neighbours: a navigable small-world graph per shard, results merged."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch
from .vectors import prepared, unit

#: Vectors of a shard; links of a node (twice as many on the ground layer); candidates for them; width of the search.
SHARD, LINKS, CANDIDATES, WIDTH = 8192, 16, 64, 200
#: Most nodes that are inserted at once; they see each other by a product.
INSERTED = 512
#: Queries searched at once, and blocks of them for which a shard is sent once.
BLOCK, TOGETHER = 512, 32


def chosen(v: np.ndarray, nodes: np.ndarray, cand: np.ndarray, sims: np.ndarray, m: int) -> np.ndarray:
    """Up to m links of each node from its candidates (-1: none), nearest first.

    A candidate is taken if it is closer to the node than to any one taken before; the nearest of the others
    fill what is left.
    """
    order = np.argsort(-np.where(cand >= 0, sims, -np.inf), axis=1, kind="stable")
    cand, sims = np.take_along_axis(cand, order, 1), np.take_along_axis(sims, order, 1)
    x = v[np.maximum(cand, 0)]
    among = x @ x.transpose(0, 2, 1)
    n, c = cand.shape
    taken = np.zeros((n, c), dtype=bool)
    count = np.zeros(n, dtype=np.int64)
    for i in range(c):
        closest = np.where(taken, among[:, i, :], -np.inf).max(axis=1)
        take = (cand[:, i] >= 0) & (sims[:, i] > closest) & (count < m)
        taken[:, i] = take
        count += take
    rank = np.where(cand >= 0, np.arange(c)[None, :] + np.where(taken, 0, c), 3 * c)
    best = np.argsort(rank, axis=1, kind="stable")[:, :m]
    out = np.take_along_axis(cand, best, 1)
    return np.concatenate([out, np.full((n, m - out.shape[1]), -1, dtype=out.dtype)], axis=1) if out.shape[1] < m else out


def descended(v: np.ndarray, links: np.ndarray, q: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Where single steps to nearer neighbours lead from the places ``at`` of a layer."""
    at, best, open_ = at.copy(), np.einsum("nd,nd->n", q, v[at]), np.arange(len(q))
    while len(open_):
        near = links[at[open_]]
        sims = np.where(near >= 0, np.einsum("nd,ncd->nc", q[open_], v[np.maximum(near, 0)]), -np.inf)
        to = sims.argmax(axis=1)
        better = sims[np.arange(len(open_)), to] > best[open_]
        open_, near, to, sims = open_[better], near[better], to[better], sims[better]
        at[open_], best[open_] = near[np.arange(len(open_)), to], sims[np.arange(len(open_)), to]
    return at


def beam(v: np.ndarray, links: np.ndarray, q: np.ndarray, at: np.ndarray | None, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Up to ``width`` near places of a layer for each query (-1: none) and their products, in no order.

    The search starts from ``at``, if given, and a spread of others: several ways into separate clusters.
    """
    n = len(q)
    seen = np.zeros((n, len(v)), dtype=bool)
    found, sims, done = np.full((n, width), -1, dtype=np.int64), np.full((n, width), -np.inf, dtype=q.dtype), np.ones((n, width), dtype=bool)
    entry = np.unique(np.linspace(0, len(v) - 1, min(16, len(v), width)).astype(np.int64))
    start = np.repeat(entry[None, :], n, axis=0)
    if at is not None:
        start = np.concatenate([start, at[:, None]], axis=1)[:, :width]
        start[:, :-1] = np.where(start[:, :-1] == at[:, None], -1, start[:, :-1])
        start[:, -1] = at
    c = start.shape[1]
    found[:, :c], sims[:, :c] = start, np.where(start >= 0, np.einsum("nd,ncd->nc", q, v[np.maximum(start, 0)]), -np.inf)
    done[:, :c] = start < 0
    seen[np.arange(n)[:, None], np.maximum(start, 0)] |= start >= 0
    open_ = np.arange(n)
    while len(open_):
        score = np.where(done[open_], -np.inf, sims[open_])
        pick = score.argmax(axis=1)
        more = score[np.arange(len(open_)), pick] > -np.inf
        open_, pick = open_[more], pick[more]
        if not len(open_):
            break
        done[open_, pick] = True
        near = links[found[open_, pick]].astype(np.int64)
        fresh = (near >= 0) & ~seen[open_[:, None], np.maximum(near, 0)]
        seen[np.repeat(open_, fresh.sum(axis=1)), near[fresh]] = True
        s = np.where(fresh, np.einsum("nd,ncd->nc", q[open_], v[np.maximum(near, 0)]), -np.inf)
        ids = np.concatenate([found[open_], np.where(fresh, near, -1)], axis=1)
        all_ = np.concatenate([sims[open_], s], axis=1)
        flags = np.concatenate([done[open_], ~fresh], axis=1)
        best = np.argpartition(-all_, width - 1, axis=1)[:, :width]
        found[open_], sims[open_], done[open_] = (np.take_along_axis(y, best, 1) for y in (ids, all_, flags))
    return np.where(sims > -np.inf, found, -1), sims


def entries(v: np.ndarray, above: list[np.ndarray], q: np.ndarray) -> np.ndarray:
    """A place near each query, down the layers ``above`` (the lowest first) from the first node of the top."""
    at = np.zeros(len(q), dtype=np.int64)
    for links in reversed(above):
        at = descended(v, links, q, at)
    return at


def layer(v: np.ndarray, m: int, above: list[np.ndarray]) -> np.ndarray:
    """The flat neighbour array (n, m) of one layer, for unit vectors in order of insertion, those of the layers above first.

    Nodes come in batches. Each is searched for in what the layer holds so far, from where the layers above lead, and
    links to the best of what it finds there and in its own batch; those it links to take it as a candidate in turn.
    """
    n, upper = len(v), len(above[0]) if above else 0
    links = np.full((n, m), -1, dtype=np.int32)
    at = 0
    while at < n:
        to = min(n, at + min(INSERTED, max(64, at)))
        q, nodes = v[at:to], np.arange(at, to)
        own = q @ q.T
        own[np.arange(to - at), np.arange(to - at)] = -np.inf
        k = min(CANDIDATES, to - at)
        cand = np.argpartition(-own, k - 1, axis=1)[:, :k]
        sims = np.take_along_axis(own, cand, 1)
        cand = np.where(sims > -np.inf, cand + at, -1)
        if at:
            old, near = beam(v[:at], links, q, entries(v, above, q) if upper and at >= upper else None, CANDIDATES)
            cand, sims = np.concatenate([old, cand], axis=1), np.concatenate([near, sims], axis=1)
        for a in range(0, to - at, 256):
            links[nodes[a : a + 256], : m // 2] = chosen(v, nodes[a : a + 256], cand[a : a + 256], sims[a : a + 256], m // 2)  # the other half is for links back
        # links back: (to, from), grouped by the node that gets them
        src = np.repeat(nodes, m)
        dst = links[at:to].ravel()
        src, dst = src[dst >= 0], dst[dst >= 0]
        order = np.lexsort((-np.einsum("ij,ij->i", v[src], v[dst]), dst))
        src, dst = src[order], dst[order]
        got, first, many = np.unique(dst, return_index=True, return_counts=True)
        for a in range(0, len(got), 256):
            own_, f, c = got[a : a + 256], first[a : a + 256], np.minimum(many[a : a + 256], 2 * m)
            back = np.full((len(own_), int(c.max())), -1, dtype=np.int32)
            fill = np.arange(back.shape[1])[None, :] < c[:, None]
            back[fill] = src[np.repeat(f, c) + np.concatenate([np.arange(x) for x in c])]
            cand = np.concatenate([links[own_], np.where((back[:, :, None] == links[own_][:, None, :]).any(axis=2), -1, back)], axis=1)
            sims = np.einsum("nd,ncd->nc", v[own_], v[np.maximum(cand, 0)])
            links[own_] = chosen(v, own_, cand, sims, m)
        at = to
    return links


def build(v: np.ndarray, seed: int = 1) -> tuple[np.ndarray, list[np.ndarray]]:
    """The nodes in order of insertion, the highest first, and from the ground up the neighbours of each layer's nodes, the first of that order (-1: none)."""
    rng = np.random.default_rng(seed)
    height = np.minimum(np.floor(-np.log(rng.random(len(v))) / math.log(LINKS)).astype(int), 12)
    nodes = np.lexsort((rng.random(len(v)), -height)).astype(np.int32)
    layers: list[np.ndarray] = []
    for level in range(int(height.max(initial=0)), -1, -1):
        n = int((height >= level).sum())
        layers.insert(0, layer(v[nodes[:n]], 2 * LINKS if level == 0 else LINKS, layers))
    return nodes, layers


def search(v: np.ndarray, layers: list[np.ndarray], q: np.ndarray, width: int) -> np.ndarray:
    """Up to ``width`` near places found for each query (-1: none), in no order: down the upper layers by single steps, on the ground by a beam."""
    return beam(v, layers[0], q, entries(v, layers[1:], q), width)[0]


def _indexed(shard: int, held: list[pa.RecordBatch]) -> pa.RecordBatch:
    """The row of a shard: numbers, smallest ids and vectors of its nodes, and its layers, as flat arrays."""
    own = pa.Table.from_batches(held)
    x = np.concatenate([c.flatten().to_numpy() for c in own.column("v").chunks]).astype(np.float64).reshape(own.num_rows, -1)
    by = np.argsort(own.column("rep").to_numpy())  # the same graph whatever the order of the rows
    nodes, layers = build(unit(x[by]).astype(np.float32), shard + 1)
    by = by[nodes]
    ids, first = (own.column(c).to_numpy()[by].tobytes() for c in ("rep", "first"))
    return pa.RecordBatch.from_arrays([
        pa.array([shard]), pa.array([x.shape[1]]), pa.array([ids]), pa.array([first]), pa.array([x[by].tobytes()]), pa.array([[links.tobytes() for links in layers]], pa.list_(pa.binary())),
    ], names=["shard", "dim", "ids", "first", "v", "links"])


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each shard; rows come sorted by shard, and one shard is held at a time."""
    at, held = None, []
    for batch in batches:
        shard = batch.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), len(shard)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if b > a:
                if held and shard[a] != at:
                    yield _indexed(at, held)
                    held = []
                at = int(shard[a])
                held.append(batch.slice(a, b - a))
    if held:
        yield _indexed(at, held)


def _found(k: int, width: int):
    """Rows sorted so that a shard's index comes before the blocks of queries that search it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, first, x, dim, layers = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros((0, 0)), 0, []
        for batch in batches:
            for row in range(batch.num_rows):
                raw_ids, raw_first, raw, links, own, queries, qv = (c[row].as_py() for c in batch.columns)
                if raw_ids is not None:
                    ids, first, x, dim = np.frombuffer(raw_ids, dtype=np.int64), np.frombuffer(raw_first, dtype=np.int64), np.frombuffer(raw).reshape(-1, own), own
                    layers = [np.frombuffer(c, dtype=np.int32).reshape(-1, 2 * LINKS if i == 0 else LINKS) for i, c in enumerate(links)]
                    index = unit(x).astype(np.float32)
                elif own == dim:  # else no vector of this length is in the shard
                    y = np.array(qv, dtype=np.float64)
                    got = search(index, layers, unit(y).astype(np.float32), max(width, k))
                    of, place = np.nonzero(got >= 0)
                    node = got[of, place]
                    a, b = y[of], x[node]
                    with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
                        score = np.einsum("ij,ij->i", a, b) / (np.sqrt(np.einsum("ij,ij->i", a, a)) * np.sqrt(np.einsum("ij,ij->i", b, b)))
                    score = np.where(np.isfinite(score), score, np.einsum("ij,ij->i", unit(a), unit(b)))
                    # all that was found, in double precision: the best k, of equal ones those of the smallest ids
                    order = np.lexsort((first[node], -score, of))
                    rank = np.arange(len(of)) - np.searchsorted(of, of)
                    order = order[rank < k]
                    yield pa.RecordBatch.from_arrays([pa.array(np.array(queries, dtype=np.int64)[of[order]]), pa.array(ids[node[order]]), pa.array(score[order])], names=["query_id", "rep", "score"])

    return run


def neighbours(vectors: DataFrame, is_query, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", width: int = WIDTH) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest rows found for each query row, by cosine.

    ``is_query`` is a condition on vec_id. All rows that take part (see ``prepared``) are indexed, in shards of
    about SHARD distinct vectors; equal vectors are one node, with its k + 1 smallest ids. Every query, in
    blocks, is searched in every shard, so the work is that of queries times shards; a shard is sent once for
    TOGETHER blocks. Rows with the query's id are no candidates; ties go to the smaller id. Rows of one id and
    vector count once; an id with several vectors is found by the nearest of them, and asks with each. Vectors of
    lengths other than a query's are not compared with it. Other columns are not looked at; an empty table gives
    an empty one.
    """
    scratch = Scratch(vectors.sparkSession, "hnsw")
    rows = prepared(vectors, id_col, vector_col).withColumn("dim", F.size("v"))
    few = rows.withColumn("r", F.dense_rank().over(Window.partitionBy("v").orderBy("vec_id"))).where(F.col("r") <= k + 1)
    classes = few.groupBy("v").agg(F.sort_array(F.collect_set("vec_id")).alias("members"), F.min("dim").alias("dim"))
    # a node's number, not its smallest id: an id may have several vectors
    classes = scratch.save(classes.select(F.monotonically_increasing_id().alias("rep"), "v", "members", "dim"), "classes")
    shards = max(1, -(-classes.count() // SHARD))
    slots = classes.select((F.pmod(F.xxhash64("v"), F.lit(shards)) + F.col("dim").cast("long") * shards).alias("shard"), "rep", F.element_at("members", 1).alias("first"), "v")
    index = scratch.save(slots.repartition(shards, "shard").sortWithinPartitions("shard").mapInArrow(_index, "shard long, dim long, ids binary, first binary, v binary, links array<binary>"), "index")
    asked = scratch.save(rows.where(is_query).select("vec_id", "v", "dim").distinct(), "asked")
    total = max(1, -(-asked.count() // BLOCK))
    groups = -(-total // TOGETHER)
    blocks = asked.groupBy("dim", F.pmod(F.xxhash64("vec_id", F.lit(7)), F.lit(total)).alias("block")).agg(F.collect_list("vec_id").alias("queries"), F.collect_list("v").alias("qv"))
    some = lambda name, kind: F.lit(None).cast(kind).alias(name)
    blocks = blocks.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).select(
        (F.col("s") + F.col("dim").cast("long") * shards).alias("shard"), F.pmod("block", F.lit(groups)).cast("int").alias("g"), F.lit(1).alias("kind"), some("ids", "binary"), some("first", "binary"), some("v", "binary"), some("links", "array<binary>"), F.col("dim").cast("long").alias("dim"), "queries", "qv")
    there = index.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).select("shard", "g", F.lit(0).alias("kind"), "ids", "first", "v", "links", "dim", some("queries", "array<bigint>"), some("qv", "array<array<double>>"))
    pairs = there.union(blocks).repartition(shards * groups, "shard", "g").sortWithinPartitions("shard", "g", "kind").select("ids", "first", "v", "links", "dim", "queries", "qv")
    found = pairs.mapInArrow(_found(k + 1, width), "query_id long, rep long, score double")
    hits = found.join(classes.select("rep", F.explode("members").alias("vec_id")), "rep").where("vec_id <> query_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
