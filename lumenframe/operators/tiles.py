"""Rasters of any size by tiles: convolution by Fourier transform, and components across the seams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernels
from ..sources.store import tasks_of, written
from .color import LUM
from .graph import components as graph_components

#: Side of a tile: what one task holds of a photo.
SIDE = 512


def _numbers(table: pa.Table, *names: str) -> list[np.ndarray]:
    return [table.column(n).to_numpy() for n in names]


def _convolved(kernel: np.ndarray, side: int, pad: float | None):
    n, m = kernel.shape
    up, left = n // 2, m // 2

    def run(key: tuple, table: pa.Table) -> pa.Table:
        photo, tr, tc = (k.as_py() for k in key)
        h, w = table.column("h")[0].as_py(), table.column("w")[0].as_py()
        rw, cl, x = _numbers(table, "rw", "cl", "x")
        r0, r1, c0, c1 = tr * side, min(h, (tr + 1) * side), tc * side, min(w, (tc + 1) * side)
        a0, a1, b0, b1 = max(0, r0 - up), min(h, r1 + up), max(0, c0 - left), min(w, c1 + left)
        own = np.zeros((a1 - a0, b1 - b0))
        own[rw - 1 - a0, cl - 1 - b0] = x
        beyond = ((a0 - r0 + up, r1 + up - a1), (b0 - c0 + left, c1 + left - b1))
        own = np.pad(own, beyond, mode="edge") if pad is None else np.pad(own, beyond, constant_values=pad)
        # what wraps around falls on the first rows and columns, which lie in the halo
        out = np.fft.irfft2(np.fft.rfft2(own) * np.fft.rfft2(kernel, s=own.shape), s=own.shape)[n - 1 :, m - 1 :]
        r, c = np.mgrid[r0 + 1 : r1 + 1, c0 + 1 : c1 + 1]
        size = out.size
        return pa.table({"photo_id": pa.array(np.full(size, photo)), "rw": pa.array(r.ravel(), pa.int32()), "cl": pa.array(c.ravel(), pa.int32()), "v": pa.array(out.ravel())})

    return run


def _tiles_with_halo(px: DataFrame, side: int, up: int, left: int) -> DataFrame:
    """Every pixel in its own tile, and in those whose halo it lies in."""
    near = lambda at, n, k: F.explode(F.sequence(F.greatest(F.floor((F.col(at) - 1 - k) / side), F.lit(0)), F.least(F.floor((F.col(at) - 1 + k) / side), F.floor((F.col(n) - 1) / side))))
    return px.withColumn("tr", near("rw", "h", up)).withColumn("tc", near("cl", "w", left))


def conv2_fft(px: DataFrame, weights: list[list[float]], value: str = LUM, pad: float | str = 0.0, side: int = SIDE) -> DataFrame:
    """photo_id, rw, cl, v: two-dimensional convolution with any odd kernel, as ``stencil.conv2`` does it directly.

    A tile and the halo of its kernel's half size are one task's work and transformed alone, so no photo has to fit a
    task, and the work does not grow with the kernel as it does directly. Beyond the photo lies ``pad``: a number, or ``replicate``.
    """
    kernel = np.array(weights, dtype=np.float64)
    if kernel.ndim != 2 or kernel.shape[0] % 2 == 0 or kernel.shape[1] % 2 == 0:
        raise ValueError("kernels have odd sizes")
    if isinstance(pad, str) and pad != "replicate":
        raise ValueError(f"no such padding: {pad}")
    rows = px.selectExpr("photo_id", "h", "w", "rw", "cl", f"cast({value} as double) as x")
    rows = _tiles_with_halo(rows, side, kernel.shape[0] // 2, kernel.shape[1] // 2)
    keys = ["photo_id", "tr", "tc"]
    dealt = rows.repartition(tasks_of(px.sparkSession), *keys).groupBy(*keys)
    return dealt.applyInArrow(_convolved(kernel, side, None if pad == "replicate" else float(pad)), "photo_id long, rw int, cl int, v double")


def _whole(batches: Iterator[pa.RecordBatch], keys: int, least: int) -> Iterator[list[np.ndarray]]:
    """Columns of rows sorted by the first ``keys`` ones, at least ``least`` rows at once and never a part of a key's."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(x.num_rows for x in held) < least:
            continue
        table = pa.Table.from_batches(held)
        cols = _numbers(table, *table.column_names[:keys])
        cuts = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0))
        if len(cuts):
            cut = int(cuts[-1]) + 1
            yield _numbers(table.slice(0, cut), *table.column_names)
            held = table.slice(cut).combine_chunks().to_batches()
    if sum(x.num_rows for x in held):
        table = pa.Table.from_batches(held)
        yield _numbers(table, *table.column_names)


#: Rows that a task labels or joins at once, besides those of a last tile or photo.
ROWS = 1 << 16


def _labelled(side: int):
    """Components within tiles of rows sorted by tile, column and row; a label is the smallest place (column by column, from 1) of the photo in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for photo, tr, tc, cl, rw, h, w, cluster in _whole(batches, 3, ROWS):
            tile = np.concatenate([[0], np.cumsum((photo[1:] != photo[:-1]) | (tr[1:] != tr[:-1]) | (tc[1:] != tc[:-1]))])
            code = (tile * side + (cl - 1) % side) * side + (rw - 1) % side  # ascends, and is the smallest place within a tile
            ahead = np.flatnonzero((cl - 1) % side < side - 1)
            right = np.minimum(np.searchsorted(code, code[ahead] + side), len(code) - 1)
            met = code[right] == code[ahead] + side
            down = np.flatnonzero((tile[1:] == tile[:-1]) & (cl[1:] == cl[:-1]) & (rw[1:] - rw[:-1] == 1))
            a, b = np.concatenate([down, ahead[met]]), np.concatenate([down + 1, right[met]])
            same = cluster[a] == cluster[b]
            first = kernels.joined(len(code), a[same], b[same])
            label = (cl[first].astype(np.int64) - 1) * h + rw[first]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (photo, h, w, rw, cl, cluster, label)], names=["photo_id", "h", "w", "rw", "cl", "cluster_id", "label"])

    return run


def _roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Labels that edges (photo_id, a, b), sorted by photo, make another, and which."""
    for photo, a, b in _whole(batches, 1, ROWS):
        photo, label = np.concatenate([photo, photo]), np.concatenate([a, b])
        order = np.lexsort((label, photo))
        new = np.concatenate([[True], (photo[order][1:] != photo[order][:-1]) | (label[order][1:] != label[order][:-1])])
        node = np.empty(len(order), dtype=np.int64)
        node[order] = np.cumsum(new) - 1
        photo, label = photo[order][new], label[order][new]
        root = kernels.joined(len(label), node[: len(a)], node[len(a) :])
        moved = np.flatnonzero(root != np.arange(len(root)))
        yield pa.RecordBatch.from_arrays([pa.array(photo[moved]), pa.array(label[moved]), pa.array(label[root[moved]])], names=["photo_id", "label", "root"])


#: Pairs of pixels at seams that a task joins for one photo; photos with more are joined as a graph.
SEAMS = 1_000_000


def _joined(edges: DataFrame, most: int) -> DataFrame:
    """photo_id, label, root of the labels that edges (photo_id, a, b; written) make another."""
    large = edges.groupBy("photo_id").agg(F.count("*").alias("n")).where(F.col("n") > most).select("photo_id")
    large = written(large, "large")
    some = not large.isEmpty()
    rest = edges.join(large, "photo_id", "left_anti") if some else edges
    rest = rest.repartition(tasks_of(edges.sparkSession), "photo_id").sortWithinPartitions("photo_id")
    found = rest.mapInArrow(_roots, "photo_id long, label long, root long")
    if some:
        node = lambda c: F.struct("photo_id", F.col(c).alias("label"))
        graph = graph_components(edges.join(large, "photo_id", "left_semi").select(node("a").alias("a"), node("b").alias("b")))
        found = found.union(graph.select("node.photo_id", "node.label", F.col("label.label").alias("root")).where("label <> root"))
    return found


def components(clusters: DataFrame, side: int = SIDE, seams: int = SEAMS) -> DataFrame:
    """photo_id, h, w, rw, cl, segment_id of rows with a cluster_id: 4-neighbour components, named by their smallest place.

    Tiles are labelled alone, many at once; only pairs of pixels that meet at a seam make the graph whose components join
    the labels, and those that change go back to the pixels. A photo's pairs are joined in one task, those of a photo with
    over ``seams`` of them by shuffles. A label has at most a tile's pixels.
    """
    keys = ["photo_id", "tr", "tc"]
    rows = clusters.select("photo_id", F.floor((F.col("rw") - 1) / side).alias("tr"), F.floor((F.col("cl") - 1) / side).alias("tc"), "cl", "rw", "h", "w", "cluster_id")
    rows = rows.repartition(tasks_of(clusters.sparkSession), *keys).sortWithinPartitions(*keys, "cl", "rw")
    labelled = written(rows.mapInArrow(_labelled(side), "photo_id long, h int, w int, rw int, cl int, cluster_id int, label long"), "labelled")

    def seam(at: str, size: str) -> DataFrame:
        """Both pixels of every pair across a seam, under the place of the first."""
        first, second = (F.col(at) % side == 0) & (F.col(at) < F.col(size)), (F.col(at) % side == (1 if side > 1 else 0)) & (F.col(at) > 1)
        other = "cl" if at == "rw" else "rw"
        to = F.explode(F.filter(F.array(F.when(first, F.col(at)), F.when(second, F.col(at) - 1)), lambda x: x.isNotNull()))
        return labelled.where(first | second).select("photo_id", F.lit(at).alias("way"), to.alias("at"), F.col(other).alias("along"), "cluster_id", "label")

    met = seam("rw", "h").union(seam("cl", "w")).groupBy("photo_id", "way", "at", "along").agg(F.min("label").alias("a"), F.max("label").alias("b"), F.min("cluster_id").alias("c"), F.max("cluster_id").alias("d"))
    joined = _joined(written(met.where("c = d and a <> b").select("photo_id", "a", "b"), "seams"), seams)
    return labelled.join(joined, ["photo_id", "label"], "left").select("photo_id", "h", "w", "rw", "cl", F.coalesce("root", "label").alias("segment_id"))
