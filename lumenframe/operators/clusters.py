"""Clusters of a photo's colours: the search for their number, and what pixels become of it."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernels
from ..sources.store import tasks_of, written
from .base import SqlOp
from .color import LUV

#: Tasks of the search for each that a shuffle has, as photos differ in what they take.
TASKS = 4
SEGMENTED = "photo_id long, h int, w int, rw int, cl int, segment_id long, clusters int"

LUV_PIXELS = SqlOp(f"select photo_id, h, w, rw, cl, l, coalesce(u, 0e0) as u, coalesce(v, 0e0) as v from ({LUV})")


def _picked(at: str, n: str) -> str:
    """Whether a place (from 1) is one of ``ceil(n / thin)`` evenly spread over n, rounded half to even."""
    m = f"greatest(1, cast(ceil({n} / thin) as int))"
    near = f"cast(rint(({at} - 1) * cast({m} - 1 as double) / greatest({n} - 1, 1)) as int)"
    hits = [f"({near} + {d} between 0 and {m} - 1 and rint(({near} + {d}) * (({n} - 1) / cast(greatest({m} - 1, 1) as double))) = {at} - 1)" for d in (-1, 0, 1)]
    return f"(case when {m} = 1 then {at} = 1 else {' or '.join(hits)} end)"


#: At most ``most`` (or a few more) pixels of a photo: evenly spread rows and columns.
SAMPLE = SqlOp(f"""
with t as (select *, sqrt(greatest(1e0, cast(h as double) * w / :most)) as thin from {{luv}})
select photo_id, sort_array(collect_list(struct(cl, rw, l, u, v))) as p from t where {_picked('rw', 'h')} and {_picked('cl', 'w')} group by photo_id""", most=10_000)


def samples(luv: DataFrame, most: int = 10_000) -> DataFrame:
    """photo_id, h, w, l, u, v: the sampled pixels of a photo column by column, as arrays of a bounded length. No query takes such a sample."""
    size = lambda of: F.size(F.array_distinct(F.col(f"p.{of}")))
    return SAMPLE(luv, most=most).select("photo_id", size("rw").alias("h"), size("cl").alias("w"), "p.l", "p.u", "p.v")


def least_clusters(photo: int, x: np.ndarray, h: int, w: int, k_max: int, restarts: int, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Centres of the number of clusters (0: one mean without a map) of the least description length, the smaller number of equal ones, and each pixel's."""
    best, least = (x.mean(axis=0)[None], np.zeros(len(x), dtype=int)), (kernels.clustering_bits(x, np.zeros(len(x), dtype=int), np.zeros((0, 3)), h, w), 0)
    starts = kernels.seedings(x, range(1, k_max + 1), restarts, lambda k: np.random.default_rng([int(photo) & 0x7FFFFFFF, k]))
    for k, centres, of, _ in kernels.clusterings(x, starts, rounds):
        if (bits := (kernels.clustering_bits(x, of, centres, h, w), k)) < least:
            best, least = (centres, of), bits
    return best


def least_centres(photo: int, x: np.ndarray, h: int, w: int, k_max: int, restarts: int, rounds: int) -> np.ndarray:
    return least_clusters(photo, x, h, w, k_max, restarts, rounds)[0]


def _segmented(k_max: int, restarts: int, rounds: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        photo, h, w = key[0].as_py(), table.column("h")[0].as_py(), table.column("w")[0].as_py()
        at = (table.column("cl").to_numpy() - 1) * h + table.column("rw").to_numpy() - 1  # column by column
        x = np.zeros((h * w, 3))
        for i, c in enumerate("luv"):
            x[at, i] = table.column(c).to_numpy()
        centres, of = least_clusters(photo, x, h, w, k_max, restarts, rounds)
        r, c = np.mgrid[1 : h + 1, 1 : w + 1]
        full = lambda v, kind: pa.array(np.full(h * w, v), kind)
        columns = [full(photo, pa.int64()), full(h, pa.int32()), full(w, pa.int32()), pa.array(r.ravel(), pa.int32()), pa.array(c.ravel(), pa.int32()), pa.array(kernels.components(of.reshape(w, h).T).ravel(), pa.int64()), full(len(centres), pa.int32())]
        return pa.Table.from_arrays(columns, names=[f.split()[0] for f in SEGMENTED.split(", ")])

    return run


def segmented(luv: DataFrame, k_max: int = 30, restarts: int = 3, rounds: int = 20) -> DataFrame:
    """photo_id, h, w, rw, cl, segment_id, clusters: every photo's search, assignment (the nearest centre, the first of equal ones) and components.

    A photo is one group: its pixels move once, whatever the numbers of clusters that are tried, and the search sees all of them.
    """
    dealt = luv.select("photo_id", "h", "w", "rw", "cl", "l", "u", "v").repartition(TASKS * tasks_of(luv.sparkSession), "photo_id")
    return dealt.groupBy("photo_id").applyInArrow(_segmented(k_max, restarts, rounds), SEGMENTED)


def table_clusters(px: DataFrame, k: int = 8, rounds: int = 50, steps: int = 5, restarts: int = 3, seed: int = 1) -> tuple[DataFrame, float]:
    """cluster_id, l, u, v, n: one clustering of the colours of all pixels of a table, and its within sum of squares.

    Equal colours are one row with a weight first. Seeds are oversampled in ``steps`` rounds of weighted candidates, which are
    clustered to k; the rounds after that are aggregates; the best of the restarts counts. Centres come in order of their lightness.
    """
    colours = LUV_PIXELS(px).groupBy("l", "u", "v").agg(F.count("*").cast("double").alias("n"))
    rows = written(colours, "colours").select(array_to_vector(F.array("l", "u", "v")).alias("features"), "n")
    fit = KMeans(k=k, maxIter=rounds, initMode="k-means||", initSteps=steps, weightCol="n")
    model = min((fit.setSeed(seed + i).fit(rows) for i in range(restarts)), key=lambda m: m.summary.trainingCost)
    centres = [[float(x) for x in c] for c in model.clusterCenters()]
    order = sorted(range(len(centres)), key=centres.__getitem__)
    sizes = model.transform(rows).groupBy("prediction").agg(F.sum("n").cast("long").alias("n"))
    names = px.sparkSession.createDataFrame([(old, new, *centres[old]) for new, old in enumerate(order, 1)], "prediction int, cluster_id int, l double, u double, v double")
    return names.join(sizes, "prediction", "left").select("cluster_id", "l", "u", "v", F.coalesce("n", F.lit(0)).alias("n")), float(model.summary.trainingCost)
