"""Connected components of a graph of any size, hubs included."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.store import dropped, saved, shared_dir

#: What belongs to a key of more rows than this comes by a broadcast; to others by a shuffle on the key.
HUB = 1_000_000


def keyed(rows: DataFrame, few: DataFrame, on: str, hub: int = HUB) -> DataFrame:
    """``rows`` with the columns of ``few``, which has one row for each value of ``on`` and in ``n`` how many of ``rows`` have it.

    No task reads more than ``hub`` rows of one value: of the commoner ones there are at most the rows over ``hub``,
    so what belongs to them is broadcast, the rest shuffled. ``n`` is left out.
    """
    many, rest = few.where(F.col("n") > hub).drop("n"), rows
    if many.take(1):
        rest = rows.join(F.broadcast(many.select(on)), on, "left_anti")
    found = rest.join(few.where(F.col("n") <= hub).drop("n").hint("merge"), on)
    return found if rest is rows else found.union(rows.join(F.broadcast(many), on).select(found.columns))


def components(edges: DataFrame, hub: int = HUB) -> DataFrame:
    """Smallest node reachable for every node of ``edges`` (a, b): columns node, label.

    Alternating large-star and small-star rounds: each keeps at most one row per edge, and the number of rounds grows
    with the log of the diameter; they go on until nothing changes. Minima are partial before they move; edges get
    theirs back by node, those of hubs by a broadcast, so that no task meets more than ``hub`` edges of one. Loops and repeated
    edges do not matter; a null end makes an edge of nothing. Every round is a written table, the one before goes.
    """
    spark = edges.sparkSession
    root = f"{shared_dir(spark)}/components-{uuid.uuid4().hex}"
    save = lambda df, name: saved(df, f"{root}/{name}")
    both = lambda e: e.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.*")
    state = lambda e: e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a"))).first()
    plain = lambda df, name: df
    with_minimum = lambda e, low, n: keyed(e, low, "a", hub) if 2 * n > hub else e.join(low.drop("n"), "a")
    cur = save(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges-0")
    before, i = state(cur), 0
    while before[0]:
        i += 1
        step = plain if 2 * before[0] <= hub else lambda df, name: save(df, f"{name}-{i}")  # minima are only kept where there may be hubs
        # large star: larger neighbours of each node go to the smallest of its neighbourhood
        e = both(cur)
        low = step(e.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("n")), "low")
        large = step(with_minimum(e.where("b > a"), low, before[0]).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct(), "large")
        # small star: smaller neighbours of each node and the node itself go to the smallest of them
        low = step(large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")), "least")
        small = with_minimum(large, low, before[0]).select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct()
        cur = save(small, f"edges-{i}")
        after = state(cur)
        for name in (f"edges-{i - 1}", f"low-{i}", f"large-{i}", f"least-{i}"):
            dropped(spark, f"{root}/{name}")
        if after == before:
            break
        before = after
    found = cur.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("label"))
    return found.union(found.select(F.col("label").alias("node"), "label").distinct())
