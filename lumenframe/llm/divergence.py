"""Source divergence audit: how the term frequencies of sources differ, by dense tiles of groups and blocks of terms."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch
from .terms import LETTERS, counts

#: Documents of a language that a term needs; what is added to every count; units of a frequency; ranks of a group's terms.
LEAST_DOCS, PRIOR, UNIT, RANKS = 30, 5, 1_000_000_000, 50
#: Terms of a block and groups of a side: a tile is at most twice GROUPS rows of about BLOCK frequencies.
BLOCK, GROUPS = 4096, 64
#: Counted terms that a task holds before it passes them on.
HELD = 200_000
#: The row of a language as a whole among those of its groups.
WHOLE = -1

COUNTED = "lang string, source string, term binary, n long, docs long"


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents of each term of each group, summed over what a task holds at a time."""
    held: dict[tuple, tuple[Counter, Counter]] = {}
    size = 0

    def rows() -> pa.RecordBatch:
        keys = [(lang, source, t, n, docs[t]) for (lang, source), (times, docs) in held.items() for t, n in times.items()]
        lang, source, term, n, d = zip(*keys, strict=True) if keys else ([],) * 5
        return pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(source, pa.string()), pa.array(term, pa.binary()), pa.array(n, pa.int64()), pa.array(d, pa.int64())], names=["lang", "source", "term", "n", "docs"])

    for batch in batches:
        for text, lang, source in zip(batch.column(0).cast(pa.binary()).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            times, docs = held.setdefault((lang, source), (Counter(), Counter()))
            found, before = counts(text, LETTERS), len(times)
            times.update(found)
            docs.update(found.keys())
            size += len(times) - before
            if size > HELD:
                yield rows()
                held.clear()
                size = 0
    yield rows()


def frequencies(n: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(UNIT * (n + PRIOR) / total), exactly, in 64 bits for totals below 9e15: long division by three digits of 1,000."""
    rest, out = n + PRIOR, np.zeros(np.broadcast_shapes(n.shape, total.shape), dtype=np.int64)
    whole, rest = np.divmod(rest, total)
    out += whole
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, total)
        out = out * 1000 + digit
    return out + 1


def _tile(ranks: int):
    """A tile's part of the pair matrix, and (on the diagonal) the best terms of its groups."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        lang, lo, hi, _ = (k.as_py() for k in key)
        group, term = table.column("g").to_numpy(), table.column("term")
        n, total = table.column("n").to_numpy(), table.column("total").to_numpy()
        heads = table.column("head").to_numpy(zero_copy_only=False)
        groups, row = np.unique(group, return_inverse=True)
        totals = np.zeros(len(groups), dtype=np.int64)
        totals[row[heads]] = total[heads]
        own = np.flatnonzero(~heads)
        codes = term.take(pa.array(own)).combine_chunks().dictionary_encode()
        words = codes.dictionary.to_pylist()
        tile = np.zeros((len(groups), len(words)), dtype=np.int64)
        tile[row[own], codes.indices.to_numpy()] = n[own]
        p = frequencies(tile, totals[:, None])
        side = groups // GROUPS
        a, b = np.flatnonzero((side == lo) & (groups != WHOLE)), np.flatnonzero((side == hi) & (groups != WHOLE))
        out: list[tuple] = []
        for i in a:  # all pairs of a group with the other side at once
            js = b[b > i] if lo == hi else b
            sums = np.abs(p[i][None, :] - p[js]).sum(axis=1)
            out += [(int(groups[i]), int(groups[j]), None, int(v)) for j, v in zip(js, sums, strict=True)]
        if lo == hi and len(words):
            q = p[np.flatnonzero(groups == WHOLE)[0]]
            name = np.empty(len(words), dtype=np.int64)
            name[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words))
            for i in a:
                gain = p[i] - q
                hit = np.flatnonzero((tile[i] > 0) & (gain > 0))
                best = hit[np.lexsort((name[hit], -gain[hit]))[:ranks]]
                out += [(int(groups[i]), None, words[k], int(gain[k])) for k in best]
        x, y, t, v = zip(*out, strict=True) if out else ([],) * 4
        return pa.table({"lang": pa.array([lang] * len(out), pa.string()), "g": pa.array(x, pa.int64()), "other": pa.array(y, pa.int64()), "term": pa.array(t, pa.binary()), "value": pa.array(v, pa.int64())})

    return run


def audit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_docs: int = LEAST_DOCS, ranks: int = RANKS) -> DataFrame:
    """lang, source, part, item, value, rank: how far sources of a language lie from each other, and by which terms.

    Null texts, languages and sources count as ''. A language keeps the terms of at least ``least_docs`` of its rows.
    A group is a source within a language; a kept term's frequency in it is in units of 1e-9, smoothed, and at least 1.
    Part ``pair``: every other source of the language, by the sum of the differences of all kept terms (0 if there are
    none). Part ``term``: the terms that a group holds more often than its language, by the difference, to ``ranks``.
    Ties go to the smaller item in order of UTF-8 bytes. Repeated rows count as often as they occur, texts of any
    length whole; other columns are not looked at; an empty table gives no rows.

    Counts are summed in tasks before they move. Tiles are the kept terms of a language, cut into blocks of about
    BLOCK by a hash, times one or two runs of GROUPS groups: a common term, a language or a source that holds a third of
    all rows is as many rows as any other. A tile returns sums for pairs of groups and ``ranks`` terms a group, which
    are then summed and merged.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "divergence")
    or_empty = lambda c: F.coalesce(docs[c].cast("string"), F.lit(""))
    named = docs.select(or_empty(text_col).alias("text"), or_empty(lang_col).alias("lang"), or_empty(source_col).alias("source"))
    counted = scratch.save(named.mapInArrow(_counted, COUNTED).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "counted")
    kept = scratch.save(counted.groupBy("lang", "term").agg(F.sum("n").alias("all"), F.sum("docs").alias("docs")).where(F.col("docs") >= least_docs).drop("docs"), "kept")
    langs = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("all").alias("all"))
    own = scratch.save(counted.join(kept, ["lang", "term"]).select("lang", "source", "term", "n"), "own")
    # every group there is, also without terms, numbered within its language in order of its name
    there = named.select("lang", "source").distinct().join(own.groupBy("lang", "source").agg(F.sum("n").alias("held")), ["lang", "source"], "left").join(langs.select("lang", "v"), "lang", "left")
    there = there.select("lang", "source", F.row_number().over(Window.partitionBy("lang").orderBy("source")).cast("long").alias("g"), (F.coalesce("held", F.lit(0)) + PRIOR * F.coalesce("v", F.lit(0))).alias("total"), F.coalesce("v", F.lit(0)).alias("v"))
    groups = scratch.save(there, "groups")
    blocks = F.ceil(F.col("v") / BLOCK).cast("long")
    blank = F.lit(None).cast("binary").alias("term")
    heads = groups.where("v > 0").select("lang", "g", "v", blank, F.lit(0).cast("long").alias("n"), "total", F.lit(True).alias("head"))
    wholes = langs.select("lang", F.lit(WHOLE).cast("long").alias("g"), "v", blank, F.lit(0).cast("long").alias("n"), (F.col("all") + PRIOR * F.col("v")).alias("total"), F.lit(True).alias("head"))
    rows = own.join(groups.select("lang", "source", "g", "v"), ["lang", "source"]).select("lang", "g", "v", "term", "n", F.lit(None).cast("long").alias("total"), F.lit(False).alias("head"))
    sums = kept.join(langs.select("lang", "v"), "lang").select("lang", F.lit(WHOLE).cast("long").alias("g"), "v", "term", F.col("all").alias("n"), F.lit(None).cast("long").alias("total"), F.lit(False).alias("head"))
    cells = heads.union(wholes).union(rows).union(sums)
    # heads go to every block of terms, counts to the block of their term
    every = F.sequence(F.lit(0).cast("long"), blocks - 1)
    cells = cells.withColumn("block", F.explode(F.when(F.col("head"), every).otherwise(F.array(F.pmod(F.xxhash64("term"), blocks)))))
    # each run of groups meets every run; a language as a whole, with all of its kept terms, goes to every tile
    runs = groups.groupBy("lang").agg(F.floor(F.max("g") / GROUPS).cast("long").alias("last"))
    run = F.floor(F.col("g") / GROUPS).cast("long")
    other = F.sequence(F.lit(0).cast("long"), F.col("last"))
    all_ = F.flatten(F.transform(other, lambda x: F.transform(F.sequence(x, F.col("last")), lambda y: F.struct(x.alias("lo"), y.alias("hi")))))
    met = F.when(F.col("g") == WHOLE, all_).otherwise(F.transform(other, lambda x: F.struct(F.least(run, x).alias("lo"), F.greatest(run, x).alias("hi"))))
    cells = cells.join(runs, "lang").select("lang", "g", "term", "n", "total", "head", "block", F.explode(met).alias("t")).select("lang", "t.lo", "t.hi", "block", "g", "term", "n", "total", "head")
    found = scratch.save(cells.groupBy("lang", "lo", "hi", "block").applyInArrow(_tile(ranks), "lang string, g long, other long, term binary, value long"), "found")
    pairs = found.where("other is not null").groupBy("lang", "g", "other").agg(F.sum("value").alias("value"))
    mirrored = pairs.select("lang", F.explode(F.array(F.struct("g", "other"), F.struct(F.col("other").alias("g"), F.col("g").alias("other")))).alias("p"), "value").select("lang", "p.g", "p.other", "value")
    name = lambda g, out: groups.select("lang", F.col("g").alias(g), F.col("source").alias(out))
    pair_rows = mirrored.join(name("g", "source"), ["lang", "g"]).join(name("other", "item"), ["lang", "other"]).select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    none = groups.where("v = 0")  # languages without a kept term: all sums are 0
    none = none.select("lang", "source").join(none.select("lang", F.col("source").alias("item")), "lang").where("source <> item").select("lang", "source", F.lit("pair").alias("part"), "item", F.lit(0).cast("long").alias("value"))
    term_rows = found.where("term is not null").join(name("g", "source"), ["lang", "g"]).select("lang", "source", F.lit("term").alias("part"), F.col("term").cast("string").alias("item"), "value")
    place = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    ranked = lambda df: df.withColumn("rank", place)
    return ranked(pair_rows.union(none)).union(ranked(term_rows).where(F.col("rank") <= ranks))
