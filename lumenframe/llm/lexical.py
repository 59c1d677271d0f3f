"""Ranked lexical search: dual-sorted wavelet trees per shard, searched best first for the exact top k."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch
from .terms import LETTERS_AND_DIGITS, counts

#: Documents and postings of a shard (a shard ends with whichever comes first).
SHARD, POSTINGS = 16384, 1 << 20
#: Occurrences of terms of the queries that are searched together; their terms are known to every task.
TOGETHER = 200_000
#: Cells (nodes times terms) that are opened at once.
AT_ONCE = 1 << 15
#: Documents that are added to a shard at once.
BATCH = 256

COUNTED = "doc_id long, n long, terms array<int>, tf array<long>"
FOUND = "q long, doc_id long, score long"


def impact(w: np.ndarray, tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What a term of weight w adds to a document: w * ((1e9 tf) div (1000 tf + 12 m)), in 64 bits for tf below 9e9."""
    return w * ((1_000_000_000 * tf) // (1000 * tf + 12 * m))


class Shard:
    """Postings of some documents: each term's run ordered by impact, and a wavelet tree over the documents' places.

    The runs of all terms make one sequence of places (in ascending order of ids). Level by level it is dealt into
    zeros and ones by the places' bits, keeping the order, so at every node (a range of places) a term's run is one
    interval, still by descending impact: its first posting bounds what the term can add to any document of the node.
    """

    def __init__(self, ids: np.ndarray, place: np.ndarray, term: np.ndarray, value: np.ndarray, n_terms: int) -> None:
        self.ids = ids
        order = np.lexsort((place, -value, term))
        place, term, value = place[order], term[order], value[order]
        self.start = np.searchsorted(term, np.arange(n_terms + 1))
        self.levels = max(1, int(len(ids) - 1).bit_length())
        size = len(place)
        words = size // 64 + 1
        self.bits, self.before = np.zeros((self.levels, words), dtype=np.uint64), np.zeros((self.levels, words), dtype=np.int64)
        self.zeros, self.value = np.zeros(self.levels, dtype=np.int64), np.zeros((self.levels + 1, size + 1), dtype=np.int64)
        self.value[0, :size] = value
        for level in range(self.levels):
            ones = (place >> (self.levels - 1 - level)) & 1
            padded = np.zeros(words * 64, dtype=np.uint8)
            padded[:size] = ones
            self.bits[level] = np.packbits(padded, bitorder="little").view(np.uint64)
            self.before[level, 1:] = np.cumsum(np.bitwise_count(self.bits[level]))[:-1]
            self.zeros[level] = size - int(ones.sum())
            deal = np.argsort(ones, kind="stable")
            place, value = place[deal], value[deal]
            self.value[level + 1, :size] = value

    def ones(self, level: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How many of the first ``at`` bits of a level are set."""
        word, bit = at >> 6, (at & 63).astype(np.uint64)
        return self.before[level, word] + np.bitwise_count(self.bits[level, word] & ((np.uint64(1) << bit) - np.uint64(1)))

    def top(self, terms: np.ndarray, times: np.ndarray, k: int, scores: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The k best of the given (scores, docs; best first) and this shard's documents, for terms that occur ``times``."""
        here = self.start[terms] < self.start[terms + 1]
        terms, times = terms[here], times[here]
        if not len(terms):
            return scores, docs
        level, low = np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64)
        s, e = self.start[terms][None, :], self.start[terms + 1][None, :]
        bound = self._bound(level, s, e, times)
        step = max(1, AT_ONCE // len(terms))
        while len(bound):
            if len(scores) == k:  # equal scores go to smaller ids, and the ids of a node are no smaller than its first
                open_ = (bound > scores[-1]) | ((bound == scores[-1]) & (self.ids[low] < docs[-1]))
                bound, level, low, s, e = bound[open_], level[open_], low[open_], s[open_], e[open_]
                if not len(bound):
                    break
            best = np.argpartition(-bound, step - 1)[:step] if len(bound) > step else np.arange(len(bound))
            rest = np.ones(len(bound), dtype=bool)
            rest[best] = False
            lv, lo, ss, ee = level[best], low[best], s[best], e[best]
            s1, e1 = self.ones(lv[:, None], ss), self.ones(lv[:, None], ee)
            z = self.zeros[lv][:, None]
            half = np.int64(1) << (self.levels - 1 - lv)
            lo = np.concatenate([lo, lo + half])
            ss, ee = np.concatenate([ss - s1, z + s1]), np.concatenate([ee - e1, z + e1])
            lv = np.concatenate([lv, lv]) + 1
            new = self._bound(lv, ss, ee, times)
            some = new > 0
            lv, lo, ss, ee, new = lv[some], lo[some], ss[some], ee[some], new[some]
            leaf = lv == self.levels  # one document: its bound is its score
            if leaf.any():
                scores, docs = merged(np.concatenate([scores, new[leaf]]), np.concatenate([docs, self.ids[lo[leaf]]]), k)
            inner = ~leaf
            bound, level, low = np.concatenate([bound[rest], new[inner]]), np.concatenate([level[rest], lv[inner]]), np.concatenate([low[rest], lo[inner]])
            s, e = np.concatenate([s[rest], ss[inner]]), np.concatenate([e[rest], ee[inner]])
        return scores, docs

    def _bound(self, level: np.ndarray, s: np.ndarray, e: np.ndarray, times: np.ndarray) -> np.ndarray:
        return np.where(s < e, self.value[level[:, None], s], 0) @ times


def merged(scores: np.ndarray, docs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    best = np.lexsort((docs, -scores))[:k]
    return scores[best], docs[best]


def _counts(vocabulary: dict[bytes, int]):
    """doc_id, number of terms, and the queries' terms with their counts, a row for each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, terms, tf = [], [], []
            for text in batch.column(1).cast(pa.binary()).to_pylist():
                found = counts(text, LETTERS_AND_DIGITS)
                own = [(t, c) for word, c in found.items() if (t := vocabulary.get(word)) is not None]
                n.append(found.total())
                terms.append([t for t, _ in own])
                tf.append([c for _, c in own])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(tf, pa.list_(pa.int64()))], names=["doc_id", "n", "terms", "tf"])

    return run


def _searched(weights: np.ndarray, n_docs: int, n_terms: int, queries: list[tuple[int, np.ndarray, np.ndarray]], k: int):
    """The k best documents of a task for each query: shard by shard, each starting from the best so far."""

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[Shard]:
        held: list[tuple[np.ndarray, ...]] = []
        docs = postings = 0
        for batch in (b.slice(at, BATCH) for b in batches for at in range(0, b.num_rows, BATCH)):
            ids, n, terms, tf = batch.columns
            sizes = pc.list_value_length(terms).to_numpy().astype(np.int64)
            held.append((ids.to_numpy(), n.to_numpy(), sizes, terms.flatten().to_numpy(), tf.flatten().to_numpy()))
            docs, postings = docs + len(sizes), postings + int(sizes.sum())
            if docs >= SHARD or postings >= POSTINGS:
                yield built(held)
                held, docs, postings = [], 0, 0
        if docs:
            yield built(held)

    def built(held: list[tuple[np.ndarray, ...]]) -> Shard:
        ids, n, sizes, terms, tf = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.argsort(ids, kind="stable")
        place = np.empty(len(ids), dtype=np.int64)
        place[order] = np.arange(len(ids))
        doc = np.repeat(np.arange(len(ids)), sizes)
        m = 75 + (25 * n * n_docs) // n_terms
        value = impact(weights[terms], tf, m[doc])
        some = value > 0
        return Shard(ids[order], place[doc][some], terms[some].astype(np.int64), value[some], len(weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, dtype=np.int64)
        best = {q: (none, none) for q, _, _ in queries}
        for shard in shards(batches):
            for q, terms, times in queries:
                best[q] = shard.top(terms, times, k, *best[q])
        for q, (scores, docs) in best.items():
            if len(scores):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(scores), q)), pa.array(docs), pa.array(scores)], names=["q", "doc_id", "score"])

    return run


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [counts(t, LETTERS_AND_DIGITS) for t in batch.column(1).cast(pa.binary()).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([list(c) for c in found], pa.list_(pa.binary())), pa.array([list(c.values()) for c in found], pa.list_(pa.int64()))], names=["q", "terms", "times"])


def search(docs: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "doc_id", text_col: str = "text", query_id: str = "item_id", query_text: str = "text", together: int = TOGETHER) -> DataFrame:
    """query_id, rank (from 1), doc_id, score: the k documents of highest score above 0 for each query, exactly.

    Equal scores go to the smaller doc_id. Null and empty texts have no terms: such documents are never found, such
    queries find nothing. A row without doc_id counts in the statistics and is never returned; repeated rows are
    documents of their own. Equal rows of queries are one query; equal ids with different texts are ranked apart. Texts
    of any length count whole; other columns are not looked at; empty tables give no rows.

    Documents are counted once, and their counts of the queries' terms written; shards are runs of that table, so nothing
    is grouped by a term or a document and nothing moves but k rows for each query and task. Queries go in runs of about
    ``together`` terms (a longer query is a run of its own), whose terms every task knows; each run reads the documents.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "lexical")
    asked = queries.select(queries[query_id].alias("item"), queries[query_text].cast("string").alias("text")).where("item is not null and text is not null").distinct()
    asked = scratch.save(asked.select(F.monotonically_increasing_id().alias("q"), "item", "text"), "asked")
    terms = scratch.save(asked.select("q", "text").mapInArrow(_asked, "q long, terms array<binary>, times array<long>").where(F.size("terms") > 0), "terms")
    total = terms.agg(F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()[0]
    runs = max(1, -(-2 * total // together)) if total > together else 1
    texts = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    found = None
    for r in range(runs):
        own = [(row.q, row.terms, row.times) for row in terms.where(F.pmod(F.xxhash64("q"), F.lit(runs)) == r).toLocalIterator()]
        words = sorted({bytes(t) for _, ts, _ in own for t in ts})
        vocabulary = {t: i for i, t in enumerate(words)}
        counted = scratch.save(texts.mapInArrow(_counts(vocabulary), COUNTED), f"counted{r}")
        n_docs, n_terms = counted.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
        if not words or not n_terms:
            continue
        df = counted.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("df"))
        weight = F.floor(1000 * F.log((F.lit(2.0) * n_docs + 2) / (2 * F.col("df") + 1)))
        weights = np.zeros(len(words), dtype=np.int64)
        for t, w in df.select("t", weight.alias("w")).toLocalIterator():
            weights[t] = w
        prepared = [(q, np.array([vocabulary[bytes(t)] for t in ts], dtype=np.int64), np.array(times, dtype=np.int64)) for q, ts, times in own]
        part = counted.where("doc_id is not null and size(terms) > 0").mapInArrow(_searched(weights, n_docs, n_terms, prepared, k), FOUND)
        found = part if found is None else found.union(part)
    if found is None:
        found = spark.createDataFrame([], FOUND)
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "doc_id"))
    best = found.withColumn("rank", place).where(F.col("rank") <= k)
    return best.join(asked.select("q", "item"), "q").select(F.col("item").alias(query_id), "rank", "doc_id", "score")
