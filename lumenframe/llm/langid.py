"""Language identification by rank-order n-gram profiles and the out-of-place distance."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, id_join

#: N-grams of a profile, and labelled texts that each language's profile is made from at most.
PROFILE, SAMPLE = 300, 2000
UNKNOWN = "und"
#: Languages that a fit may have.
LANGUAGES = 1000
#: Groups of a language's ids that are cut to the sample's size before they meet.
SALTS = 64
#: Characters counted at once.
PIECE = 1 << 18

_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000))
    return _letters[0]


def _grams(codes: np.ndarray) -> np.ndarray:
    """The 1- to 3-grams of lower-case code points: within words, or with the blank before or after one."""
    x = np.where(letters()[codes], codes, 32).astype(np.int64)
    x = np.concatenate([[32], x, [32]])
    x = x[np.concatenate([[True], (x[1:] != 32) | (x[:-1] != 32)])]
    one = x[x != 32]
    two = (x[:-1] << 21) | x[1:]
    three = (x[:-2] << 42) | (x[1:-1] << 21) | x[2:]
    return np.concatenate([one, two, three[x[1:-1] != 32]])


def counted(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-grams of a whole text, ascending, and their counts; long texts are counted by pieces cut between words."""
    text = text.lower()
    if len(text) <= PIECE:
        return np.unique(_grams(np.frombuffer(text.encode("utf-32-le", "replace"), dtype=np.uint32)), return_counts=True)
    grams, counts, at = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), 0
    while at < len(text):
        to = min(len(text), at + PIECE)
        while to < len(text) and text[to].isalpha():
            to += 1
        g, c = np.unique(_grams(np.frombuffer(text[at:to].encode("utf-32-le", "replace"), dtype=np.uint32)), return_counts=True)
        both, where = np.unique(np.concatenate([grams, g]), return_inverse=True)
        grams, counts, at = both, np.bincount(where, np.concatenate([counts, c]), len(both)).astype(np.int64), to
    return grams, counts


def ranked(grams: np.ndarray, counts: np.ndarray, most: int = PROFILE) -> np.ndarray:
    """The most frequent n-grams, best first; ties by the n-gram."""
    if len(grams) > most:
        floor = np.partition(counts, len(counts) - most)[len(counts) - most]
        grams, counts = grams[counts >= floor], counts[counts >= floor]
    return grams[np.lexsort((grams, -counts))][:most]


def place(grams: np.ndarray, profiles: list[tuple[str, np.ndarray, np.ndarray]], most: int = PROFILE) -> tuple[str, float]:
    """The language of the least out-of-place distance, and 1 less that distance over the largest possible one.

    A profile is (language, its n-grams ascending, their ranks); an n-gram that it lacks is ``most`` out of place.
    """
    best, least = UNKNOWN, None
    ranks = np.arange(len(grams))
    for lang, known, rank in profiles:
        at = np.minimum(np.searchsorted(known, grams), len(known) - 1)
        far = np.where(known[at] == grams, np.abs(rank[at] - ranks), most).sum()
        if least is None or far < least:
            best, least = lang, far
    return (best, float(1 - least / (most * len(grams)))) if least is not None else (UNKNOWN, 0.0)


def fit(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", most: int = PROFILE, sample: int = SAMPLE) -> list[tuple[str, list[int]]]:
    """Profiles of the languages of labelled rows: the ``most`` n-grams of up to ``sample`` texts of each, those of the smallest hashed ids.

    The sample is chosen by ids alone, first in SALTS groups of each language and then of what these keep, so no
    task gets more than SALTS times ``sample`` ids of a language; its texts are then counted in tasks, and what
    reaches the driver is ``most`` n-grams for each language; more than LANGUAGES languages are an error.
    Rows with a null label, text or id are left out, and so are languages without a letter. Ids of equal hashes go by the
    id; rows that repeat an id of the sample are all counted. N-grams of equal counts go by the n-gram.
    """
    scratch = Scratch(docs.sparkSession, "langid")
    known = docs.where(train & docs[lang_col].isNotNull() & docs[id_col].isNotNull() & docs[text_col].isNotNull()).select(docs[id_col].alias("id"), docs[lang_col].cast("string").alias("lang"))
    for keys in (["lang", F.pmod(F.hash("id"), F.lit(SALTS))], ["lang"]):
        order = Window.partitionBy(*keys).orderBy(F.xxhash64("id"), "id")
        known = known.withColumn("r", F.row_number().over(order)).where(F.col("r") <= sample).drop("r")
    ids = scratch.save(known.select("id").distinct(), "sample")
    rows = docs.select(docs[id_col].alias("id"), docs[lang_col].cast("string").alias("lang"), docs[text_col].cast("string").alias("text"), train.alias("train")).where("train and lang is not null")
    rows = id_join(rows, ids, "id", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: dict[str, tuple[np.ndarray, np.ndarray]] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                g, c = counted(text or "")
                if lang in held:
                    g, where = np.unique(np.concatenate([held[lang][0], g]), return_inverse=True)
                    c = np.bincount(where, np.concatenate([held[lang][1], c]), len(g)).astype(np.int64)
                held[lang] = g, c
            for lang, (g, c) in held.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(g), pa.string()), pa.array(g), pa.array(c)], names=["lang", "gram", "n"])

    grams = rows.select("lang", "text").mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    top = grams.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).where(F.col("r") <= most)
    found = top.groupBy("lang").agg(F.collect_list(F.struct("r", "gram")).alias("grams")).limit(LANGUAGES + 1).collect()
    if len(found) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    return sorted((r.lang, [x.gram for x in sorted(r.grams)]) for r in found)


def predict(docs: DataFrame, profiles: list[tuple[str, list[int]]], text_col: str = "text", most: int = PROFILE, prefix: str = "lang_") -> DataFrame:
    """Add ``<prefix>pred`` and ``<prefix>score`` (0 to 1), from the whole text alone.

    Null text, and text without a letter, gives ``und`` and 0, as does a fit without languages; ties go to the
    language first in order. Columns of these two names are replaced, others pass through; rows, repeated ones as
    well, are judged one by one, and texts of any length whole. An empty table gives an empty one.
    """
    ready = [(lang, np.sort(np.array(g, dtype=np.int64)), np.argsort(np.array(g, dtype=np.int64))) for lang, g in profiles]
    text = docs[text_col].cast("string")

    @F.pandas_udf("struct<pred:string,score:double>")
    def judge(texts):
        import pandas as pd

        out = []
        for t in texts:
            grams = ranked(*counted(t), most) if t else np.zeros(0, dtype=np.int64)
            out.append(place(grams, ready, most) if len(grams) else (UNKNOWN, 0.0))
        return pd.DataFrame(out, columns=["pred", "score"])

    # not deterministic to the optimizer: a filter on its results would else judge every text twice
    return docs.withColumn(f"{prefix}__judged", judge.asNondeterministic()(text)).select(*[c for c in docs.columns if c not in (f"{prefix}pred", f"{prefix}score", f"{prefix}__judged")], F.col(f"{prefix}__judged.pred").alias(f"{prefix}pred"), F.col(f"{prefix}__judged.score").alias(f"{prefix}score"))
