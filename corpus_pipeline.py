"""The corpus pipeline: language ID, near-duplicates, secrets, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as Parquet and reads it back
as the next one's documents. All stages but the last return the columns of documents (COLUMNS) and leave out others, whatever
their names; an empty table gives an empty one; texts of any length count whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.llm import jaccard, langid, packing, queries, secrets
from lumenframe.llm.common import Scratch, id_join

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A text is rejected if its nearest language is no nearer than this (1: the profile itself).
LEAST_SCORE = 0.2


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without a language go, and those unlike all of them; ``lang`` becomes what the text says.

    Null and empty texts, and those without a letter, have no language; without any labelled text all rows go. Other columns may
    be null; repeated rows are judged one by one.
    """
    profiles = langid.fit(docs, F.lit(True))
    judged = langid.predict(docs, profiles)
    kept = judged.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("lang_score") >= LEAST_SCORE))
    return kept.withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by 5-word shingles (similarity 0.8 or more) the one of the smallest id stays.

    Rows are told apart by their ids: rows that repeat an id stay or go together. Rows without an id or a word are linked with nothing and stay.
    """
    found = jaccard.join(docs, n=5, num=80, den=100)
    others = found.where(F.col("doc_id") != F.col("component_id")).select("doc_id")
    others = Scratch(spark, "duplicates").save(others.distinct(), "ids")
    return id_join(docs, others, "doc_id", "left_anti").select(*COLUMNS)


def no_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; documents stay, null and empty texts as they are (with a null or 0 ``n_chars``)."""
    return secrets.redact(docs).withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose sources, languages and topics have their target shares of the tokens.

    Null sources, languages and topics (of null and empty texts) are a category that keeps its share; rows that repeat an id stay or go together.
    """
    return queries.mixed(docs).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 4,096 tokens, a row for each piece.

    Null texts count as empty: their one token, the end, is packed as well. Repeated rows, and rows without an id, are packed each.
    """
    return packing.pack(docs).drop("ids")


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("no_secrets", no_secrets), ("mixture", mixture), ("packed", packed)]

#: Out-of-place distances, similarity joins and a tokenizer are beyond SQL: tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return docs
