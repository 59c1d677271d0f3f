"""What the text operators share: scratch tables, bounded broadcasts."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.store import shared_dir

#: Rows of (long) ids that may be broadcast; beyond it the same join is shuffled.
BROADCAST_ROWS = 500_000


class Scratch:
    """Intermediate tables of one operator call, as Parquet in the shared folder.

    A written table cuts the lineage and survives the loss of executors. What the result still reads stays there: the
    folder belongs to the application, and whoever set it clears it when the results have been read.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def id_join(df: DataFrame, ids: DataFrame, on: str | list[str], how: str, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Join ``df`` with a (written) table of ids: broadcast while its counted rows stay within ``limit``, else shuffled."""
    small = ids.limit(limit + 1).count() <= limit
    return df.join(F.broadcast(ids) if small else ids.hint("merge"), on, how)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
