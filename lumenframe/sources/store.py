"""Tables written on the way: in the folder that the driver and all executors share."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a temporary folder only where that is unset and the master local."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-lumen-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def saved(df: DataFrame, path: str) -> DataFrame:
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows from a table written now, under a name of its own: it cuts the lineage and outlives executors."""
    return saved(df, f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}")


#: Tasks of a dealt-out table, at most.
MOST_TASKS = 100_000


def tasks_of(spark: SparkSession) -> int:
    """Tasks for dear groups of few bytes: named, so that they are not merged for being small."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def spread_out(rows: DataFrame, each: int, *by: str) -> DataFrame:
    """Rows that are small but dear, written, counted and dealt to tasks of about ``each`` of them."""
    kept = written(rows, "rows")
    tasks = min(MOST_TASKS, max(1, -(-kept.count() // each)))
    return kept.repartition(tasks, *by) if by else kept.repartition(tasks)


def _file(spark: SparkSession, path: str):
    of = spark._jvm.org.apache.hadoop.fs.Path(path)
    return of.getFileSystem(spark._jsc.hadoopConfiguration()), of


def dropped(spark: SparkSession, path: str) -> None:
    """Let go of a table that nothing reads any more."""
    store, of = _file(spark, path)
    store.delete(of, True)


def there(spark: SparkSession, path: str) -> bool:
    """Whether a table was written to its end."""
    store, of = _file(spark, f"{path}/_SUCCESS")
    return store.exists(of)


def state(spark: SparkSession, paths: list[str]) -> str:
    """A digest of the files of an input: their paths, sizes and times."""
    lines = []
    for p in sorted(paths):
        store, of = _file(spark, p)
        s = store.getFileStatus(of)
        lines.append(f"{p} {s.getLen()} {s.getModificationTime()}")
    return hashlib.sha256("\n".join(lines).encode()).hexdigest()[:32]


def once(spark: SparkSession, name: str, inputs: DataFrame, make: Callable[[], DataFrame]) -> DataFrame:
    """The table ``name`` of the files behind ``inputs``: written by this application once, then read back.

    Its name holds a digest of those files, so that other or changed files have a table of their own; a table that was
    not finished is written again. The shared folder belongs to the application: whoever set it clears it.
    """
    path = f"{shared_dir(spark)}/{name}-{spark.sparkContext.applicationId}-{state(spark, inputs.inputFiles())}"
    return spark.read.parquet(path) if there(spark, path) else saved(make(), path)
