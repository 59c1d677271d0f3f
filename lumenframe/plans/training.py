"""From a folder of photos to the table of their measures, in batches that can be taken up again."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import files
from ..sources.store import dropped, there
from . import model

#: Photos of a batch.
BATCH = 1000
#: The measures of photos that failed.
SCHEMA = "photo_id long, " + ", ".join(f"{c} double" for c in model.RECORD) + ", error string"


def photos_in(spark: SparkSession, folder: str) -> DataFrame:
    """path, photo_id of the JPG and PNG files of a folder; of files with one number the first path counts. No content is read."""
    found = spark.read.format("binaryFile").load(folder).select("path").where("lower(path) rlike '[.](jpg|jpeg|png)$'")
    named = found.select("path", F.regexp_extract("path", r"([^/.]+)[^/]*$", 1).try_cast("long").alias("photo_id"))
    return named.where("photo_id is not null").groupBy("photo_id").agg(F.min("path").alias("path"))


def measured(spark: SparkSession, target: str) -> DataFrame:
    """What the finished batches under ``target`` hold."""
    names = _batches(spark, target)
    return spark.read.schema(SCHEMA).parquet(*names) if names else spark.createDataFrame([], SCHEMA)


def _batches(spark: SparkSession, target: str) -> list[str]:
    root = spark._jvm.org.apache.hadoop.fs.Path(f"{target}/batches")
    store = root.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [s.getPath().toString() for s in store.listStatus(root)] if store.exists(root) else []
    return sorted(p for p in found if there(spark, p))


def train(spark: SparkSession, folder: str, target: str, batch: int = BATCH, measure: Callable[[DataFrame], DataFrame] = model.measure_record) -> DataFrame:
    """Measure the photos of ``folder`` that ``target`` does not have yet; returns and writes all measures so far (``target``/measures, a ``;`` table).

    A batch is a table under a name of its own that counts once it is finished, so a run that was broken off goes on where
    it stopped, and photos that arrive later are measured by the next run. A batch that fails is halved until the
    photos at fault are alone: they get a row with the ``error`` and no measures, as do files that hold no picture.
    """
    todo = photos_in(spark, folder).join(measured(spark, target).select("photo_id"), "photo_id", "left_anti")
    groups = max(1, -(-todo.count() // batch))
    grouped = todo.withColumn("group", F.pmod(F.xxhash64("photo_id"), F.lit(groups)))
    for g in range(groups):
        own = [(r.photo_id, r.path) for r in grouped.where(F.col("group") == g).select("photo_id", "path").collect()]  # names of about one batch
        _measure(spark, sorted(own), f"{target}/batches", measure)
    all_ = measured(spark, target)
    files.write_measures(all_.drop("error").orderBy("photo_id"), f"{target}/measures")
    return all_


def _measure(spark: SparkSession, photos: list[tuple[int, str]], folder: str, measure: Callable[[DataFrame], DataFrame]) -> None:
    if not photos:
        return
    path, ids = f"{folder}/{uuid.uuid4().hex}", spark.createDataFrame(photos, "photo_id long, path string").select("photo_id")
    try:
        rows = measure(files.read_images(spark, [p for _, p in photos]))
        rows = ids.join(rows.select("photo_id", *[F.col(c).cast("double").alias(c) for c in rows.columns[1:]], F.lit(True).alias("read")), "photo_id", "left")
        rows = rows.withColumn("error", F.when(F.col("read").isNull(), "no picture")).drop("read")
        _finish(rows, path)
    except Exception as x:  # whatever a photo makes fail
        dropped(spark, path)
        if len(photos) > 1:
            half = len(photos) // 2
            _measure(spark, photos[:half], folder, measure)
            _measure(spark, photos[half:], folder, measure)
        else:
            _finish(ids.withColumn("error", F.lit(str(x).strip().split("\n")[0][:500])), path)


def _finish(rows: DataFrame, path: str) -> None:
    """All columns of SCHEMA, null where a measure is not there."""
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    kinds = dict(c.split() for c in SCHEMA.split(", "))
    rows.select(*[(F.col(n) if n in rows.columns else F.lit(None)).cast(kinds[n]).alias(n) for n in names]).write.parquet(path)
