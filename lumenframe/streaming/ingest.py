"""Photos that arrive as files: each is measured by itself, so the stream needs neither state nor watermarks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators import color
from ..sources import files


def measure_arrivals(spark: SparkSession, path: str, target: str, checkpoint: str, measure=color.exposure_contrast) -> StreamingQuery:
    """Write the measures of photos that arrive under ``path`` as Parquet, each batch to a folder of its own.

    A batch that is repeated after a failure overwrites its own folder, so no photo is counted twice.
    """

    def batch(df: DataFrame, epoch: int) -> None:
        paths = [r.path for r in df.select("path").collect()]  # file names of one trigger, bounded by maxFilesPerTrigger
        if paths:
            measure(files.read_images(spark, paths)).write.mode("overwrite").parquet(f"{target}/batch={epoch}")

    arrivals = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("maxFilesPerTrigger", 1000).load(path).select("path")
    return arrivals.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
