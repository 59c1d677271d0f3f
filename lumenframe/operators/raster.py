"""Rasters as arrays: rows of pixels gathered for a photo, flattened row by row, cut into rows again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rasters(px: DataFrame, channel: str = "r8") -> DataFrame:
    """photo_id, h, w, raster: a channel as an array of rows. A photo's values meet in one row, so it has to fit a task."""
    row = F.transform(F.array_sort(F.collect_list(F.struct("cl", F.col(channel).alias("v")))), lambda x: x.v)
    rows = px.groupBy("photo_id", "h", "w", "rw").agg(row.alias("r"))
    return rows.groupBy("photo_id", "h", "w").agg(F.transform(F.array_sort(F.collect_list(F.struct("rw", "r"))), lambda x: x.r).alias("raster"))


def flat(raster: Column) -> Column:
    """The rows one after another."""
    return F.flatten(raster)


def shaped(values: Column, width: Column) -> Column:
    """Rows of ``width`` values; an error where their number is no multiple of it."""
    rows = F.transform(F.sequence(F.lit(1), (F.size(values) / width).cast("int")), lambda i: F.slice(values, (i - 1) * width + 1, width))
    none = F.array().cast("array<array<int>>")
    return F.when(F.size(values) % width != 0, F.raise_error(F.concat(F.lit("values not divisible by the width: "), F.size(values).cast("string")))).when(F.size(values) == 0, none).otherwise(rows)


def floats(raster: Column) -> Column:
    """Values as floats."""
    return F.transform(raster, lambda row: F.transform(row, lambda v: v.cast("float")))


def unsigned(raster: Column) -> Column:
    """Signed bytes as integers of 0 to 255."""
    return F.transform(raster, lambda row: F.transform(row, lambda v: v.cast("int").bitwiseAND(F.lit(255))))
