"""Photos, ratings and measures as files; links scraped from pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RATING_SCHEMA = "Index int, Photo bigint, Num int, Rating double, " + ", ".join(f"Num{i} int" for i in range(1, 11))


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """The pixel relation of the JPG and PNG files of a directory; photo_id is the number before the first dot; files without one are left out.

    Spark's image source gives rows of BGR (or grey, or BGRA) bytes; grey counts for all three channels, and
    an alpha channel is only allowed where it is opaque.
    """
    img = spark.read.format("image").option("dropInvalid", True).load(path).select("image.*").where("lower(origin) rlike '[.](jpg|jpeg|png)$'")
    img = img.select(F.regexp_extract("origin", r"([^/.]+)[^/]*$", 1).try_cast("long").alias("photo_id"), F.col("height").alias("h"), F.col("width").alias("w"), F.col("nChannels").alias("ch"), "data").where("photo_id is not null")
    at = lambda k: F.conv(F.hex(F.substring("data", F.col("i") * F.col("ch") + 1 + k, 1)), 16, 10).cast("int")
    img = img.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("h") * F.col("w") - 1)))
    img = img.withColumns({"rw": (F.floor(F.col("i") / F.col("w")) + 1).cast("int"), "cl": (F.col("i") % F.col("w") + 1).cast("int"), "b8": at(0), "g8": F.when(F.col("ch") == 1, at(0)).otherwise(at(1)), "r8": F.when(F.col("ch") == 1, at(0)).otherwise(at(2))})
    img = img.where(F.when(F.col("ch") == 4, F.assert_true(at(3) == 255, F.lit("an alpha channel must be opaque")).isNull()).otherwise(True))
    return img.select("photo_id", "h", "w", "rw", "cl", "r8", "g8", "b8", *[(F.col(f"{c}8") / 255.0).alias(c) for c in "rgb"])


def read_ratings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep=" ", header=True, schema=RATING_SCHEMA)


def read_measures(spark: SparkSession, path: str) -> DataFrame:
    """Measures by the names in the header; Photo is an integer, all others are numbers, so nothing is inferred from the rows."""
    rows = spark.read.csv(path, sep=";", header=True, nullValue="NA")
    return rows.select(*[F.col(f"`{c}`").cast("bigint" if c.lower() in ("photo", "photo_id") else "double").alias(c) for c in rows.columns])


def write_measures(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("sep", ";").option("header", True).option("nullValue", "NA").option("quoteAll", False).csv(path)


def scrape(pages: DataFrame, pattern: str = 'href="([^"]*)"', group: int = 1, within: str | None = None) -> DataFrame:
    """Links of pages; with ``within`` only those that match it, such as an image's number and suffix."""
    links = F.regexp_extract_all("html", F.lit(pattern), F.lit(group))
    links = links if within is None else F.filter(links, lambda x: x.rlike(within))
    return pages.select("page_id", F.explode(links).alias("link"))


SCRAPE_SQL = """select page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) as link from pages"""
