"""Views of the star-schema tables as photos, grey rasters, angles and ratings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.base import SqlOp
from ..operators.circular import TwoLevel

_PX = """
with o as (
  select l_suppkey as photo_id,
    row_number() over (partition by l_suppkey order by l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice,
      l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) - 1 as k,
    count(*) over (partition by l_suppkey) as n,
    cast(l_quantity as int) as q, cast(round(l_discount * 100) as int) as i, cast(round(l_tax * 100) as int) as t
  from {lineitem}),
p as (
  select photo_id, cast(floor(n / 16e0) as int) as h, 16 as w, cast(floor(k / 16e0) as int) + 1 as rw, cast(k % 16 as int) + 1 as cl,
    cast(floor((q - 1) * 255 / 49e0) as int) as r8, cast(floor(i * 255 / 10e0) as int) as g8, cast(floor(t * 255 / 8e0) as int) as b8
  from o where k < 16 * cast(floor(n / 16e0) as int))
select *, r8 / 255e0 as r, g8 / 255e0 as g, b8 / 255e0 as b from p
"""
#: On Spark the rows are dealt by the photo itself, so that what is made of a photo needs no other shuffle.
PX = TwoLevel(_PX, """
with o as (
  select photo_id,
    row_number() over (partition by photo_id order by l_orderkey, l_partkey, l_linenumber, l_quantity, l_extendedprice,
      l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) - 1 as k,
    count(*) over (partition by photo_id) as n,
    cast(l_quantity as int) as q, cast(round(l_discount * 100) as int) as i, cast(round(l_tax * 100) as int) as t
  from (select *, l_suppkey as photo_id from {lineitem})),
p as (
  select photo_id, cast(floor(n / 16e0) as int) as h, 16 as w, cast(floor(k / 16e0) as int) + 1 as rw, cast(k % 16 as int) + 1 as cl,
    cast(floor((q - 1) * 255 / 49e0) as int) as r8, cast(floor(i * 255 / 10e0) as int) as g8, cast(floor(t * 255 / 8e0) as int) as b8
  from o where k < 16 * cast(floor(n / 16e0) as int))
select *, r8 / 255e0 as r, g8 / 255e0 as g, b8 / 255e0 as b from p
""")

ANGLES = SqlOp("""
select event_id, user_id, event_type, 2 * pi() * (3600 * extract(hour from ts) + 60 * extract(minute from ts) + floor(extract(second from ts))) / 86400e0 as theta from {events}
""")

RATINGS = SqlOp("""
select l_suppkey as photo, count(*) as num, avg(s) as rating,
  sum(case when s = 1 then 1 else 0 end) as num1, sum(case when s = 2 then 1 else 0 end) as num2, sum(case when s = 3 then 1 else 0 end) as num3,
  sum(case when s = 4 then 1 else 0 end) as num4, sum(case when s = 5 then 1 else 0 end) as num5, sum(case when s = 6 then 1 else 0 end) as num6,
  sum(case when s = 7 then 1 else 0 end) as num7, sum(case when s = 8 then 1 else 0 end) as num8, sum(case when s = 9 then 1 else 0 end) as num9,
  sum(case when s = 10 then 1 else 0 end) as num10
from (select l_suppkey, cast(ceil(l_quantity / 5e0) as int) as s from {lineitem}) group by l_suppkey
""")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def px(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixel relation: photo_id, h, w, rw, cl (from 1), 8-bit and [0, 1] channels."""
    return PX(read(spark, sf_dir, "lineitem"))


def angles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ANGLES(read(spark, sf_dir, "events"))


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return RATINGS(read(spark, sf_dir, "lineitem"))


def _inline(op: SqlOp) -> str:
    return op.raw.replace("{lineitem}", "lineitem").replace("{events}", "events")


#: The same views for the oracle engine.
ANSI = {"px": _inline(PX), "angles": _inline(ANGLES), "ratings": _inline(RATINGS), "pages": "select * from pages", "lineitem": "select * from lineitem"}
# a view that is named like a table must not shadow it while it is being defined
ANSI["pages"] = "select * from main.pages"
ANSI["lineitem"] = "select * from main.lineitem"
