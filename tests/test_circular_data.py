import math

import pytest
from pyspark.sql import functions as F

from lumenframe.operators import circular_data as cd


def angles(spark, values, **terms):
    return cd.circular(spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "id int, x double"), "x", **terms)


def listed(df):
    return [r.x for r in df.orderBy("id").collect()]


def test_terms(spark):
    df = angles(spark, [-90, 0, 450], units="degrees", modulo="2pi", template="clock12")
    assert listed(df) == [270, 0, 90]
    assert cd.properties(df, "x") == ("angles", "degrees", "clock12", "2pi", math.pi / 2, "clock")
    assert cd.properties(df.where("id > 0").select("x", "id"), "x").units == "degrees"
    assert "rotation = clock" in cd.described(df, "x")
    assert cd.properties(df.select(F.col("id").cast("double").alias("x")), "x") == cd.Circular()
    for bad in ({"units": "turns"}, {"type": "axis"}, {"zero": float("nan")}, {"rotation": "left"}, {"modulo": "3pi"}, {"template": "clock"}):
        with pytest.raises(ValueError):
            angles(spark, [1], **bad)


def test_conversion(spark):
    deg = angles(spark, [0, 90, 350], units="degrees")
    assert listed(cd.conversion(deg, "x")) == pytest.approx([0, math.pi / 2, 350 * math.pi / 180])
    assert listed(cd.conversion(deg, "x", "hours")) == pytest.approx([0, 6, 350 / 15])
    compass = cd.conversion(deg, "x", "degrees", template="geographics", modulo="2pi")
    assert listed(compass) == pytest.approx([90, 0, 100]) and cd.properties(compass, "x").template == "geographics"
    back = cd.conversion(compass, "x", "degrees", zero=0.0, rotation="counter", modulo="2pi")
    assert listed(back) == pytest.approx([0, 90, 350]) and cd.properties(back, "x").template == "none"
    assert listed(cd.conversion(deg, "x", "degrees", type="directions")) == [0, 180, 700]
    assert listed(cd.conversion(cd.conversion(deg, "x", "degrees", type="directions"), "x", "degrees", type="directions", modulo="pi")) == [0, 0, 160]
    with pytest.raises(ValueError):
        cd.conversion(deg, "x", "degrees", modulo="4pi")


def test_concatenated(spark):
    a, b, c = angles(spark, [10], units="degrees", modulo="2pi"), angles(spark, [math.pi, -math.pi / 2]), angles(spark, [6], units="hours", template="clock24")
    out = cd.concatenated(a, b, c, column="x")
    assert sorted(r.x for r in out.collect()) == pytest.approx([0, 10, 180, 270])
    assert cd.properties(out, "x") == cd.properties(a, "x") and cd.concatenated(a, a.limit(0), column="x").count() == 1
