"""Measures joined with ratings: fills, correlations, error metrics, linear and random-forest models, the measure record."""

from __future__ import annotations

import math
from functools import reduce

from pyspark import StorageLevel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import LinearRegression, RandomForestRegressor
from pyspark.ml.stat import Correlation
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import color, hulls, segments, stencil
from ..operators.base import SqlOp
from ..operators.circular import CELLS, TwoLevel, in_cells
from ..operators.color import HSV, LUM
from ..sources.store import written

#: A few measures a photo, the first the id.
MEASURES = f"""
select photo_id as photo, avg(val) as intensity, avg(sat) as saturation, avg(hue) as hue, 4 * avg({LUM}) * (1 - avg({LUM})) as exposure, stddev_samp({LUM}) as contrast, max(h) + max(w) as size
from ({HSV}) group by photo_id"""

ratings_join = SqlOp(f"select m.photo, round(intensity, 6) as intensity, round(saturation, 6) as saturation, round(hue, 5) as hue, round(exposure, 6) as exposure, round(contrast, 6) as contrast, r.num, round(r.rating, 6) as rating from ({MEASURES}) m join {{ratings}} r on m.photo = r.photo where r.rating > 0")
_NUMS = [f"num{i}" for i in range(1, 11)]
_SPREAD = f"sqrt(({' + '.join(f'{n} * pow({i} - rating, 2)' for i, n in enumerate(_NUMS, 1))}) / (num - 1))"
rating_stdev = SqlOp(f"select photo, num, round(rating, 6) as rating, round({_SPREAD}, 6) as sd from {{ratings}} where num > 1")
_BLOCK = "10 * (least(cast(floor((rw - 1) * 3e0 / h) as int), 2) + 1) + least(cast(floor((cl - 1) * 3e0 / w) as int), 2) + 1"
#: Grey pixels have no hue, and no place (a block of 3 by 3) among those that have one: 0, and the middle block.
fill_missing = SqlOp(f"select photo_id, rw, cl, round(coalesce(hue, 0e0), 5) as hue, coalesce(case when hue is not null then {_BLOCK} end, 22) as position from ({HSV})")
correlations = SqlOp(f"""
select round(corr(rating, intensity), 6) as intensity, round(corr(rating, saturation), 6) as saturation, round(corr(rating, exposure), 6) as exposure, round(corr(rating, contrast), 6) as contrast, round(corr(intensity, contrast), 6) as intensity_contrast, count(*) as n
from ({MEASURES}) m join {{ratings}} r on m.photo = r.photo""")
simple_regressions = SqlOp(f"select round(regr_slope(rating, intensity), 5) as slope_intensity, round(regr_intercept(rating, intensity), 5) as at_intensity, round(regr_slope(rating, contrast), 5) as slope_contrast, round(regr_intercept(rating, contrast), 5) as at_contrast from ({MEASURES}) m join {{ratings}} r on m.photo = r.photo")
bw_color_split = SqlOp(f"select photo_id, case when count(hue) = 0 or avg(case when rw between floor(h / 3e0) and ceil(2 * h / 3e0) then sat end) < 1e-5 then 'bw' else 'colour' end as kind, count(*) - count(hue) as grey_pixels from ({HSV}) group by photo_id")
_POINT = "select {0} as k, max(case when m0 <= floor({0} * (mn - 1)) and floor({0} * (mn - 1)) < m0 + m then x end) as a, max(case when m0 <= ceil({0} * (mn - 1)) and ceil({0} * (mn - 1)) < m0 + m then x end) as b, max({0} * (mn - 1) - floor({0} * (mn - 1))) as part from ranked"


_OF_ERRORS = "select e / sd as x, abs(e) as size, abs(e / sd) as relative from {0} e"
_POINTS = f"select 0 as g, x, count(*) as m, lo, hi from ({_OF_ERRORS.format('{errors}')}) r cross join (select min(e / sd) as lo, max(e / sd) as hi from {{errors}} e2) ends where x is not null group by x, lo, hi"
_IN_CELLS = f"case when hi > lo then cast(floor((x - lo) / (hi - lo) * {CELLS}) as int) else 0 end"
_METRICS = f"""
with {in_cells(_POINTS, "m", "x", _IN_CELLS)},
low as ({_POINT.format("0.025e0")}), high as ({_POINT.format("0.975e0")}), sizes as (select avg(size) as a, avg(relative) as r from ({_OF_ERRORS.format('{errors}')}) r3)
select round(sizes.a, 6) as mean_abs, round(sizes.r, 6) as mean_relative, round(low.a + low.part * (low.b - low.a), 6) as low, round(high.a + high.part * (high.b - high.a), 6) as high from sizes cross join low cross join high"""


class Errors(TwoLevel):
    """Mean error of rows (e, sd), absolute and in deviations, and its central 95 %.

    On Spark the errors are a table first, and the percentiles are found in cells of equal width.
    """

    def __init__(self, errors: str) -> None:
        super().__init__(f"select round(avg(size), 6) as mean_abs, round(avg(relative), 6) as mean_relative, round(percentile(x, 0.025), 6) as low, round(percentile(x, 0.975), 6) as high from ({_OF_ERRORS.format(f'({errors})')}) r", _METRICS)
        self.errors = SqlOp(errors)

    def __call__(self, *frames: DataFrame, **params: float) -> DataFrame:
        return self.plan(written(self.errors(*frames), "errors"))


error_metrics = Errors(f"select rating - (select avg(rating) from {{ratings}}) as e, {_SPREAD} as sd from {{ratings}} where num > 1")
#: The same of the line through contrast and rating.
prediction_errors = Errors(f"""
select rating - (slope * contrast + base) as e, {_SPREAD} as sd from {{ratings}} r join ({MEASURES}) m on m.photo = r.photo
cross join (select regr_slope(rating, contrast) as slope, regr_intercept(rating, contrast) as base from {{ratings}} r1 join ({MEASURES}) m1 on m1.photo = r1.photo) line where num > 1""")
_SHUFFLED = "select 0 as g, cast(photo * 7919 % 104729 as bigint) * 1000000000000 + photo as o, photo, 1 as m from {ratings}"
#: A share of the photos in an order fixed by hashes of their ids; on Spark the order is counted in cells of the hash.
split = TwoLevel("select photo, row_number() over (order by photo * 7919 % 104729, photo) <= floor(:share * count(*) over ()) as train from {ratings}",
    f"with {in_cells(_SHUFFLED, 'm', 'o', f'cast(floor(o / 1000000000000 * {CELLS} / 104729) as int)')} select o % 1000000000000 as photo, m0 + 1 <= floor(:share * mn) as train from ranked", share=0.6)

FEATURES = ["intensity", "saturation", "hue", "exposure", "contrast"]


def _prepared(px: DataFrame, ratings: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=FEATURES, outputCol="features").transform(ratings_join(px, ratings).fillna(0.0, FEATURES))


def linear_model(px: DataFrame, ratings: DataFrame) -> DataFrame:
    """photo, rating, prediction of a linear model over all photos."""
    data = _prepared(px, ratings)
    model = LinearRegression(featuresCol="features", labelCol="rating", solver="normal", regParam=1e-6).fit(data)
    return model.transform(data).select("photo", "rating", "prediction")


def random_forest(px: DataFrame, ratings: DataFrame, share: float = 0.6, trees: int = 20, seed: int = 1) -> DataFrame:
    """photo, rating, prediction for the photos that a random forest was not trained on."""
    data = _prepared(px, ratings).join(split(ratings, share=share), "photo")
    model = RandomForestRegressor(featuresCol="features", labelCol="rating", numTrees=trees, seed=seed).fit(data.where("train"))
    return model.transform(data.where("not train")).select("photo", "rating", "prediction")


def _wide(df: DataFrame, values: dict[str, str], suffix: str) -> DataFrame:
    """Channel rows as columns <value><Channel><suffix>."""
    names = {"hue": "Hue", "sat": "Sat", "val": "Val"}
    return df.groupBy("photo_id").agg(*[F.max(F.when(F.col("channel") == c, F.col(v))).alias(f"{out.format(n)}{suffix}") for v, out in values.items() for c, n in names.items()])


def measure_record(px: DataFrame, k_max: int = 30, restarts: int = 3) -> DataFrame:
    """One row of 71 measures a photo: aggregates of its pixels, neighbourhoods and segments, brought together by photo_id.

    The pixels, their segments and wavelet levels are read by several measures, so each is a table first. So are the measures
    themselves: a plan of all at once, with its joins and broadcasts, is more than a driver should hold.
    """
    px = written(px, "pixels")
    seg = written(segments.segmentation(px, k_max, restarts), "segments")
    top, place = segments.top5_segments(seg, px), segments.segment_positions(seg)
    dealt = px.repartition("photo_id")  # for measures of many windows, which need no other shuffle then
    texture, depth = stencil.wavelets(dealt)
    pivoted = lambda names: [F.max(F.when(F.col("place") == i, F.col(c))).alias(f"{n}{i}") for c, n in names.items() for i in range(1, 6)]
    looks = pivoted({"hue": "AvgHuePatch", "sat": "AvgSatPatch", "val": "AvgValPatch", "share": "RelSizePatch"})
    places = pivoted({"position": "PositionPatch", "distance": "DistanceFromCenterPatch"})
    parts = [
        stencil.blur_annoyance(dealt).withColumnRenamed("quality", "Blur"),
        stencil.edge_widths(dealt).toDF("photo_id", "MdweBlur", "MdweGaussian", "MdweJpeg2k"),
        color.simple_measures(px),
        segments.colorfulness(color.bucket_counts(px)).toDF("photo_id", "Colorfulness"),
        segments.colorfulness(color.bucket_counts(px, n=6), "grey", 6).toDF("photo_id", "ColorfulnessGrey"),
        _wide(texture, {"level1": "Texture{}Level1", "level2": "Texture{}Level2", "level3": "Texture{}Level3", "total": "Texture{}Sum"}, ""),
        _wide(depth, {"dof": "DepthOfField{}"}, ""),
        top.groupBy("photo_id").agg(F.sum(F.col("large").cast("int")).alias("NumLargePatches"), *looks),
        place.groupBy("photo_id").agg(*places),
        seg.groupBy("photo_id").agg(F.max("clusters").alias("NumClusters")),
        hulls.convexity(seg).toDF("photo_id", "ShapeConvexity"),
        color.dominant_hue(px).toDF("photo_id", "DdcMean", "DdcCompactness", "DdcDominance"),
        segments.spread(color.dominant_pixels(px)).toDF("photo_id", "DdcSpatial", "DdcNormSpatial"),
    ]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [written(part, "measures") for part in parts], px.select("photo_id").distinct())
    return rows.groupBy("photo_id").agg(*[F.max(c).alias(c) for c in RECORD])


_PATCHES = [f"{n}{i}" for n in ("AvgHuePatch", "AvgSatPatch", "AvgValPatch", "RelSizePatch", "PositionPatch", "DistanceFromCenterPatch") for i in range(1, 6)]
#: The measures in order.
RECORD = [
    "Blur", "MdweBlur", "MdweGaussian", "MdweJpeg2k", "Exposure", "RmsContrast", "IntervalContrast", "AverageIntensity", "AverageSaturation", "AverageHue", "AverageCentralIntensity", "AverageCentralSaturation", "AverageCentralHue",
    "Colorfulness", "ColorfulnessGrey", *[f"Texture{c}{x}" for x in ("Level1", "Level2", "Level3", "Sum") for c in ("Hue", "Sat", "Val")], *[f"DepthOfField{c}" for c in ("Hue", "Sat", "Val")],
    "SizeFeature", "AspectRatio", "AspectRatioMax", "NumLargePatches", "NumClusters", *_PATCHES, "ShapeConvexity", "DdcMean", "DdcCompactness", "DdcDominance", "DdcSpatial", "DdcNormSpatial",
]


#: What stands for a patch that a photo does not have: no hue, saturation, value, size or distance, and the position of the centre.
FILLS = {"AvgHuePatch": 0.0, "AvgSatPatch": 0.0, "AvgValPatch": 0.0, "RelSizePatch": 0.0, "PositionPatch": 22.0, "DistanceFromCenterPatch": 0.0}
#: Measures that only photos with colours have, by the beginnings of their names.
OF_DOMINANT = ("Ddc",)
OF_COLOUR = (*OF_DOMINANT, "AverageSaturation", "AverageHue", "AverageCentralHue", "AverageCentralSaturation", "TextureHue", "TextureSat", "AvgHuePatch", "AvgSatPatch", "DepthOfFieldHue", "DepthOfFieldSat")


def rated(record: DataFrame, ratings: DataFrame) -> DataFrame:
    """The measure record with the photos' ratings, the measures of absent patches filled, and ``bw`` for photos without a dominant hue or saturation."""
    fills = {c: v for c in record.columns for head, v in FILLS.items() if c.startswith(head)}
    none = F.col("DdcCompactness").isNull() | F.isnan("DdcCompactness") | (F.col("DdcCompactness") < 1e-5) | (F.col("DdcCompactness") == math.inf) | (F.col("AverageCentralSaturation") < 1e-5)
    measures = [F.col(c).cast("double").alias(c) for c in record.columns if c != "photo_id"]
    return record.select(F.col("photo_id").alias("photo"), *measures).fillna(fills).withColumn("bw", F.coalesce(none, F.lit(False))).join(ratings, "photo")


def measures_of(rows: DataFrame, kind: str) -> list[str]:
    """The measures of a model: ``all`` photos have neither hues nor saturations nor a dominant hue, ``bw`` neither; ``colour`` photos have every one."""
    known = [c for c in rows.columns[1 : rows.columns.index("bw")]]
    return known if kind == "colour" else [c for c in known if not c.startswith(OF_COLOUR)]


def _of_kind(rows: DataFrame, kind: str) -> DataFrame:
    return {"all": rows, "colour": rows.where("not bw"), "bw": rows.where("bw")}[kind]


def _finite(c: str):
    return F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < math.inf)


def _features(rows: DataFrame, names: list[str]) -> DataFrame:
    """The rows whose measures are all present, with their vector; a measure that no row has is left out."""
    have = rows.agg(*[F.count_if(_finite(c)).alias(c) for c in names]).first() if names else {}
    names = [c for c in names if have[c]]
    whole = reduce(lambda a, b: a & b, map(_finite, names), F.lit(True))
    return rows.where(whole).withColumn("features", array_to_vector(F.array(*[F.col(c) for c in names]).cast("array<double>")))


def correlation_matrix(rows: DataFrame, kind: str = "all") -> DataFrame:
    """Correlations of the rating and every measure with each other over photos of a kind (all, colour, bw): a, b, r, long format.

    They are null with a measure that is null for some photo, or equal for all (but 1 with itself), and from fewer than two photos. ``all`` photos have
    all measures but those of the dominant hue, ``colour`` photos have those too, ``bw`` photos have the measures of brightness.
    """
    names = [c for c in measures_of(rows, "bw" if kind == "bw" else "colour") if kind != "all" or not c.startswith(OF_DOMINANT)]
    rows, names = _of_kind(rows, kind), ["rating", *names]
    seen = rows.agg(F.count("*").alias("n_rows"), *[F.count_if(_finite(c)).alias(c) for c in names]).first()
    known = [c for c in names if seen[c] == seen["n_rows"] > 1]
    found = {}
    if known:
        vectors = rows.select(array_to_vector(F.array(*[F.col(c) for c in known]).cast("array<double>")).alias("features"))
        matrix = Correlation.corr(vectors, "features").first()[0].toArray()
        found = {(a, b): float(matrix[i, j]) for i, a in enumerate(known) for j, b in enumerate(known) if not math.isnan(matrix[i, j])}
    return rows.sparkSession.createDataFrame([(a, b, found.get((a, b))) for a in names for b in names], "a string, b string, r double")


def rating_model(rows: DataFrame, kind: str = "all") -> DataFrame:
    """photo, rating, prediction of a linear model of all measures of a kind of photos (all, colour, bw).

    Photos without one of the measures are left out; no photo, no row.
    """
    data = _features(_of_kind(rows, kind), measures_of(rows, kind)).select("photo", "rating", "features")
    if not data.take(1):
        return rows.sparkSession.createDataFrame([], "photo long, rating double, prediction double")
    model = LinearRegression(featuresCol="features", labelCol="rating", solver="normal", regParam=1e-6).fit(data)
    return model.transform(data).select("photo", "rating", "prediction")


def _uniform(*key):
    return (F.pmod(F.xxhash64(*key), F.lit(1 << 40)) + 0.5) / float(1 << 40)


def model_report(rows: DataFrame, share: float = 0.6, trees: int = 100, seed: int = 1) -> DataFrame:
    """One row on a random forest of all measures, fitted to a share of the rated colour photos, and judged on the rest.

    forest_corr: rating and prediction; reference_corr: rating and one draw from the photo's own normal distribution of ratings
    (what another person might say); chance_corr: a random target and a linear model of as many random variables, over the photos
    it was fitted to (what overfitting alone may explain); then the mean deviation of ratings, the mean error, absolute and in
    deviations, and its central 95 %. Draws are hashes of photo and seed. Figures are null where too few photos are left.
    """
    names = measures_of(rows, "colour")
    data = _features(rows.where("not bw and rating > 0"), names)
    data = data.withColumn("draw", _uniform("photo", F.lit(seed))).withColumn("sd", F.expr(f"case when num > 1 then {_SPREAD} end")).persist(StorageLevel.MEMORY_AND_DISK)
    train, test = data.where(F.col("draw") < share), data.where(F.col("draw") >= share)
    if not train.take(1) or not test.take(1):
        none = "forest_corr reference_corr mean_sd mean_abs mean_relative low high chance_corr".split()
        return rows.sparkSession.createDataFrame([(0, 0, *[None] * len(none))], "n_train long, n_test long, " + ", ".join(f"{c} double" for c in none))
    forest = RandomForestRegressor(featuresCol="features", labelCol="rating", numTrees=trees, seed=seed).fit(train.select("rating", "features"))
    normal = F.sqrt(-2 * F.log(_uniform("photo", F.lit("radius"), F.lit(seed)))) * F.cos(2 * math.pi * _uniform("photo", F.lit("angle"), F.lit(seed)))
    judged = forest.transform(test).select("rating", "prediction", "sd", (F.col("rating") + F.col("sd") * normal).alias("reference"), (F.col("prediction") - F.col("rating")).alias("error"))
    relative = F.col("error") / F.when(F.col("sd") > 0, F.col("sd"))
    report = judged.agg(
        F.lit(train.count()).alias("n_train"), F.count("*").alias("n_test"), F.corr("rating", "prediction").alias("forest_corr"), F.corr("rating", "reference").alias("reference_corr"), F.avg("sd").alias("mean_sd"),
        F.avg(F.abs("error")).alias("mean_abs"), F.avg(F.abs(relative)).alias("mean_relative"), F.percentile_approx(relative, F.lit(0.025), 100_000).alias("low"), F.percentile_approx(relative, F.lit(0.975), 100_000).alias("high"),
    )
    random = test.select(_uniform("photo", F.lit("target"), F.lit(seed)).alias("target"), array_to_vector(F.array(*[_uniform("photo", F.lit(c), F.lit(seed)) for c in names])).alias("features"))
    chance = LinearRegression(featuresCol="features", labelCol="target", solver="normal", regParam=1e-6).fit(random).transform(random)
    return report.crossJoin(chance.agg(F.corr("target", "prediction").alias("chance_corr")))
