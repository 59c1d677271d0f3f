"""Every query of the library by name: what it reads, and the operator it applies."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import search, vonmises
from ..operators import circular, circular_data, clusters, color, draws, hulls, raster, segments, stencil, tiles
from ..operators.base import SqlOp
from ..sources import files, tables
from ..sources.store import once, written
from . import model

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
READERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {"px": tables.px, "angles": tables.angles, "ratings": tables.ratings, "pages": lambda s, d: tables.read(s, d, "pages"), "lineitem": lambda s, d: tables.read(s, d, "lineitem")}


def register(name: str, op: SqlOp, views: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] | None = None, **params: float) -> None:
    """A query of an SQL operator over named views, and the same statement for the oracle engine."""
    views = views or {}
    readers = [views[i][0] if i in views else READERS[i] for i in op.inputs]
    QUERIES[name] = lambda spark, sf_dir: op(*[r(spark, sf_dir) for r in readers], **params)
    SQL[name] = op.ansi({i: views[i][1] if i in views else tables.ANSI[i] for i in op.inputs}, **params)


for _module, _names in (
    (color, "exposure_contrast hsv_pixels rgb_roundtrip xyz_pixels xyz_plain xyy_pixels luv_pixels bright_rgb rescaled luminosity channel_math argb_pack hsv_averages hsv_central_averages size_aspect color_buckets dominant_hue hue_histogram"),
    (stencil, "mean_blur gaussian_blur adjust_blur sharp_blur_amount sobel_edges blur_annoyance local_extrema otsu edge_midpoints mdwe wavelet_texture wavelet_dof"),
):
    for _name in _names.split():
        register(_name, getattr(_module, _name))


def _view(text: str) -> tuple[Callable[[SparkSession, str], DataFrame], str]:
    """A view over the angles, for both engines."""
    op = SqlOp(text)
    return (lambda spark, sf_dir: op(*[READERS[i](spark, sf_dir) for i in op.inputs])), op.ansi({i: tables.ANSI[i] for i in op.inputs})


_BY_TYPE = {"a": _view("select event_type as g, theta as x from {angles}")}
_BY_USER = {"a": _view("select user_id as g, theta as x from {angles}")}
for _name in "circ_summary circ_disp trig_moment est_kappa vm_ml circ_range kuiper watson_uniform watson_uniform_test rao_spacing rao_homogeneity rose_bins edf".split():
    register(_name, getattr(circular, _name), _BY_TYPE)
register("rayleigh", circular.rayleigh, _BY_USER)
register("trig_moment_centred", circular.trig_moment, _BY_TYPE, p=1, center=1)
register("circ_cor", circular.circ_cor, {"pairs": _view("select event_type as g, theta as x, (theta * 3 + user_id) % 6e0 as y from {angles}")})
_TWO = {"two": _view("select case when event_type = (select min(event_type) from {angles}) then 1 else 2 end as side, theta as x from {angles}")}
for _name in ("watson_two", "watson_two_test"):
    register(_name, getattr(circular, _name), _TWO)
register("change_point", circular.change_point, {"ordered": _view("select event_type as g, theta as x, event_id as o from {angles}")})
register("circular_convert", circular.circular_convert, {"points": _view("select event_id as id, theta as x from {angles}")})
register("circular_densities", circular.circular_densities, {"points": _view("select event_id as id, theta as x from {angles}")})
register("bessel_ratio", circular.bessel_ratio, {"kappas": _view("select distinct (user_id % 40) / 4e0 + 0.05e0 as k from {angles}")})

# angles in other terms: what they are given as, and what is asked for
_TERMS: dict[str, tuple[dict, dict]] = {
    "compass": ({}, {"units": "degrees", "template": "geographics", "modulo": "2pi"}),
    "clock": ({}, {"units": "hours", "template": "clock24", "modulo": "2pi"}),
    "half": ({"units": "degrees"}, {"units": "degrees", "modulo": "pi", "rotation": "clock"}),
    "doubled": ({"units": "hours"}, {"units": "radians", "type": "directions", "modulo": "2pi"}),
    "from_compass": ({"units": "degrees", "template": "geographics"}, {"units": "radians", "zero": 0.0, "rotation": "counter"}),
    "shifted": ({"units": "hours", "zero": 1.0, "rotation": "clock"}, {"units": "degrees", "zero": -0.5, "rotation": "counter", "modulo": "2pi"}),
    "asis": ({"units": "degrees", "modulo": "pi"}, {"units": "hours", "modulo": "asis"}),
}


def _in_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = READERS["angles"](spark, sf_dir).selectExpr("event_id as id", *[f"theta as {n}" for n in _TERMS])
    for name, (have, want) in _TERMS.items():
        out = circular_data.conversion(circular_data.circular(out, name, **have), name, **want)
    return out.select("id", *[F.round(n, 6).alias(n) for n in _TERMS])


def _in_terms_sql(name: str) -> str:
    have, want = (dict(x) for x in _TERMS[name])
    means = circular_data.Circular(**have).templated()
    return circular_data.converted(circular_data._within("theta", means.units, means.modulo), means, **want)[0]


QUERIES["circular_terms"] = _in_terms
SQL["circular_terms"] = f"select event_id as id, {', '.join(f'round({_in_terms_sql(n)}, 6) as {n}' for n in _TERMS)} from ({tables.ANSI['angles']}) a"
_MET = ({"units": "degrees", "modulo": "2pi"}, {}, {"units": "hours", "template": "clock24"})


def _concatenated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Degrees, radians and hours of a clock in one column, in the terms of the first."""
    a = READERS["angles"](spark, sf_dir)
    values = ("degrees(theta)", "theta * 3", "theta * 12 / pi()")
    each = [circular_data.circular(a.where(f"event_id % 3 = {i}").selectExpr("event_id as id", f"{v} as x"), "x", **t) for i, (v, t) in enumerate(zip(values, _MET, strict=True))]
    out = circular_data.concatenated(*each, column="x")
    return out.select("id", F.round("x", 6).alias("x"))


QUERIES["circular_concat"] = _concatenated
SQL["circular_concat"] = f"""
with a as ({tables.ANSI['angles']})
select event_id as id, round(case event_id % 3 when 0 then (degrees(theta) % 360e0 + 360e0) % 360e0 when 1 then (degrees(theta * 3) % 360e0 + 360e0) % 360e0
  else ((-(theta * 180 / pi() - 90e0)) % 360e0 + 360e0) % 360e0 end, 6) as x from a"""


# clusters by fixed centres, and what is made of their components
_CLUSTERS = SqlOp(segments.CLUSTERS)


def _clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _CLUSTERS(tables.px(spark, sf_dir))


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.components(_clusters(spark, sf_dir))


_SEGMENTS_SQL = segments.COMPONENTS_SQL.format(px=tables.ANSI["px"]).replace("segments as materialized", "segs as materialized") + " select * from segs"
_SEGMENTS = {"segments": (_segments, _SEGMENTS_SQL)}
for _name in "nearest_center reconstruct clustering_mdl_terms elias_delta hull_inside line_distance".split():
    register(_name, getattr(segments, _name))
for _name in "bounding_boxes segment_positions top5_segments hull_area".split():
    register(_name, getattr(segments, _name), _SEGMENTS)
QUERIES["components"] = lambda spark, sf_dir: _segments(spark, sf_dir).select("photo_id", "rw", "cl", "segment_id")
SQL["components"] = f"select photo_id, rw, cl, segment_id from ({_SEGMENTS_SQL})"
QUERIES["dominant_hue_dispersion"] = lambda spark, sf_dir: segments.dispersion(color.dominant_pixels(tables.px(spark, sf_dir)))
SQL["dominant_hue_dispersion"] = f"""
with d as ({color.dominant_pixels.ansi({"px": tables.ANSI["px"]})}),
shift as (select a.photo_id, a.rw - b.rw as dr, a.cl - b.cl as dc, count(*) as n from d a join d b on a.photo_id = b.photo_id group by 1, 2, 3)
select photo_id, round(sum(n * sqrt(dr * dr + dc * dc)) / sum(n), 6) as ds from shift group by photo_id"""
QUERIES["dominant_hue_spread"] = lambda spark, sf_dir: segments.spread(color.dominant_pixels(tables.px(spark, sf_dir)))
SQL["dominant_hue_spread"] = f"""
with d as ({color.dominant_pixels.ansi({"px": tables.ANSI["px"]})}),
shift as (select a.photo_id, a.rw - b.rw as dr, a.cl - b.cl as dc, count(*) as n from d a join d b on a.photo_id = b.photo_id group by 1, 2, 3),
sizes as (select distinct h, w from d),
places as (select h, w, unnest(range(h)) as r from sizes),
pairs as (select h, w, r, unnest(range(w)) as c from places),
grid as (select h, w, sum((case when r = 0 then 1 else 2 end) * (h - r) * (case when c = 0 then 1 else 2 end) * (w - c) * sqrt(r * r + c * c)) / pow(h * w, 2) as whole from pairs group by h, w),
ds as (select photo_id, sum(n * sqrt(dr * dr + dc * dc)) / sum(n) as ds from shift group by photo_id)
select ds.photo_id, round(ds, 6) as ds, round(least(1, ds / whole), 6) as norm_ds from ds join (select distinct photo_id, h, w from d) p on ds.photo_id = p.photo_id join grid on grid.h = p.h and grid.w = p.w"""
QUERIES["rle2d"] = lambda spark, sf_dir: segments.rle(_clusters(spark, sf_dir))
QUERIES["mdl_rle2d"] = lambda spark, sf_dir: segments.rle_bits(_clusters(spark, sf_dir))
QUERIES["colorfulness"] = lambda spark, sf_dir: segments.colorfulness(color.bucket_counts(tables.px(spark, sf_dir)))
QUERIES["colorfulness_grey"] = lambda spark, sf_dir: segments.colorfulness(color.bucket_counts(tables.px(spark, sf_dir), n=6), "grey", 6)
QUERIES["kmeanspp"] = lambda spark, sf_dir: segments.kmeanspp(tables.px(spark, sf_dir))
QUERIES["photo_segmentation"] = lambda spark, sf_dir: segments.segmentation(tables.px(spark, sf_dir)).select("photo_id", "rw", "cl", "segment_id", "clusters")


def _region_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels and segments are read twice, so both are tables first."""
    px = written(tables.px(spark, sf_dir), "pixels")
    return segments.top5_segments(written(segments.segmentation(px), "segments"), px)


QUERIES["region_composition"] = _region_composition

# ratings and models
for _name in "ratings_join rating_stdev fill_missing correlations simple_regressions bw_color_split error_metrics prediction_errors".split():
    register(_name, getattr(model, _name))
register("train_split", model.split)
QUERIES["linear_model"] = lambda spark, sf_dir: model.linear_model(tables.px(spark, sf_dir), tables.ratings(spark, sf_dir))
QUERIES["random_forest"] = lambda spark, sf_dir: model.random_forest(tables.px(spark, sf_dir), tables.ratings(spark, sf_dir))


def _record(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The measure record of the table's photos: written once, read by every model."""
    return once(spark, "measure_record", tables.read(spark, sf_dir, "lineitem"), lambda: model.measure_record(tables.px(spark, sf_dir)))


QUERIES["measure_record"] = _record


def _rated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model.rated(_record(spark, sf_dir), tables.ratings(spark, sf_dir))


QUERIES["rated_record"] = _rated
for _kind in ("all", "colour", "bw"):
    QUERIES[f"correlation_matrix_{_kind}"] = lambda spark, sf_dir, kind=_kind: model.correlation_matrix(_rated(spark, sf_dir), kind)
    QUERIES[f"rating_model_{_kind}"] = lambda spark, sf_dir, kind=_kind: model.rating_model(_rated(spark, sf_dir), kind)
QUERIES["model_report"] = lambda spark, sf_dir: model.model_report(_rated(spark, sf_dir))
QUERIES["scrape_links"] = lambda spark, sf_dir: files.scrape(tables.read(spark, sf_dir, "pages"))
SQL["scrape_links"] = files.SCRAPE_SQL



def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


def _normal_sql(z: str) -> str:
    """The normal distribution function by its series, for the oracle engine; beyond 6 deviations 0 or 1."""
    series = f"list_sum(list_transform(range(0, 120), lambda k: (case when k % 2 = 0 then 1 else -1 end) * exp((2 * k + 1) * ln(abs({z}) / sqrt(2e0)) - lgamma(k + 1)) / (2 * k + 1)))"
    return f"(case when {z} = 0 then 0.5e0 when abs({z}) > 6 then (case when {z} > 0 then 1e0 else 0e0 end) else 0.5e0 + sign({z}) * {series} / sqrt(pi()) end)"


# circular operators that SQL does not express, or not alone
_ANGLES_ID = _view("select event_id as id, event_type as g, theta as x from {angles}")[0]
QUERIES["vm_cdf"] = lambda spark, sf_dir: _ANGLES_ID(spark, sf_dir).select("id", vonmises.cdf_column(F.col("x"), 1.0, 2.5).alias("p"))
QUERIES["vm_quantile"] = lambda spark, sf_dir: _ANGLES_ID(spark, sf_dir).select("id", vonmises.quantile_column(F.col("x") / vonmises.TAU, 1.0, 2.5).alias("theta"))
QUERIES["v0_test"] = lambda spark, sf_dir: _rounded(vonmises.v0_test(_ANGLES_ID(spark, sf_dir), 1.0), "r0_bar", "p_value")
QUERIES["wrpcauchy_ml"] = lambda spark, sf_dir: vonmises.cauchy_ml(_ANGLES_ID(spark, sf_dir))
QUERIES["circ_range_test"] = lambda spark, sf_dir: vonmises.range_test(_BY_TYPE["a"][0](spark, sf_dir))
QUERIES["watson_vm"] = lambda spark, sf_dir: vonmises.watson_vm(_BY_TYPE["a"][0](spark, sf_dir))


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ANGLES_ID(spark, sf_dir).selectExpr("g", "x", "(x * 2 + id % 5) % 6.283185307179586D as y", "id")


QUERIES["circ_reg"] = lambda spark, sf_dir: vonmises.circular_regression(_pairs(spark, sf_dir))


def _reg_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vonmises.regression_fit(_pairs(spark, sf_dir), QUERIES["circ_reg"](spark, sf_dir))


QUERIES["circ_reg_fit"] = lambda spark, sf_dir: _rounded(_reg_fit(spark, sf_dir), "x", "y", "fitted", "residual")
QUERIES["circ_reg_residuals"] = lambda spark, sf_dir: _rounded(vonmises.residual_concentration(_reg_fit(spark, sf_dir)), "a_k", "kappa")
_SLOPES = ", ".join(f"(covar_samp({t}, {a}) * var_samp({b}) - covar_samp({t}, {b}) * covar_samp({a}, {b})) / (var_samp({a}) * var_samp({b}) - pow(covar_samp({a}, {b}), 2)) as {t}_{a}" for t in ("cy", "sy") for a, b in (("cx", "sx"), ("sx", "cx")))
_LINE = "{0}_m + {0}_cx * (cx - cx_m) + {0}_sx * (sx - sx_m)"
_TURN = "(({0}) % (2 * pi()) + 2 * pi()) % (2 * pi())"
_REG_FIT_SQL = f"""
with p as (select event_type as g, theta as x, (theta * 2 + event_id % 5) % 6.283185307179586e0 as y, event_id as id from ({tables.ANSI['angles']}) a),
t as (select *, cos(x) as cx, sin(x) as sx, cos(y) as cy, sin(y) as sy from p),
m as (select g, avg(cx) as cx_m, avg(sx) as sx_m, avg(cy) as cy_m, avg(sy) as sy_m, {_SLOPES} from t group by g),
f as (select t.g, x, y, id, {_TURN.format(f"atan2({_LINE.format('sy')}, {_LINE.format('cy')})")} as fitted from t join m using (g)),
fits as (select *, {_TURN.format('y - fitted')} as residual from f)"""
SQL["circ_reg_fit"] = f"{_REG_FIT_SQL} select g, round(x, 6) as x, round(y, 6) as y, id, round(fitted, 6) as fitted, round(residual, 6) as residual from fits"
SQL["circ_reg_residuals"] = f"{_REG_FIT_SQL} select g, round(a_k, 6) as a_k, round({circular.a1inv('a_k')}, 6) as kappa from (select g, avg(cos(residual)) as a_k from fits group by g) r"
SQL["v0_test"] = f"""
select g, round(r0_bar, 6) as r0_bar, round(1 - {_normal_sql('z')} + exp(-z * z / 2) / sqrt(2 * pi()) * ((3 * z - pow(z, 3)) / (16 * n) + (15 * z + 305 * pow(z, 3) - 125 * pow(z, 5) + 9 * pow(z, 7)) / (4608 * n * n)), 6) as p_value
from (select *, sqrt(2 * n) * r0_bar as z from (select event_type as g, count(*)::double as n, avg(cos(theta - 1)) as r0_bar from ({tables.ANSI['angles']}) a group by event_type) s) t"""
QUERIES["bootstrap_ci"] = lambda spark, sf_dir: vonmises.bootstrap(_ANGLES_ID(spark, sf_dir))
QUERIES["random_circular"] = lambda spark, sf_dir: vonmises.draws(_ANGLES_ID(spark, sf_dir).select("id"))

QUERIES["vm_mixed_cdf"] = lambda spark, sf_dir: _ANGLES_ID(spark, sf_dir).select("id", vonmises.mixed_cdf_column(F.col("x"), 1.0, 2.5, 4.0, 1.5, 0.6).alias("p"))
QUERIES["pp_data"] = lambda spark, sf_dir: vonmises.fitted(QUERIES["edf"](spark, sf_dir), QUERIES["circ_summary"](spark, sf_dir), QUERIES["vm_ml"](spark, sf_dir))
QUERIES["circ_cor_test"] = lambda spark, sf_dir: _rounded(vonmises.correlation_test(QUERIES["circ_cor"](spark, sf_dir)), "p_value")
SQL["circ_cor_test"] = f"select *, round(2 * (1 - {_normal_sql('abs(test_stat)')}), 6) as p_value from ({SQL['circ_cor']}) c"
QUERIES["rao_homogeneity_test"] = lambda spark, sf_dir: vonmises.homogeneity_test(QUERIES["rao_homogeneity"](spark, sf_dir))

for _name in "emboss emboss_full emboss_reach emboss_trimmed emboss_valid emboss_padded pad_replicate pad_number gaussian_blur_2d".split():
    register(_name, getattr(stencil, _name))
register("gaussian_blur_narrow", stencil.gaussian_blur_narrow)
register("interval_contrast_80", color.exposure_contrast, interval=0.8)
register("bessel_orders", circular.bessel_orders, {"kappas": _view("select distinct (user_id % 40) / 4e0 + 0.05e0 as k from {angles}")})
register("log_densities", circular.log_densities, {"points": _view("select event_id as id, theta as x from {angles}")})
register("hsv_radians", color.hsv_pixels, radians=1, max_value=255.0)
register("turns", segments.turns)
register("binomial", circular.binomial, {"numbers": _view("select distinct user_id % 41 as n, user_id * 7 % 23 as k from {angles}")})
register("rgb_roundtrip_radians", color.rgb_roundtrip, radians=1, na_hue=0.5)
register("bucket_rgb", color.bucket_rgb)
register("bucket_luv", color.luv_pixels, {"px": (lambda spark, sf_dir: color.bucket_midpoints(tables.px(spark, sf_dir)), color.bucket_midpoints.ansi({"px": tables.ANSI["px"]}))})


def _rasters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rasters flattened, cut into rows again, and as signed bytes turned into floats, each as text."""
    text = lambda row: F.array_join(F.transform(row, lambda v: v.cast("int").cast("string")), ",")
    by_row = lambda rows: F.array_join(F.transform(rows, text), ";")
    signed = F.transform("raster", lambda row: F.transform(row, lambda v: F.when(v > 127, v - 256).otherwise(v).cast("byte")))
    out = raster.rasters(tables.px(spark, sf_dir)).withColumn("line", raster.flat(F.col("raster")))
    return out.select("photo_id", text("line").alias("flat"), by_row(raster.shaped(F.col("line"), F.col("w"))).alias("rows"), by_row(raster.floats(raster.unsigned(signed))).alias("floats"))


QUERIES["rasters"] = _rasters
SQL["rasters"] = f"""
with px as ({tables.ANSI["px"]}),
rows_ as (select photo_id, rw, string_agg(cast(r8 as varchar), ',' order by cl) as v from px group by photo_id, rw)
select photo_id, string_agg(v, ',' order by rw) as flat, string_agg(v, ';' order by rw) as rows, string_agg(v, ';' order by rw) as floats from rows_ group by photo_id"""

# weighted draws, tiles, hulls, clusters of a whole table, bisection
register("weighted_draw", draws.weighted_draw, {"points": _view("select photo_id as g, (cl - 1) * h + rw as o, r8 as weight from {px}")})
_SOFT = [[v * (1 + (i - j) / 62) for j, v in enumerate(row)] for i, row in enumerate(stencil.gaussian_kernel(31, 5.0))]
QUERIES["blur_fft"] = lambda spark, sf_dir: tiles.conv2_fft(tables.px(spark, sf_dir), _SOFT, pad=0.25, side=16).withColumn("v", F.round("v", 6) + 0.0)
SQL["blur_fft"] = stencil.conv2(_SOFT, pad=0.25).ansi({"px": tables.ANSI["px"]})
QUERIES["components_tiled"] = lambda spark, sf_dir: tiles.components(_clusters(spark, sf_dir), side=8).select("photo_id", "rw", "cl", "segment_id")
SQL["components_tiled"] = SQL["components"]


def _segment_hulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = hulls.segment_hulls(written(_segments(spark, sf_dir), "segments"))
    return found.select("photo_id", "segment_id", "n", "corners", F.round("area", 6).alias("area"), "inside", F.round("coverage", 6).alias("coverage"))


#: Facets of the hulls of segments, clockwise (x: column, y: -row): pairs of corners with all other points on one side, and none of their line beyond them.
_FACETS_SQL = f"""
segs as materialized ({_SEGMENTS_SQL}),
ends as (select photo_id, segment_id, cl as x, min(-rw) as lo, max(-rw) as hi from segs group by all),
pts as materialized (select photo_id, segment_id, x, lo as y from ends union select photo_id, segment_id, x, hi from ends),
facets as materialized (select a.photo_id, a.segment_id, a.x as ax, a.y as ay, b.x as bx, b.y as by_ from pts a join pts b on a.photo_id = b.photo_id and a.segment_id = b.segment_id and (a.x <> b.x or a.y <> b.y)
  where not exists (select 1 from pts r where r.photo_id = a.photo_id and r.segment_id = a.segment_id and ((b.x - a.x) * (r.y - a.y) - (b.y - a.y) * (r.x - a.x) > 0
    or ((b.x - a.x) * (r.y - a.y) - (b.y - a.y) * (r.x - a.x) = 0 and (r.x - a.x) * (r.x - b.x) + (r.y - a.y) * (r.y - b.y) > 0)))),
sizes as materialized (select photo_id, segment_id, count(*) as n from segs group by all)"""
QUERIES["segment_hulls"] = _segment_hulls
SQL["segment_hulls"] = f"""
with {_FACETS_SQL},
found as (select photo_id, segment_id, count(*) as corners, abs(sum(ax * by_ - ay * bx)) / 2.0::double as area, sum(gcd(abs(bx - ax), abs(by_ - ay))) as edge from facets group by all),
filled as (select photo_id, segment_id, n, coalesce(corners, 1) as corners, coalesce(area, 0) as area, cast(round(coalesce(area, 0) + coalesce(edge, 0) / 2.0::double) as bigint) + 1 as inside from sizes left join found using (photo_id, segment_id))
select photo_id, segment_id, n, cast(corners as int) as corners, round(area, 6) as area, inside, round(n / inside::double, 6) as coverage from filled"""


def _inside_largest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which pixels of a photo lie in the hull of its largest segment."""
    segs = written(_segments(spark, sf_dir), "segments")
    largest = segs.groupBy("photo_id", "segment_id").agg(F.count("*").alias("n")).groupBy("photo_id").agg(F.max_by("segment_id", F.struct("n", "segment_id")).alias("segment_id"))
    found = hulls.hulls(segs.join(largest, ["photo_id", "segment_id"]).select("photo_id", F.col("cl").alias("x"), (-F.col("rw")).alias("y")), ["photo_id"])
    return segs.join(found, "photo_id").select("photo_id", "rw", "cl", hulls.inside(F.col("cl").cast("double"), -F.col("rw").cast("double"), F.col("hull")).alias("inside"))


QUERIES["inside_largest"] = _inside_largest
SQL["inside_largest"] = f"""
with {_FACETS_SQL},
largest as (select photo_id, arg_max(segment_id, (n, segment_id)) as segment_id from sizes group by photo_id),
own as materialized (select f.photo_id, ax, ay, bx, by_ from facets f join largest using (photo_id, segment_id)
  union all select p.photo_id, x, y, x, y from pts p join largest using (photo_id, segment_id) join sizes using (photo_id, segment_id) where n = 1)
select p.photo_id, p.rw, p.cl, bool_and((bx - ax) * (-p.rw - ay) - (by_ - ay) * (p.cl - ax) < 0
  or ((bx - ax) * (-p.rw - ay) - (by_ - ay) * (p.cl - ax) = 0 and (p.cl - ax) * (p.cl - bx) + (-p.rw - ay) * (-p.rw - by_) <= 0)) as inside from segs p join own using (photo_id) group by all"""
QUERIES["shape_convexity"] = lambda spark, sf_dir: hulls.convexity(written(_segments(spark, sf_dir), "segments"))
SQL["shape_convexity"] = f"""
with {_FACETS_SQL},
found as (select photo_id, segment_id, abs(sum(ax * by_ - ay * bx)) / 2.0::double as area, sum(gcd(abs(bx - ax), abs(by_ - ay))) as edge from facets group by all),
photos as (select photo_id, max(h) * max(w) as size from segs group by photo_id),
filled as (select photo_id, n, n / (round(coalesce(area, 0) + coalesce(edge, 0) / 2.0::double) + 1) as coverage from sizes left join found using (photo_id, segment_id))
select photo_id, sum(case when n >= size / 200.0 and coverage >= 0.8 then n else 0 end) / max(size)::double as convexity from filled join photos using (photo_id) group by photo_id"""
QUERIES["table_clusters"] = lambda spark, sf_dir: clusters.table_clusters(tables.px(spark, sf_dir))[0]
# x ^ 3 + x = theta
QUERIES["bisect_roots"] = lambda spark, sf_dir: _ANGLES_ID(spark, sf_dir).select("id", F.round(search.bisect(lambda x: x * x * x + x, F.col("x"), 0.0, 7.0), 6).alias("root"))
SQL["bisect_roots"] = f"select event_id as id, round(cbrt(theta / 2 + sqrt(theta * theta / 4 + 1 / 27e0)) - cbrt(sqrt(theta * theta / 4 + 1 / 27e0) - theta / 2), 6) as root from ({tables.ANSI['angles']}) a"
QUERIES["rao_spacing_test"] = lambda spark, sf_dir: vonmises.rao_test(_BY_USER["a"][0](spark, sf_dir))
