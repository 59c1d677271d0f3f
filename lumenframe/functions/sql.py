"""Access by SQL: scalar functions, and the measures of a pixel relation as views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import color, segments, stencil
from ..operators.circular import a1inv, modulo, von_mises

_RGB = "r double, g double, b double"
_MAX, _DIFF = "greatest(r, g, b)", "(greatest(r, g, b) - least(r, g, b))"


def _of_rgb(text: str) -> str:
    """An expression over d and mx, the range and the largest of the channels."""
    return f"(select {text} from (select r, g, b, {_MAX} as mx, {_DIFF} as d) c)"


#: Parameters and body of each function (all return a double unless their name says a kind).
FUNCTIONS: dict[str, tuple[str, str]] = {
    "luminance": (_RGB, color.LUM),
    "hue": (_RGB, _of_rgb(color.HUE)),
    "saturation": (_RGB, f"case when {_MAX} = 0 then 0e0 else {_DIFF} / {_MAX} end"),
    "brightness": (_RGB, _MAX),
    "limited": ("x double, low double, high double", "greatest(low, least(high, x))"),
    "exposure": ("mean_luminance double", "case when mean_luminance between 0 and 1 then 4 * mean_luminance * (1 - mean_luminance) else 0e0 end"),
    "full_turn": ("x double", modulo("x")),
    "circular_distance": ("a double, b double", f"least({modulo('a - b')}, {modulo('b - a')})"),
    "concentration": ("rbar double", a1inv("rbar")),
    "von_mises_density": ("x double, mu double, kappa double", von_mises("x", "mu", "kappa")),
    "cross_product": ("px double, py double, qx double, qy double", "px * qy - py * qx"),
}
#: Measures that are views of a pixel relation.
MEASURES = {name: getattr(module, name) for module, names in (
    (color, "exposure_contrast hsv_averages hsv_central_averages size_aspect dominant_hue hue_histogram simple_measures"),
    (stencil, "blur_annoyance mdwe wavelet_texture wavelet_dof otsu"), (segments, "clustering_mdl_terms"),
) for name in names.split()}


def register_functions(spark: SparkSession, prefix: str = "photo_") -> list[str]:
    """Make FUNCTIONS known to the session under ``prefix`` and their names; they are inlined where they are called."""
    for name, (params, body) in FUNCTIONS.items():
        spark.sql(f"create or replace temporary function {prefix}{name}({params}) returns double return {body}")
    return [f"{prefix}{n}" for n in FUNCTIONS]


def register_measures(px: DataFrame, prefix: str = "photo_") -> list[str]:
    """Views of a pixel relation by the names of MEASURES; one is computed where it is read."""
    for name, op in MEASURES.items():
        op(px).createOrReplaceTempView(f"{prefix}{name}")
    return [f"{prefix}{n}" for n in MEASURES]
