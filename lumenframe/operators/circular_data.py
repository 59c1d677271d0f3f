"""Angle columns that know their units, type, zero, rotation and modulo: kept in the column's metadata, converted where columns meet."""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The kinds of circular data.
TYPES, UNITS, TEMPLATES, MODULI, ROTATIONS = ("angles", "directions"), ("radians", "degrees", "hours"), ("none", "geographics", "clock12", "clock24"), ("asis", "2pi", "pi"), ("counter", "clock")
#: Half a turn in each unit.
HALF = {"radians": math.pi, "degrees": 180.0, "hours": 12.0}
KEY = "circular"


class Circular(NamedTuple):
    """What an angle column's values mean; ``zero`` is in radians, whatever the units."""

    type: str = "angles"
    units: str = "radians"
    template: str = "none"
    modulo: str = "asis"
    zero: float = 0.0
    rotation: str = "counter"

    def checked(self) -> Circular:
        for name, known in (("type", TYPES), ("units", UNITS), ("template", TEMPLATES), ("modulo", MODULI), ("rotation", ROTATIONS)):
            if getattr(self, name) not in known:
                raise ValueError(f"{name} has to be one of {', '.join(known)}: {getattr(self, name)}")
        if isinstance(self.zero, bool) or not isinstance(self.zero, (int, float)) or not math.isfinite(self.zero):
            raise ValueError(f"zero has to be a number: {self.zero}")
        return self._replace(zero=float(self.zero))

    def templated(self) -> Circular:
        """A template other than none is that of a compass or a clock: from the top, clockwise."""
        return self if self.template == "none" else self._replace(zero=math.pi / 2, rotation="clock")


def _within(x: str, units: str, modulo: str) -> str:
    m = repr(HALF[units] * (2 if modulo == "2pi" else 1)) + "e0"
    return x if modulo == "asis" else f"((({x}) % {m} + {m}) % {m})"


def converted(x: str, have: Circular, units: str = "radians", type: str | None = None, template: str | None = None, modulo: str | None = None, zero: float | None = None, rotation: str | None = None) -> tuple[str, Circular]:  # noqa: A002
    """SQL of the values of ``x`` in other terms, and what they then mean. Options that are None stay as they are.

    In this order: directions are doubled, units changed, the zero shifted (against the old rotation), the rotation
    turned, and what remains taken modulo a turn or half of one.
    """
    asked = Circular(type or have.type, units, template or have.template, modulo or have.modulo, have.zero if zero is None else zero, rotation or have.rotation).checked()
    if template is not None and template != "none":
        zero, rotation = math.pi / 2, "clock"
    now = have._replace(template=template or have.template)
    if type == "directions" and have.type != type:
        x, now = f"(2 * {x})", now._replace(type=type)
    if have.units != units:
        x = f"({x} / {HALF[have.units]!r}e0 * {HALF[units]!r}e0)"
    now = now._replace(units=units)
    if zero is not None and have.zero != zero:
        shift = (have.zero - zero) / math.pi * HALF[units] * (1 if have.rotation == "counter" else -1)
        x, now = f"({x} + {shift!r}e0)", now._replace(zero=float(zero))
    if rotation is not None and have.rotation != rotation:
        x, now = f"(-({x}))", now._replace(rotation=rotation)
    if modulo is not None:
        x, now = _within(x, units, modulo), now._replace(modulo=asked.modulo)
    if (zero is not None and zero % (2 * math.pi) != math.pi / 2) or rotation == "counter":
        now = now._replace(template="none")
    return x, now


def properties(df: DataFrame, column: str) -> Circular:
    """What a column's values mean: by its metadata, else angles in radians."""
    return Circular(**df.schema[column].metadata.get(KEY, {}))


def _with(df: DataFrame, column: str, value: str, means: Circular) -> DataFrame:
    meta = df.schema[column].metadata | {KEY: means._asdict()}
    return df.withColumns({column: F.expr(value).cast("double")}).withMetadata(column, meta)


def circular(df: DataFrame, column: str, **options: str | float) -> DataFrame:
    """Say what a column's values mean (options of ``Circular``), and take them modulo a turn or half of one if asked to."""
    means = Circular(**options).checked().templated()
    return _with(df, column, _within(f"`{column}`", means.units, means.modulo), means)


def conversion(df: DataFrame, column: str, units: str = "radians", **options: str | float | None) -> DataFrame:
    """The frame with a column in other terms (see ``converted``); filters and selections keep what the column knows."""
    return _with(df, column, *converted(f"`{column}`", properties(df, column), units, **options))


def concatenated(first: DataFrame, *others: DataFrame, column: str) -> DataFrame:
    """All rows, the angle column of every frame in the terms of the first."""
    means = properties(first, column)
    out = first
    for df in others:
        out = out.unionByName(conversion(df, column, **means._asdict()))
    return out.withMetadata(column, first.schema[column].metadata)


def described(df: DataFrame, column: str) -> str:
    """The column's terms, a line each."""
    return "\n".join(f"{k} = {v}" for k, v in properties(df, column)._asdict().items())
