"""Bisection of any increasing expression, in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bisect(func: Callable[[Column], Column], target: Column | float, low: Column | float, high: Column | float, tol: float = 1e-12, steps: int = 100) -> Column:
    """A place between ``low`` and ``high`` where the increasing ``func`` is within ``tol`` of ``target``; null if none is found.

    ``func`` maps a column to a column of built-in functions, and may use others of the row; it is evaluated once a step, until
    the place is found. None is where the target lies outside, the function does not grow, or ``tol`` is finer than its numbers.
    """
    as_double = lambda v: (v if isinstance(v, Column) else F.lit(float(v))).cast("double")
    goal = as_double(target)

    def step(acc: Column, _: Column) -> Column:
        mid = (acc.a + acc.b) / 2

        def narrowed(v: Column) -> Column:
            off, hit = v - goal, F.abs(v - goal) < tol
            over = ~hit & (acc.a == acc.b)
            return F.struct(F.when(off < 0, mid).otherwise(acc.a).alias("a"), F.when(off > 0, mid).otherwise(acc.b).alias("b"), F.when(hit, mid).alias("found"), (hit | over | off.isNull() | F.isnan(off)).alias("done"))

        return F.when(acc.done, acc).otherwise(F.element_at(F.transform(F.array(func(mid)), narrowed), 1))

    start = F.struct(as_double(low).alias("a"), as_double(high).alias("b"), F.lit(None).cast("double").alias("found"), (as_double(low) > as_double(high)).alias("done"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step, lambda acc: acc.found)
