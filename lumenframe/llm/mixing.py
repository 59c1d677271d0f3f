"""Mixing sources to target weights: raking to marginals, then sampling by calibrated probabilities."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The category of nulls.
NONE = "(none)"
#: The category of values that the targets do not name; it keeps its share of the tokens.
OTHER = "(other)"


def tokens_of(text: Column) -> Column:
    """Token weight of a text: its number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def uniform(key: Column, seed: int) -> Column:
    """A number in [0, 1) fixed by the key: the first 48 bits of an MD5 digest."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(key.cast("string"), F.lit(NONE))))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("long") / F.lit(float(1 << 48))


def category(value: Column, target: Mapping[str, float]) -> Column:
    value = value.cast("string")
    return F.when(value.isin(*map(str, target)), value).when(value.isNull() & F.lit(NONE in target), F.lit(NONE)).otherwise(F.lit(OTHER))


def rake(cells: DataFrame, targets: Mapping[str, Mapping[str, float]], rounds: int = 30) -> DataFrame:
    """Iterative proportional fitting of cell weights; adds ``ratio``, the weight after fitting over the weight before.

    ``cells`` holds one row per combination of categories, with its token weight in ``tokens``. As every
    category is one that a target names or OTHER, there are at most the product of the targets' sizes
    (+ 1 each) of them, whatever the data: they fit one row, in which the rounds run as higher-order
    functions, without a shuffle a step.
    """
    dims = list(targets)
    fit = cells.groupBy().agg(F.array_sort(F.collect_list(F.struct(*dims, F.col("tokens").cast("double").alias("w"), F.col("tokens").cast("double").alias("tokens")))).alias("c"))
    add = lambda xs, of: F.aggregate(xs, F.lit(0.0), lambda a, x: a + of(x))

    def let(value: Column, body) -> Column:
        """Evaluate ``value`` once for all of its uses in ``body``."""
        return F.element_at(F.transform(F.array(value), body), 1)

    def sums(cs: Column, d: str) -> Column:
        keys = F.array(*[F.lit(str(k)) for k in (*targets[d], OTHER)])
        return F.map_from_arrays(keys, F.transform(keys, lambda k: add(F.filter(cs, lambda x: x[d] == k), lambda x: x.w)))

    def share(cs: Column, d: str) -> Column:
        """Target shares among the categories that hold tokens; OTHER keeps its own share."""
        named = F.create_map(*[y for k, v in (*targets[d].items(), (OTHER, 0.0)) for y in (F.lit(str(k)), F.lit(float(v)))])
        return let(F.struct(sums(cs, d).alias("s"), add(cs, lambda x: x.w).alias("total")), lambda t: let(
            F.struct(F.map_filter(named, lambda k, v: F.element_at(t.s, k) > 0).alias("there"), F.try_divide(F.element_at(t.s, F.lit(OTHER)), t.total).alias("other"), t.total.alias("total")),
            lambda u: F.transform_values(u.there, lambda k, v: F.when(k == OTHER, u.other).otherwise(F.try_divide(v, add(F.map_values(u.there), lambda y: y)) * (1 - u.other)) * u.total)))

    def raked(cs: Column, want: Column, d: str) -> Column:
        """Scale to the wanted sums of one marginal."""
        return let(sums(cs, d), lambda s: F.transform(cs, lambda x: x.withField("w", x.w * F.coalesce(F.try_divide(F.element_at(want, x[d]), F.element_at(s, x[d])), F.lit(1.0)))))

    def one_round(acc: Column, _: Column) -> Column:
        c = acc.c
        for d in dims:
            c = let(c, lambda cs: raked(cs, acc[f"want_{d}"], d))
        return acc.withField("c", c)

    start = F.struct("c", *[share(F.col("c"), d).alias(f"want_{d}") for d in dims])
    fit = fit.select(F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, one_round, lambda a: a.c).alias("c"))
    return fit.select(F.explode("c").alias("x")).select(*[F.col(f"x.{d}").alias(d) for d in dims], F.col("x.tokens").cast("long").alias("tokens"), F.coalesce(F.try_divide(F.col("x.w"), F.col("x.tokens")), F.lit(0.0)).alias("ratio"))


def calibrated(cells: DataFrame, targets: Mapping[str, Mapping[str, float]], rate: float | None = None, rounds: int = 30) -> DataFrame:
    """Cells with ``probability``, ``rate`` times their ratio and at most 1, and ``weight``, by which what lies above 1 is made up for.

    Probability times weight is ``rate`` times the ratio in every cell; without ``rate`` all weights are 1.
    """
    fitted = rake(cells, targets, rounds)
    scale = F.lit(float(rate)) if rate is not None else F.coalesce(F.try_divide(F.lit(1.0), F.max("ratio").over(_whole())), F.lit(0.0))
    wanted = F.col("ratio") * scale
    return fitted.select(*targets, "tokens", F.least(F.lit(1.0), wanted).alias("probability"), F.greatest(F.lit(1.0), wanted).alias("weight"))


def mix(docs: DataFrame, dims: Mapping[str, Column], targets: Mapping[str, Mapping[str, float]], tokens: Column, key: Column, rate: float | None = None, rounds: int = 30, seed: int = 1, prefix: str = "mix_") -> DataFrame:
    """Sample documents so that their tokens, times their weights, meet the target marginals of ``dims``, in expectation.

    ``dims`` names a column for each marginal, ``targets`` the share of each of its values (null: the key
    ``(none)``). A document's probability is ``rate`` times its cell's ratio of fitted to given tokens,
    at most 1; without ``rate`` it is the largest at which none exceeds 1. Where ``rate`` wants more than a
    cell holds, all of its documents are kept, with the excess as their weight (1 elsewhere): without the
    weights such a sample misses the targets. A document is kept if a number fixed by
    ``key`` and ``seed`` lies below it, so repeated rows stay or go together and a lost task comes back the
    same. Values without a target, and null ones unless named, count as OTHER and keep their share of the
    tokens. Empty tables give empty results; documents without tokens get their cell's probability, and
    in a cell without tokens 0. Adds columns ``<prefix><dim>``, ``<prefix>tokens``, ``<prefix>probability``
    and ``<prefix>weight``; columns of these names are replaced, others stay. Texts of any length count whole.

    The documents are aggregated to cells before anything moves, so a source that holds a third of all
    rows is one row per task; the cells come back by a broadcast bounded by the targets' sizes.
    """
    names = {d: f"{prefix}{d}" for d in dims}
    tagged = docs.withColumns({names[d]: category(c, targets[d]) for d, c in dims.items()} | {f"{prefix}tokens": tokens})
    cells = tagged.groupBy(*[F.col(n).alias(d) for d, n in names.items()]).agg(F.sum(f"{prefix}tokens").alias("tokens"))
    fitted = calibrated(cells, targets, rate, rounds)
    fitted = fitted.select(*[F.col(d).alias(names[d]) for d in dims], *[F.col(c).alias(f"{prefix}{c}") for c in ("probability", "weight")])
    out = tagged.join(F.broadcast(fitted), list(names.values()))
    return out.where(uniform(key, seed) < F.col(f"{prefix}probability"))


def _whole():
    """All cells (their number is bounded by the targets)."""
    from pyspark.sql import Window

    return Window.partitionBy(F.lit(0))
