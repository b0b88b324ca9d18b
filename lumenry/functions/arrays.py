"""Vector functions over arrays of numbers, as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _zero() -> Column:
    return F.lit(0.0).cast("double")


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once, however often ``f`` uses it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def vsum(v: Column) -> Column:
    return F.aggregate(v, _zero(), lambda a, x: a + x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return vsum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def mean(v: Column) -> Column:
    return vsum(v) / F.size(v)


def argmax(v: Column) -> Column:
    """Index from 0 of the greatest value, the first of equal ones; null for an empty array."""
    return F.when(F.size(v) > 0, F.array_position(v, F.array_max(v)) - 1)


def interpolate(a: Column, b: Column, alpha: Column) -> Column:
    """``(1 - alpha) a + alpha b``."""
    return F.zip_with(a, b, lambda x, y: (1 - alpha) * x.cast("double") + alpha * y.cast("double"))


def min_max(v: Column, epsilon: float = 1e-8) -> Column:
    """Values moved to 0..1; a constant array gives zeros."""
    ends = F.struct(v.alias("v"), F.array_min(v).cast("double").alias("low"), F.array_max(v).cast("double").alias("high"))
    return let(ends, lambda s: F.transform(s["v"], lambda x: (x.cast("double") - s["low"]) / (s["high"] - s["low"] + epsilon)))


def softmax(v: Column) -> Column:
    known = F.struct(v.alias("v"), F.array_max(v).cast("double").alias("top"))
    raised = let(known, lambda s: F.transform(s["v"], lambda x: F.exp(x.cast("double") - s["top"])))
    return let(let(raised, lambda r: F.struct(r.alias("r"), vsum(r).alias("all"))), lambda s: F.transform(s["r"], lambda x: x / s["all"]))


def mapped(v: Column, f: Callable[[Column], Column]) -> Column:
    return F.transform(v, f)


def relu(v: Column) -> Column:
    return mapped(v, lambda x: F.greatest(x.cast("double"), _zero()))


def tanh(v: Column) -> Column:
    return mapped(v, lambda x: F.tanh(x.cast("double")))


def layer_norm(v: Column, epsilon: float = 1e-5) -> Column:
    centred = let(F.struct(v.alias("v"), mean(v).alias("m")), lambda s: F.transform(s["v"], lambda x: x.cast("double") - s["m"]))
    spread = let(centred, lambda c: F.struct(c.alias("c"), F.sqrt(dot(c, c) / F.size(c) + epsilon).alias("d")))
    return let(spread, lambda s: F.transform(s["c"], lambda x: x / s["d"]))


def cells_mean(cells: Column) -> Column:
    """Mean vector of an array of equal-length vectors."""
    width = F.size(F.element_at(cells, 1))
    return F.transform(F.sequence(F.lit(1), width), lambda i: vsum(F.transform(cells, lambda c: F.element_at(c, i))) / F.size(cells))


def weighted_cells(cells: Column, weights: Column) -> Column:
    """Sum of vectors by weight."""
    width = F.size(F.element_at(cells, 1))
    return F.transform(F.sequence(F.lit(1), width), lambda i: vsum(F.zip_with(cells, weights, lambda c, w: F.element_at(c, i) * w)))


def grid(v: Column, side: int = 7) -> Column:
    """A flat array as rows of ``side``."""
    return let(v, lambda whole: F.transform(F.sequence(F.lit(0), F.lit(side - 1)), lambda i: F.slice(whole, i * side + 1, F.lit(side))))


def steps(n: int) -> Column:
    """``n`` evenly spaced numbers from 0 to 1."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: i.cast("double") / float(max(1, n - 1)))


def percent_labels(alpha: Column) -> tuple[Column, Column]:
    """Whole percents of a two-decimal ``alpha``, cut, not rounded: of the first and the second end."""
    return ((1 - alpha) * 100).cast("int"), (alpha * 100).cast("int")


def shifted(ids: Column) -> tuple[Column, Column]:
    """Inputs and targets of next-token training: all but the last, all but the first."""
    return F.slice(ids, 1, F.size(ids) - 1), F.slice(ids, 2, F.size(ids) - 1)
