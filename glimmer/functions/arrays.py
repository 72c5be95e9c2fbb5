"""Statistics of a trace that is an array column: no explode and no shuffle."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def given(value: Column, then) -> Column:
    """then(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def rounded(x: Column, digits: int = 6) -> Column:
    """Rounded, and never -0.0."""
    return F.round(x, digits) + F.lit(0.0)


def total(y: Column) -> Column:
    return F.aggregate(y, F.lit(0.0), lambda s, x: s + x)


def mean(y: Column) -> Column:
    return total(y) / F.size(y)


def deviation(y: Column) -> Column:
    """Sample standard deviation; null for fewer than two values."""
    squares = lambda m: F.aggregate(y, F.lit(0.0), lambda s, x: s + (x - m) * (x - m))
    return F.when(F.size(y) > 1, F.sqrt(given(mean(y), squares) / (F.size(y) - 1)))


def quantile(y: Column, q: float) -> Column:
    """Linear interpolation between the sorted values at (n - 1) * q."""

    def at(s: Column) -> Column:
        place = (F.size(s) - 1) * F.lit(q)
        low = F.floor(place).cast("int")
        a, b = F.get(s, low), F.get(s, F.least(low + 1, F.size(s) - 1))
        return a + (b - a) * (place - low)

    return given(F.sort_array(y), at)


def hazen(y: Column, q: float) -> Column:
    """Linear interpolation with the k-th sorted value at (k - 1/2) / n, the first and last beyond their places."""

    def at(s: Column) -> Column:
        place = F.least(F.greatest(F.size(s) * F.lit(q) - 0.5, F.lit(0.0)), (F.size(s) - 1).cast("double"))
        low = F.floor(place).cast("int")
        a, b = F.get(s, low), F.get(s, F.least(low + 1, F.size(s) - 1))
        return a + (b - a) * (place - low)

    return given(F.sort_array(y), at)


def median(y: Column) -> Column:
    return quantile(y, 0.5)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, z: x * z))


def correlation(a: Column, b: Column) -> Column:
    """Pearson's correlation; null where a trace does not vary."""
    centred = lambda y: given(mean(y), lambda m: F.transform(y, lambda x: x - m))
    both = lambda u: given(centred(b), lambda v: dot(u, v) / F.nullif(F.sqrt(dot(u, u) * dot(v, v)), F.lit(0.0)))
    return given(centred(a), both)


def weighted_sum(items: Column, w: str = "w", x: str = "x") -> Column:
    """The sum of the arrays of a collected column of structs (w, x), each times its weight; empty if there is none."""
    return F.aggregate(items, F.array().cast("array<double>"), lambda s, e: F.when(F.size(s) == 0, F.transform(e[x], lambda v: v * e[w])).otherwise(F.zip_with(s, e[x], lambda a, v: a + v * e[w])))
