"""Numeric, array and map functions as Column builders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def idf(documents: Column, frequency: Column) -> Column:
    """Smoothed inverse document frequency."""
    return F.log((documents + 1) / (frequency + 1)) + 1


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))), F.lit(0.0))


def sigmoid(z: Column) -> Column:
    """Logistic function of a value held within 40 of zero."""
    return 1 / (1 + F.exp(-F.greatest(F.lit(-40.0), F.least(F.lit(40.0), z))))


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of arrays taken as sets; 0 if the first is empty."""
    return F.when(F.size(a) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def safe_divide(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def interpolate(x: Column, xs: list[float], ys: list[float]) -> Column:
    """Piecewise linear through knots, flat outside them."""
    out = F.when(x <= xs[0], F.lit(ys[0]))
    for x0, x1, y0, y1 in zip(xs, xs[1:], ys, ys[1:], strict=False):
        out = out.when(x <= x1, F.lit(y0) + (x - x0) / (x1 - x0) * (y1 - y0) if x1 > x0 else F.lit(y1))
    return out.otherwise(F.lit(ys[-1]))


def is_subsequence(part: Column, whole: Column) -> Column:
    """Whether all of ``part`` stands in ``whole`` in order, gaps allowed."""
    found = F.aggregate(whole, F.lit(1), lambda at, x: F.when((at <= F.size(part)) & (F.try_element_at(part, at) == x), at + 1).otherwise(at))
    return found > F.size(part)


def combinations(items: Column, most: int = 12) -> Column:
    """All non-empty sub-arrays of an array of at most ``most`` items, in the order of their bit masks."""
    masks = F.sequence(F.lit(1), F.call_function("shiftleft", F.lit(1), F.least(F.size(items), F.lit(most))) - 1)
    return F.when(
        F.size(items).between(1, most), F.transform(masks, lambda m: F.filter(items, lambda x, i: F.call_function("shiftright", m, i).bitwiseAND(F.lit(1)) == 1))
    ).otherwise(F.array().cast("array<array<string>>"))
