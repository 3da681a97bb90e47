"""Arithmetic on numeric lists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x.cast("double"))


def dot(u: Column, v: Column) -> Column:
    products = F.zip_with(u, v, lambda a, b: a.cast("double") * b.cast("double"))
    return total(products)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once per row, not per element."""
    return F.transform(F.array(value), use)[0]


def l2_normalise(v: Column) -> Column:
    """Unit-length vector; a zero vector stays as it is."""
    length = norm(v)
    divisor = F.when(length == 0, 1.0).otherwise(length)
    return bound(divisor, lambda d: F.transform(v, lambda x: x.cast("double") / d))


def cosine_distance(u: Column, v: Column) -> Column:
    """0 for the same direction, 2 for opposite ones."""
    return 1 - F.try_divide(dot(u, v), norm(u) * norm(v))


def softmax(v: Column) -> Column:
    raised = bound(F.array_max(v), lambda peak: F.transform(v, lambda x: F.exp(x - peak)))
    shared = lambda r: bound(total(r), lambda d: F.transform(r, lambda x: x / d))
    return bound(raised, shared)


def softmax_by_length(v: Column) -> Column:
    """Softmax scaled by log2 of the list's length."""
    raised = softmax(v)
    return bound(F.log2(F.size(v)), lambda w: F.transform(raised, lambda x: x * w))
