"""Arithmetic of vectors held as arrays of numbers, in expressions that stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def dot(a, b) -> Column:
    return total(F.zip_with(_c(a).cast("array<double>"), _c(b).cast("array<double>"), lambda x, y: x * y))


def norm(a) -> Column:
    return F.sqrt(dot(a, a))


def _with(value: Column, use) -> Column:
    """use(value) with value computed once: an expression that stands inside a lambda is computed for each element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def unit(a) -> Column:
    """The vector of length 1; a zero vector stays."""
    scaled = lambda v: _with(norm(v), lambda n: F.when(n > 0, F.transform(v, lambda x: x / n)).otherwise(v))
    return _with(_c(a).cast("array<double>"), scaled)


def cosine(a, b) -> Column:
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n).otherwise(0.0)


def euclidean(a, b) -> Column:
    return F.sqrt(total(F.zip_with(_c(a).cast("array<double>"), _c(b).cast("array<double>"), lambda x, y: (x - y) * (x - y))))
