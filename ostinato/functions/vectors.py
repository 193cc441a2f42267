"""Vectors in array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Null if one has no length."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n)


def unit(a: Column) -> Column:
    """Of length one; a vector without length stays."""
    return F.transform(a, lambda x: x.cast("double") / F.when(norm(a) > 0, norm(a)).otherwise(1.0))


def decibel(x: Column) -> Column:
    return F.log10(x + 1e-10) * 20


def entropy(a: Column) -> Column:
    s = total(a) + 1e-10
    return -total(F.transform(a, lambda x: (x / s) * F.log(x / s + 1e-10)))
