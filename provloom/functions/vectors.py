"""Vector expressions over array<double> columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_double(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def unit(a: Column) -> Column:
    """L2-normalised vector; a zero vector stays zero. The norm is a variable of its own: an expression within the
    function of the elements would be computed for each of them."""
    n = F.greatest(norm(a), F.lit(1e-12))
    return F.element_at(F.transform(F.array(n), lambda m: F.transform(a, lambda x: x / m)), 1)
