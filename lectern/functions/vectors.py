"""Column functions on vectors (arrays of float), summed in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a) -> Column:
    return F.sqrt(dot(a, a))


def unit(a) -> Column:
    """The vector at length one; a zero vector stays."""
    n = norm(a)
    return F.when(n == 0, F.transform(col(a), lambda x: x.cast("double"))).otherwise(F.transform(col(a), lambda x: x.cast("double") / n))


def truncated(a, d: int) -> Column:
    """The first d dimensions, at length one."""
    return unit(F.slice(col(a), 1, d))


def of_dimension(a, d: int) -> Column:
    """The vector; an error if it has another number of dimensions."""
    return F.when(F.size(col(a)) == d, col(a)).otherwise(F.raise_error(F.concat(F.lit(f"vector has not {d} dimensions but "), F.size(col(a)).cast("string"))))
