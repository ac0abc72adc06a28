"""Arithmetic on vector columns, in double precision.

Vectors of unequal length give null, and so does any division by a zero norm.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from qalink.functions.binding import let

_ZERO = 0.0


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(_ZERO), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return _total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def magnitude(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(_ZERO), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def scale(v: Column, divisor: Column) -> Column:
    return let(
        divisor, lambda d: F.when(d != 0, F.transform(v, lambda x: x.cast("double") / d))
    )


def normalize(v: Column) -> Column:
    return scale(v, magnitude(v))


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), magnitude(a) * magnitude(b))


def euclidean(a: Column, b: Column) -> Column:
    squares = F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2)))
    return F.sqrt(_total(squares))


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x.cast("double") + y.cast("double"))


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double"))
