"""Vector expressions over arrays, folded in order in doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def inner_product(a: Column, b: Column) -> Column:
    return _total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def squared_l2(a: Column, b: Column) -> Column:
    return _total(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))))


def l2_norm(v: Column) -> Column:
    return F.sqrt(_total(F.transform(v, lambda x: x.cast("double") * x.cast("double"))))


def cosine(a: Column, b: Column) -> Column:
    """Null if either has no length."""
    return inner_product(a, b) / F.nullif(l2_norm(a) * l2_norm(b), F.lit(0.0))


def normalized(v: Column) -> Column:
    """Unit length; a vector of length 0 stays."""
    norm = l2_norm(v)
    return F.when(norm == 0, F.transform(v, lambda x: x.cast("double"))).otherwise(F.transform(v, lambda x: x.cast("double") / norm))


def has_dimension(v: Column, size: int) -> Column:
    return v.isNotNull() & (F.size(v) == size)


#: metric -> (score, whether a larger score is nearer)
METRICS = {"IP": (inner_product, True), "L2": (squared_l2, False), "COSINE": (cosine, True)}
