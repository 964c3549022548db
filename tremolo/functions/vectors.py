"""Vector column expressions (arrays of floats / doubles), built-in higher-order functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dot(a: Column | str, b: Column | str) -> Column:
    """Inner product, summed in double in index order."""
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double")),
                       F.lit(0.0).cast("double"), lambda acc, x: acc + x)


def l2_norm(a: Column | str) -> Column:
    return F.sqrt(F.aggregate(_c(a), F.lit(0.0).cast("double"),
                              lambda acc, x: acc + x.cast("double") * x.cast("double")))


def l2_normalize(a: Column | str) -> Column:
    """X11: unit-length copy (array<double>); a zero vector stays zero."""
    n = l2_norm(a)
    return F.transform(_c(a), lambda x: F.when(n > 0, x.cast("double") / n)
                       .otherwise(x.cast("double")))
