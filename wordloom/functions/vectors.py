"""Dense vector arithmetic on ARRAY<DOUBLE> columns (higher-order functions)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def as_double_array(col) -> Column:
    return _c(col).cast("array<double>")


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def sq_norm(a) -> Column:
    return F.aggregate(_c(a), F.lit(0.0), lambda s, x: s + x * x)


def norm(a) -> Column:
    return F.sqrt(sq_norm(a))


def l2_normalize(a) -> Column:
    """Unit length; the zero vector stays zero."""
    # the norm is bound once: inside the element's own lambda it would be summed again for every element
    bound = F.array(norm(a))
    scaled = F.transform(bound, lambda n: F.when(n > 0, F.transform(_c(a), lambda x: x / n)).otherwise(_c(a)))
    return F.element_at(scaled, 1)


def scale(a, w) -> Column:
    return F.transform(_c(a), lambda x: x * w)


def round_array(a, places: int = 6) -> Column:
    return F.transform(_c(a), lambda x: F.round(x, places))


def zeros(dim: int) -> Column:
    return F.array_repeat(F.lit(0.0), dim)
