"""Vector expressions for small inputs; bulk scoring lives in operators.search."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dot(a, b) -> Column:
    products = F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, p: total + p)


def norm(a) -> Column:
    return F.sqrt(F.aggregate(_col(a), F.lit(0.0), lambda t, x: t + x.cast("double") * x.cast("double")))


def cosine(a, b) -> Column:
    """Cosine similarity; null for a missing or zero vector or unequal sizes."""
    a, b = _col(a), _col(b)
    score = F.try_divide(dot(a, b), norm(a) * norm(b))
    return F.when(F.size(a) == F.size(b), score)


def unit(a) -> Column:
    """The vector scaled to length one; null for a zero vector."""
    a = _col(a)
    length = norm(a)
    return F.when(length > 0, F.transform(a, lambda x: (x.cast("double") / length).cast("float")))
