"""Vector expressions over arrays of numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def literal(values: list[float]) -> Column:
    """A query vector as a literal: no join is needed to compare it with a table."""
    return F.array(*[F.lit(float(v)) for v in values])


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 for unequal lengths or a zero norm."""
    na, nb = norm(a), norm(b)
    return F.when((F.size(a) != F.size(b)) | (na == 0) | (nb == 0), F.lit(0.0)).otherwise(dot(a, b) / (na * nb))


def int8_scale(v: Column) -> Column:
    """Largest absolute component / 127; 1 for a zero vector."""
    top = F.array_max(F.transform(v, lambda x: F.abs(x.cast("double"))))
    return F.when(top == 0, F.lit(1.0)).otherwise(top / F.lit(127.0))


def quantize_int8(v: Column, scale: Column) -> Column:
    """Symmetric quantisation, halves rounded towards plus infinity."""
    return F.transform(v, lambda x: F.greatest(F.lit(-127), F.least(F.lit(127), F.floor(x.cast("double") / scale + F.lit(0.5)).cast("int"))))


def dequantize(data: Column, scale: Column) -> Column:
    return F.transform(data, lambda x: x.cast("double") * scale)
