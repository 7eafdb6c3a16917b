"""Vector functions as Column expressions over array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def dot(a: Column | str, b: Column | str) -> Column:
    products = F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(v: Column | str) -> Column:
    return F.sqrt(F.aggregate(_c(v), F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def normalize(v: Column | str, dimension: int) -> Column:
    """Unit length as floats; a wrong length, a non-finite component or a zero vector is an error."""
    v = _c(v)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    length = norm(v)
    good = (F.size(v) == dimension) & finite & (length > 0)
    return F.when(good, F.transform(v, lambda x: (x.cast("double") / length).cast("float"))).otherwise(F.raise_error(F.lit(f"expected {dimension} finite components, not all zero")).cast("array<float>"))


def sq8_scale(v: Column | str) -> Column:
    """Largest magnitude over 127, in single precision; 1 for a zero vector."""
    largest = F.array_max(F.transform(_c(v), lambda x: F.abs(x.cast("float"))))
    return F.when(largest > 0, (largest / F.lit(127.0).cast("float")).cast("float")).otherwise(F.lit(1.0).cast("float"))


def sq8_codes(v: Column | str, scale: Column | str) -> Column:
    """Eight-bit codes, halves away from zero."""

    def code(x: Column) -> Column:
        q = F.round((x.cast("float") / _c(scale)).cast("float"))
        return F.greatest(F.lit(-127), F.least(F.lit(127), q.cast("int"))).cast("tinyint")

    return F.transform(_c(v), code)


def sq8_decode(codes: Column | str, scale: Column | str) -> Column:
    return F.transform(_c(codes), lambda c: (c.cast("float") * _c(scale)).cast("float"))


def dot_codes(a: Column | str, b: Column | str) -> Column:
    products = F.zip_with(_c(a), _c(b), lambda x, y: x.cast("int") * y.cast("int"))
    return F.aggregate(products, F.lit(0), lambda acc, x: acc + x)


def clamp_unit(score: Column) -> Column:
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), score))
