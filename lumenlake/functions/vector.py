"""Vector expressions over ``array<float>`` columns. All sums run in DOUBLE, in the order of the elements."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def cosine(a: Column, b: Column) -> Column:
    """Higher is nearer; null for a zero vector or a null one."""
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def euclid(a: Column, b: Column) -> Column:
    """Lower is nearer."""
    return F.sqrt(_sum(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))))


def sad(a: Column, b: Column) -> Column:
    """Sum of absolute differences: the primitive behind scene scores."""
    return _sum(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double"))))


def mse(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))) / F.size(a)


def prefix(a: Column, dim: int) -> Column:
    """The first ``dim`` elements (Matryoshka truncation); not normalised again."""
    return F.slice(a, 1, dim)


def normalised(a: Column) -> Column:
    """Unit vector; null for a zero vector."""
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: x.cast("double") / n))


def guarded(a: Column, dim: int) -> Column:
    """``a``, failing the job where its length is not ``dim``."""
    return F.when(F.size(a) == dim, a).otherwise(F.raise_error(F.format_string("vector of length %d, expected " + str(dim), F.size(a))).cast("array<float>"))


#: Distance name (any case) -> expression and whether larger values are nearer.
METRICS = {"cosine": (cosine, True), "dot": (dot, True), "euclid": (euclid, False)}


def metric(name: str):
    """Expression and direction of a distance; an unknown name is an error."""
    try:
        return METRICS[name.lower()]
    except KeyError:
        raise ValueError(f"unknown distance {name!r}; known: {sorted(METRICS)}") from None
