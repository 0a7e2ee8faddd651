"""Vectors as arrays of doubles: expressions that stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-12


def doubles(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def let(value: Column, body) -> Column:
    """``body(value)`` with the value evaluated once, even inside lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def unit(v: Column) -> Column:
    """To length one; a vector of length 1e-12 or less stays."""
    return let(doubles(v), lambda w: let(norm(w), lambda n: F.when(n <= EPS, w).otherwise(F.transform(w, lambda x: x / n))))


def cosine(a: Column, b: Column) -> Column:
    """0 where either is a zero vector."""
    return let(norm(a) * norm(b), lambda n: F.when(n <= EPS, F.lit(0.0)).otherwise(dot(a, b) / n))


def blend(a: Column, b: Column, weight: float) -> Column:
    """unit((1 - w) a + w b), the weight clipped to [0, 1]."""
    w = min(max(weight, 0.0), 1.0)
    return unit(F.zip_with(a, b, lambda x, y: (1 - w) * x.cast("double") + w * y.cast("double")))


def project(v: Column, rows: list[list[float]]) -> Column:
    """The product of a matrix, given by its rows, and a vector."""
    return F.array(*(dot(v, F.array(*(F.lit(float(x)) for x in row))) for row in rows))


def mean_vector(vectors: Column) -> Column:
    """The mean of an array of vectors; an empty array for none."""
    first = F.transform(F.element_at(vectors, 1), lambda x: F.lit(0.0))
    total = F.aggregate(vectors, first, lambda s, v: F.zip_with(s, v, lambda x, y: x + y.cast("double")))
    n = F.size(vectors)
    return F.when(n > 0, F.transform(total, lambda x: x / n)).otherwise(F.array().cast("array<double>"))


def max_cosine(a: Column, b: Column) -> Column:
    """The largest cosine between two lists of vectors; 0 where one is empty."""
    pairs = F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: cosine(x, y))))
    return F.coalesce(F.array_max(pairs), F.lit(0.0))


def jaccard(a: Column, b: Column, both_empty: float = 1.0) -> Column:
    """Of two sets given as arrays; ``both_empty`` where neither has an element."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(both_empty)).otherwise(F.size(F.array_intersect(a, b)) / union)
