"""Vectors as array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm2(a: Column) -> Column:
    return dot(a, a)


def scaled(a: Column, factor: Column) -> Column:
    return F.transform(a, lambda x: x.cast("double") * factor)


def normalised(a: Column) -> Column:
    """Vector over its length (plus 1e-12)."""
    return scaled(a, 1.0 / (F.sqrt(norm2(a)) + 1e-12))


def _element(column: str, i: int, dim: int) -> Column:
    """Element i; with the first one the vector's size is checked, so that none is cut or padded."""
    element = F.col(column)[i].cast("double")
    if i:
        return element
    right = F.col(column).isNull() | (F.size(column) == dim)
    wrong = F.raise_error(F.concat(F.lit(f"a vector of {column} does not have {dim} elements but "), F.size(column).cast("string")))
    return F.when(right, element).otherwise(wrong.cast("double"))


def sum_vector(column: str, dim: int, weight: Column | None = None) -> Column:
    """Aggregate: element-wise (weighted) sum of a vector column as one array.

    One partial sum per element, so the map side combines rows and no vector list is collected.
    """
    w = F.lit(1.0) if weight is None else weight
    return F.array(*[F.sum(_element(column, i, dim) * w) for i in range(dim)])


def mean_vector(column: str, dim: int) -> Column:
    """Aggregate: element-wise mean of a vector column without nulls."""
    n = F.count(F.lit(1))
    return F.array(*[F.sum(_element(column, i, dim)) / n for i in range(dim)])
