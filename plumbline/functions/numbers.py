"""Rounding and vectors: expressions that give the same digits on every engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(x: Column, digits: int) -> Column:
    """Rounded half up through a decimal, so that equal doubles give equal digits everywhere."""
    return F.round(x.cast("decimal(38,10)"), digits).cast("double")


def ratio(a: Column, b: Column) -> Column:
    """a / b as doubles; null where b is 0."""
    return F.when(b != 0, a.cast("double") / b.cast("double"))


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null where a vector is zero."""
    return ratio(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def jaccard(a: Column, b: Column) -> Column:
    """Size of the common part over that of the union of two arrays taken as sets; 0 for two empty ones."""
    return F.coalesce(ratio(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))), F.lit(0.0))


def containment(part: Column, whole: Column) -> Column:
    """The share of part's distinct elements that whole has; 0 for an empty part."""
    return F.coalesce(ratio(F.size(F.array_intersect(part, whole)), F.size(F.array_distinct(part))), F.lit(0.0))
