"""Vector algebra on array columns; sums run in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corvid.functions.text import let


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def unit(a: Column) -> Column:
    """``a`` and its norm are computed once, however long it is."""
    return let(a, lambda v: let(norm(v), lambda n: F.transform(v, lambda x: x.cast("double") / n)))


def clamp(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """c cut to the range; null stays null, as greatest and least pass nulls over."""
    return F.when(c.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), c)))
