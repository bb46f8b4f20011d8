"""Vector expressions that stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
                       F.lit(0.0), lambda acc, v: acc + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def pad_or_cut(vec: Column, length: int = 128) -> Column:
    """Exactly ``length`` elements: zero-padded or truncated."""
    return F.slice(F.concat(vec, F.array_repeat(F.lit(0.0), length)), 1, length)
