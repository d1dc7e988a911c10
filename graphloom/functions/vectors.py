"""Vector functions as Spark expressions; numbers are added as doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def l2_distance(a: Column, b: Column) -> Column:
    gap = lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))
    return F.sqrt(F.aggregate(F.zip_with(a, b, gap), F.lit(0.0), lambda s, v: s + v))


def normalised(a: Column) -> Column:
    size = F.sqrt(dot(a, a))
    return F.transform(a, lambda x: F.when(size > 0, x / size).otherwise(x))
