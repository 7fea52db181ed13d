"""Vector expressions over arrays, in double precision."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def unit(v: Column) -> Column:
    """v over its length; a zero vector stays."""
    return F.transform(v, lambda x: F.when(norm(v) > 0, x.cast("double") / norm(v)).otherwise(F.lit(0.0)))
