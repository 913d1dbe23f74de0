"""Vector expressions: everything is scored in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def normalized(v: Column) -> Column:
    """The unit vector; a zero vector stays as it is."""
    norm = F.sqrt(dot(v, v))
    return F.when(norm > 0, F.transform(v.cast("array<double>"), lambda x: x / norm)).otherwise(v.cast("array<double>"))


def int8_scale(v: Column) -> Column:
    top = F.array_max(F.transform(v.cast("array<double>"), F.abs))
    return F.when(top > 0, top / 127).otherwise(F.lit(1.0))


def int8(v: Column, scale: Column) -> Column:
    """Symmetric quantization of a row, rounding half to even."""
    return F.transform(v.cast("array<double>"), lambda x: F.greatest(F.lit(-127), F.least(F.lit(127), F.rint(x / scale).cast("int"))).cast("tinyint"))
