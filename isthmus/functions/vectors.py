"""Column functions on arrays of doubles; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 2.220446049250313e-16


def as_doubles(x) -> Column:
    return F.col(x).cast("array<double>") if isinstance(x, str) else x.cast("array<double>")


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda s, v: s + v)


def distance2(a, b) -> Column:
    """Squared Euclidean distance, by differences."""
    return total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def norm(x) -> Column:
    return F.sqrt(total(F.transform(x, lambda v: v * v)))


def l2_normalized(x) -> Column:
    """x / max(|x|, eps)."""
    n = F.greatest(norm(x), F.lit(EPS))
    return F.transform(x, lambda v: v / n)


def complement_coded(x) -> Column:
    """[x, 1 - x]; an entry outside [0, 1] raises."""
    bad = F.exists(x, lambda v: v.isNull() | (v < 0) | (v > 1) | F.isnan(v))
    return F.when(bad, F.raise_error("features must lie in the unit interval [0, 1]").cast("array<double>")).otherwise(F.concat(x, F.transform(x, lambda v: F.lit(1.0) - v)))


def non_finite(x) -> Column:
    """Whether an entry is null, NaN or infinite, or the array itself null."""
    inf = F.lit(float("inf"))
    return x.isNull() | F.exists(x, lambda v: v.isNull() | F.isnan(v) | (v == inf) | (v == -inf))
